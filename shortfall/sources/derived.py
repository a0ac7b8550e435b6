"""Upload, item and answer tables derived from the test data, with planted defects.

The defect of a row follows from its order key, so it is the same in every engine. No row is left
out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortfall.functions.numbers import WIDE_DIGITS
from shortfall.sources.tables import PlanningTables, compact_day, po_number, zero_padded

RAISED_DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
ALLOWED_SENDERS = ("purchase", "Signup ", "click")


def material_code(pn: Column) -> Column:
    return F.concat(F.lit("PN-"), zero_padded(pn, 5))


def supplier_code(supplier: Column) -> Column:
    return F.concat(F.lit("SUP-"), zero_padded(supplier, 3))


def coded_materials(p: PlanningTables) -> DataFrame:
    return p.materials.select(material_code(F.col("material_pn")).alias("material_pn"))


def coded_suppliers(p: PlanningTables) -> DataFrame:
    return p.suppliers.select(supplier_code(F.col("supplier_id")).alias("supplier_id"))


def line_reference() -> Column:
    """The `row_ref` of an order line."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws(
        "-",
        zero_padded(F.col("l_orderkey"), 12), zero_padded(F.col("l_linenumber"), 2),
        zero_padded(F.col("material_pn"), 12), compact_day(F.col("date")), zero_padded(cents, 12),
    )


RANKED = 17  # characters of a reference that fit into a bigint


def reference_rank() -> Column:
    """A number that orders references as their first characters do: a digit of base twelve for no character, a
    hyphen and each digit."""
    head = F.rpad(F.substring(line_reference(), 1, RANKED), RANKED, " ")
    return F.conv(F.translate(head, " -0123456789", "0123456789AB"), 12, 10).cast("bigint")


DROPS = 4


def dropped_lines(p: PlanningTables) -> DataFrame:
    """The order lines in the order of their files, each order in one of DROPS. Bare lines are shuffled and
    sorted, a third of the bytes of their cells; whole references are compared only where ranks are equal."""
    drop = F.substring(line_reference(), 1, 12).cast("bigint") % DROPS
    dealt = p.lines.withColumn("drop", drop).repartition("drop").withColumn("rank", reference_rank())
    return dealt.sortWithinPartitions("drop", "rank", line_reference())


def upload(p: PlanningTables, lines: DataFrame | None = None, *others: str) -> DataFrame:
    """Every order line as a row of text cells; one in sixteen keys per kind of defect, and some of each kind
    with white space around a cell or with characters that only general folding knows. `lines` are the order lines
    if they are dealt or sorted before they become text, `others` columns of theirs to keep."""
    kind, odd = F.col("l_orderkey") % 16, F.expr("l_orderkey div 16") % 8
    quantity = F.col("quantity").cast("string")
    day = F.col("date")
    number = po_number(["l_orderkey", "l_linenumber", "material_pn", "supplier_id", "date"])
    short = F.concat_ws("-", F.lit("PO"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    code = material_code(F.col("material_pn"))

    def spaced(cell: Column, number: int, before: str, after: str) -> Column:
        return F.when(odd == number, F.concat(F.lit(before), cell, F.lit(after))).otherwise(cell)

    lower_code = F.when(odd == 4, F.translate(code, "0123456789", RAISED_DIGITS)).otherwise(F.lower(code))
    return (p.lines if lines is None else lines).select(
        *others,
        line_reference().alias("row_ref"),
        F.when(kind == 9, "").when(kind == 13, short).when(kind == 14, F.lower(short))
        .otherwise(number).alias("po_id"),
        spaced(
            F.when(kind == 4, lower_code).when(kind == 6, F.concat(F.lit("X"), code)).otherwise(code), 0, "", "\t"
        ).alias("material_pn"),
        spaced(
            F.when(kind == 8, "SUP-99999").when(kind == 15, F.lower(supplier_code(F.col("supplier_id"))))
            .otherwise(supplier_code(F.col("supplier_id"))), 1, "\u3000", "",
        ).alias("supplier_id"),
        spaced(F.when(kind == 2, F.concat(F.lit("1,"), F.lpad(quantity, 3, "0")))
        .when((kind == 3) & (odd == 5), F.translate(quantity, "0123456789", RAISED_DIGITS))
        .when(kind == 3, F.translate(quantity, "0123456789", WIDE_DIGITS))
        .when(kind == 5, F.concat(F.lit("-"), quantity))
        .when(kind == 11, F.concat(quantity, F.lit(".0")))
        .otherwise(quantity), 2, "\u00a0", "\u00a0").alias("qty"),
        spaced(F.when(kind == 0, F.date_format(day, "yyyy/M/d"))
        .when(kind == 1, F.date_format(day, "yyyy年M月d日"))
        .when(kind == 7, "2016/2/30")
        .when(kind == 10, compact_day(day))
        .when(kind == 12, F.date_format(day, "yyyy.M.d"))
        .otherwise(day.cast("string")), 3, "\u2003", "").alias("eta_date"),
    )


def mail_items(p: PlanningTables) -> DataFrame:
    """One incoming attachment per event."""
    return p.read("events").select(
        F.col("event_id").alias("item_id"),
        F.col("user_id").alias("message_uid"),
        F.col("event_type").alias("sender"),
        F.when(F.floor(F.col("value")) % 10 == 0, "note.txt").otherwise("Orders.XLSX").alias("filename"),
        F.col("props").cast("binary").alias("content"),
    )


def answers(p: PlanningTables) -> DataFrame:
    """One generated sentence per material. Every fifth material states its gap 2 % too high, every ninth
    another bay than its own, every eleventh another supplier."""
    pn = F.col("material_pn")
    wrong = pn % 5 == 0
    stated = F.when(wrong, F.ceil(F.col("gap_qty") * 1.02) + 1).otherwise(F.col("gap_qty"))
    return p.stored_risk.select(
        F.col("material_pn").alias("answer_id"),
        F.concat(
            F.lit("1. "), material_code(F.col("material_pn")), F.lit(": gap "),
            F.format_number(stated, 0), F.lit(" units, stock "), F.format_string("%.1f", "doi_days"),
            F.lit(" days, top share "), F.format_string("%.2f%%", "supplier_concentration"),
            F.lit(", lead time "), F.col("min_lt").cast("string"), F.lit("d, short from "),
            F.coalesce(F.col("gap_date").cast("string"), F.lit("never")),
            F.lit(", kept in "), bay(F.when(pn % 9 == 0, pn + 1).otherwise(pn)), F.lit(", sent by supplier "),
            F.when(pn % 11 == 0, F.col("primary_supplier_id") + 40).otherwise(F.col("primary_supplier_id")).cast("string"),
            F.lit(", seen over 14 days"),
        ).alias("answer"),
        F.concat(F.lit("How is "), material_code(F.col("material_pn")), F.lit(" within 28 days?")).alias("question"),
        F.lit("Changes are seen over 14 days.").alias("exempt_text"),
        F.lit(1).cast("bigint").alias("row_count"),
    )


def bay(pn: Column) -> Column:
    """Name of the storage place of a material; its number stays under a thousand."""
    return F.concat(F.lit("Bay "), (100 + pn % 800).cast("string"))
