"""Purchase-order intake: mapping, validation, repair, import, undo and routing.

An upload is a DataFrame of text columns with a unique, orderable `row_ref` per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortfall.functions.numbers import (
    needs_nfkc,
    nfkc,
    repaired_date,
    repaired_key,
    repaired_quantity,
    strict_iso_date,
    strict_positive_integer,
    strip,
)

FIELDS: tuple[str, ...] = ("po_id", "material_pn", "supplier_id", "qty", "eta_date")

# Header names accepted for each field.
HEADER_ALIASES: dict[str, tuple[str, ...]] = {
    "po_id": ("采购单号", "采购订单号", "po号", "订单号"),
    "material_pn": ("物料号", "料号", "物料编码", "物料料号"),
    "supplier_id": ("供应商", "供应商编号", "供应商编码"),
    "qty": ("数量", "订单数量", "采购数量"),
    "eta_date": ("到货日", "预计到货", "预计到货日", "eta"),
}


def plain_header(name: str) -> str:
    """A header without what it may be written with: white space, underscores and capital letters."""
    return re.sub(r"[\s_]", "", name).casefold()


def map_headers(columns: Sequence[str]) -> dict[str, str | None]:
    """Source column of each field; the field name itself comes first, then its aliases, and a
    source column serves one field only."""
    free = {plain_header(c): c for c in columns}
    mapping: dict[str, str | None] = {}
    for field in FIELDS:
        names = [plain_header(n) for n in (field, *HEADER_ALIASES[field])]
        hit = next((n for n in names if n in free), None)
        mapping[field] = free.pop(hit) if hit is not None else None
    return mapping


def apply_mapping(upload: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    missing = sorted(f for f in FIELDS if mapping.get(f) is None)
    if missing:
        raise ValueError(f"no source column for: {', '.join(missing)}")
    sources = list(mapping.values())
    if len(set(sources)) != len(sources):
        raise ValueError("one source column is mapped to several fields")
    return upload.select("row_ref", *[F.col(f"`{mapping[f]}`").alias(f) for f in FIELDS])


def flag_rows(
    upload: DataFrame,
    materials: DataFrame,
    suppliers: DataFrame,
    open_po: DataFrame,
    file: str | None = None,
) -> DataFrame:
    """Every row with one nullable error code per field. With `file`, rows of several files are
    checked together and duplicates are looked for inside each file.

    The first row of an order number comes from a minimum per number, combined before the shuffle.
    Rows without a number look themselves up under their own reference, so they never meet in one
    task.
    """
    text = {f: strip(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS}
    same_file = [file] if file else []
    rows = upload.select(
        "row_ref",
        *same_file,
        *FIELDS,
        *[text[f].alias(f"{f}_text") for f in ("po_id", "material_pn", "supplier_id")],
        strict_positive_integer(F.col("qty")).alias("qty_value"),
        strict_iso_date(F.col("eta_date")).alias("eta_value"),
    )
    lookup = F.when(F.col("po_id_text") == "", F.concat(F.lit("?"), "row_ref")).otherwise(F.col("po_id_text"))
    first_use = rows.groupBy(lookup.alias("lookup_po"), *same_file).agg(F.min("row_ref").alias("first_ref"))

    def known(frame: DataFrame, key: str, name: str, flag: str) -> DataFrame:
        return frame.select(F.col(key).alias(name)).distinct().withColumn(flag, F.lit(True))

    def error(wrong: Column, code: str) -> Column:
        return F.when(wrong, code)

    # Each error is settled as soon as it can be, so that where only errors are asked for, a text that has been
    # looked up does not go through the next shuffle. The widest rows go through the fewest.
    joined = (
        rows.withColumn("qty_error", error(F.col("qty_value").isNull(), "invalid_positive_integer"))
        .withColumn("eta_date_error", error(F.col("eta_value").isNull(), "invalid_date"))
        .join(known(suppliers, "supplier_id", "supplier_id_text", "supplier_known"), "supplier_id_text", "left")
        .withColumn("supplier_id_error", error(F.col("supplier_known").isNull(), "unknown_supplier"))
        .join(known(materials, "material_pn", "material_pn_text", "material_known"), "material_pn_text", "left")
        .withColumn("material_pn_error", error(F.col("material_known").isNull(), "unknown_material"))
        .withColumn("lookup_po", lookup)
        .join(first_use, ["lookup_po", *same_file])
        .join(known(open_po, "po_id", "lookup_po", "po_known"), "lookup_po", "left")
    )
    po_error = (
        F.when(F.col("po_id_text") == "", "required")
        .when(F.col("row_ref") != F.col("first_ref"), "duplicate_in_file")
        .when(F.col("po_known"), "already_exists")
    )
    return joined.select(
        "row_ref",
        *same_file,
        *FIELDS,
        "po_id_text",
        "material_pn_text",
        "supplier_id_text",
        "qty_value",
        "eta_value",
        po_error.alias("po_id_error"),
        *[f"{f}_error" for f in FIELDS[1:]],
    )


def graded(flagged: DataFrame) -> DataFrame:
    """The columns of checked rows that repair needs; the others follow from them."""
    return flagged.select("row_ref", *FIELDS, *[f"{f}_error" for f in FIELDS])


def is_valid() -> Column:
    return F.coalesce(*[F.col(f"{f}_error") for f in FIELDS]).isNull()


def valid_rows(flagged: DataFrame) -> DataFrame:
    return flagged.where(is_valid()).select(
        "row_ref",
        F.col("po_id_text").alias("po_id"),
        F.col("material_pn_text").alias("material_pn"),
        F.col("supplier_id_text").alias("supplier_id"),
        F.col("qty_value").alias("qty"),
        F.col("eta_value").alias("eta_date"),
    )


def error_rows(flagged: DataFrame, file: str | None = None) -> DataFrame:
    """One row per rejected cell, with the name of its file where rows of several are checked."""
    place = ["row_ref", *([file] if file else [])]
    cells = F.array(
        *[
            F.when(
                F.col(f"{f}_error").isNotNull(),
                F.struct(F.lit(f).alias("field"), F.col(f"{f}_error").alias("code")),
            )
            for f in FIELDS
        ]
    )
    return flagged.select(*place, F.explode(F.array_compact(cells)).alias("e")).select(
        *place, "e.field", "e.code"
    )


def counts(flagged: DataFrame) -> DataFrame:
    errors = sum(
        (F.when(F.col(f"{f}_error").isNotNull(), 1).otherwise(0) for f in FIELDS), F.lit(0)
    )
    return flagged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(is_valid()).alias("valid_count"),
        F.coalesce(F.sum(errors), F.lit(0)).alias("error_count"),
        F.count_if(~is_valid()).alias("rejected_rows"),
    )


FOLDED: tuple[str, ...] = ("po_id", "material_pn", "supplier_id", "qty")


def widely_folded(rows: DataFrame) -> DataFrame:
    """The rows with a folded text beside every field that is repaired after folding.

    Only rows with a character that width folding does not cover go through the general folding in Python;
    for all others the text itself stands, and width folding follows inside the JVM.
    """
    odd = F.lit(False)
    for f in FOLDED:
        odd = odd | needs_nfkc(F.col(f))
    plain = rows.where(~odd).select("*", *[F.col(f).alias(f"{f}_wide") for f in FOLDED])
    return plain.unionByName(rows.where(odd).select("*", *[nfkc(f).alias(f"{f}_wide") for f in FOLDED]))


def repair_candidates(
    flagged: DataFrame, materials: DataFrame, suppliers: DataFrame, open_po: DataFrame
) -> DataFrame:
    """Rejected rows with a new text for every rejected cell that a rule can repair.

    A key repair counts only when it resolves: a known material or supplier, or an order number that
    is not in the target yet.
    """
    rejected = widely_folded(flagged.where(~is_valid()))

    def on_error(field: str, candidate: Column) -> Column:
        return F.when(F.col(f"{field}_error").isNotNull(), candidate)

    offered = rejected.select(
        "row_ref",
        *FIELDS,
        on_error("po_id", repaired_key(F.col("po_id"), F.col("po_id_wide"))).alias("po_id_offer"),
        on_error("material_pn", repaired_key(F.col("material_pn"), F.col("material_pn_wide"))).alias("material_pn_offer"),
        on_error("supplier_id", repaired_key(F.col("supplier_id"), F.col("supplier_id_wide"))).alias("supplier_id_offer"),
        on_error("qty", repaired_quantity(F.col("qty_wide")).cast("string")).alias("qty_new"),
        on_error("eta_date", repaired_date(F.col("eta_date")).cast("string")).alias("eta_date_new"),
    )

    def resolve(frame: DataFrame, target: DataFrame, key: str, wanted: bool) -> DataFrame:
        offer, flag = f"{key}_offer", f"{key}_found"
        found = target.select(F.col(key).alias("target_key")).distinct().withColumn(flag, F.lit(True))
        # Rows without an offer join under their own reference, so that nulls do not pile up.
        probe = frame.withColumn("probe", F.coalesce(offer, F.concat(F.lit("?"), "row_ref")))
        hit = F.col(flag).isNotNull() if wanted else F.col(flag).isNull()
        return (
            probe.join(found, F.col("probe") == F.col("target_key"), "left")
            .withColumn(f"{key}_new", F.when(hit, F.col(offer)))
            .drop("probe", "target_key", flag, offer)
        )

    # Only rows with an offer are looked up and shuffled, a small part of the rejected ones.
    keys = ("po_id", "material_pn", "supplier_id")
    offer = F.coalesce(*[F.col(f"{k}_offer") for k in keys])
    resolved = resolve(offered.where(offer.isNotNull()), open_po, "po_id", False)
    resolved = resolve(resolved, materials, "material_pn", True)
    resolved = resolve(resolved, suppliers, "supplier_id", True)
    others = offered.where(offer.isNull()).withColumnsRenamed({f"{k}_offer": f"{k}_new" for k in keys})
    columns = ["row_ref", *FIELDS, *[f"{f}_new" for f in FIELDS]]
    return resolved.select(*columns).unionByName(others.select(*columns))


# Rule names by field.
RULES: dict[str, str] = {
    "po_id": "key_normalize",
    "material_pn": "key_normalize",
    "supplier_id": "key_normalize",
    "qty": "qty_format",
    "eta_date": "date_format",
}


def repair_diff(candidates: DataFrame) -> DataFrame:
    """One row per repaired cell: old text, new text and the rule."""
    cells = F.array(
        *[
            F.when(
                F.col(f"{f}_new").isNotNull(),
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f).alias("original_value"),
                    F.col(f"{f}_new").alias("new_value"),
                    F.lit(RULES[f]).alias("rule_name"),
                ),
            )
            for f in FIELDS
        ]
    )
    return candidates.select("row_ref", F.explode(F.array_compact(cells)).alias("c")).select(
        "row_ref", "c.field", "c.original_value", "c.new_value", "c.rule_name"
    )


def repaired_upload(flagged: DataFrame, candidates: DataFrame) -> DataFrame:
    """The upload after repair: accepted rows as they came, rejected rows with their new cells."""
    return flagged.where(is_valid()).select("row_ref", *FIELDS).unionByName(repaired_rows(candidates))


def repaired_rows(candidates: DataFrame) -> DataFrame:
    return candidates.select("row_ref", *[F.coalesce(f"{f}_new", f).alias(f) for f in FIELDS])


def touched_rows(flagged: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows that a check after repair can grade anew: all rejected rows with their new cells, and the
    accepted ones that share an order number with them. No other row's error can change, as errors of
    the other fields depend on the row alone."""
    repaired = repaired_rows(candidates)
    text = strip(F.coalesce("po_id", F.lit(""))).alias("po_id_text")
    numbers = repaired.select(text).where("po_id_text <> ''")
    accepted = flagged.where(is_valid()).select("row_ref", *FIELDS, text).join(numbers.distinct(), "po_id_text", "left_semi")
    return repaired.unionByName(accepted.select("row_ref", *FIELDS))


def with_batch(valid: DataFrame, batch: Column) -> DataFrame:
    """Rows ready to append, marked with their batch."""
    return valid.select("po_id", "material_pn", "supplier_id", "qty", "eta_date", batch.alias("batch_id"))


def undo_batch(stored: DataFrame, batch_rows: DataFrame, batch: str) -> DataFrame:
    """The target without the rows of one batch."""
    mine = batch_rows.where(F.col("batch_id") == batch).select("po_id")
    return stored.join(mine, "po_id", "left_anti")


def route_items(items: DataFrame, allowed_senders: Sequence[str]) -> DataFrame:
    """blocked, invalid_file or pending_review. An empty allow-list blocks everything."""
    listed = sorted({s.strip().lower() for s in allowed_senders})
    sender = F.lower(F.trim("sender"))
    allowed = sender.isin(listed) if listed else F.lit(False)
    workbook = F.lower("filename").endswith(".xlsx")
    return items.select(
        "*",
        F.when(~allowed, "blocked")
        .when(~workbook, "invalid_file")
        .otherwise("pending_review")
        .alias("status"),
        F.when(~allowed, "sender_not_allowed")
        .when(~workbook, "unsupported_file_type")
        .alias("error_code"),
    )


def first_items(items: DataFrame) -> DataFrame:
    """One row per (message_uid, content hash): the smallest item id. Items may come with their hash."""
    hashed = items if "sha256" in items.columns else items.withColumn("sha256", F.sha2("content", 256))
    rest = [c for c in hashed.columns if c not in ("message_uid", "sha256")]
    return (
        hashed.groupBy("message_uid", "sha256")
        .agg(F.min_by(F.struct(*rest), F.col("item_id")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("message_uid", "sha256", *[F.col(f"first.{c}").alias(c) for c in rest], "copies")
    )


def unseen_items(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items whose (message_uid, content hash) is not stored yet."""
    return items.join(stored.select("message_uid", "sha256"), ["message_uid", "sha256"], "left_anti")
