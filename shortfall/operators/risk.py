"""Material demand, projected shortage and risk grading, set-based over all materials.

Every input is reduced to one row per (eval_date, material_pn) before the joins. Daily quantities
are arrays over the 28-day horizon, so the balance needs neither a dense panel nor a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortfall.functions.dates import HORIZON, each_cutoff, latest
from shortfall.functions.numbers import round_to
from shortfall.operators.forecast import at_cutoffs, day_sums, running_totals

NO_DEMAND_DOI = 999.0
LEVELS: tuple[str, ...] = ("RED", "ORANGE", "YELLOW", "GREEN")
RISK_COLUMNS: tuple[str, ...] = (
    "material_pn",
    "eval_date",
    "doi_days",
    "lt_coverage",
    "supplier_concentration",
    "gap_qty",
    "gap_date",
    "risk_level",
    "risk_reasons",
)
RISK_SCHEMA = (
    "material_pn bigint, doi_days double, lt_coverage double, supplier_concentration double, gap_qty bigint, "
    "gap_date date, risk_level string, risk_reasons string, eval_date date"
)


def level_rank(level: Column) -> Column:
    """RED 1 ... GREEN 4."""
    rank = F.when(level == LEVELS[0], 1)
    for i, name in enumerate(LEVELS[1:], start=2):
        rank = rank.when(level == name, i)
    return rank


def explode_bom(forecast: DataFrame, bom: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Material demand per day of the horizon: sum of yhat * qty_per_unit.

    The join carries one row per BOM line, not one per line and day; the 28 sums are combined on
    the map side before the shuffle to materials.
    """
    sums = ", ".join(f"sum(yhat[{i}] * qty_per_unit)" for i in range(horizon))
    return (
        forecast.join(bom, "sku_id")
        .groupBy("eval_date", "material_pn")
        .agg(F.expr(f"array({sums})").alias("demand"))
    )


def demand_to_date(
    forecast: DataFrame, bom: DataFrame, horizon: int = HORIZON, digits: int | None = None
) -> DataFrame:
    """Material demand from the first day of the horizon up to each day.

    The totals run over the SKU's forecast before the BOM is applied; sums of running totals are the
    running totals of the sums, so no material has to be scanned day by day. Forecasts that are not
    whole units leave sums that depend on their order in the last bits: `digits` settles them.
    """
    upto = forecast.select("eval_date", "sku_id", running_totals("yhat", horizon).alias("yhat"))
    totals = explode_bom(upto, bom, horizon).withColumnRenamed("demand", "demand_upto")
    if digits is None:
        return totals
    return totals.withColumn("demand_upto", F.transform("demand_upto", lambda d: round_to(d, digits)))


def demand_rows(demand: DataFrame) -> DataFrame:
    """Daily demand rows (material_pn, date, demand_qty)."""
    return demand.select(
        "eval_date", "material_pn", F.posexplode("demand").alias("pos", "demand_qty")
    ).select(
        "eval_date",
        "material_pn",
        F.date_add("eval_date", F.col("pos") + 1).alias("date"),
        "demand_qty",
    )


def supply_profile(supply_split: DataFrame) -> DataFrame:
    """Shortest lead time, largest share, source count and primary supplier per material.

    Equal shares go to the smaller supplier id.
    """
    best = F.min_by("supplier_id", F.struct(-F.col("split_pct"), F.col("supplier_id")))
    return supply_split.groupBy("material_pn").agg(
        F.min("lead_time_days").alias("min_lt"),
        F.max("split_pct").cast("double").alias("supplier_concentration"),
        F.count(F.lit(1)).alias("supplier_count"),
        best.alias("primary_supplier_id"),
    )


def latest_inventory(inventory: DataFrame, cutoffs: Sequence[Column]) -> DataFrame:
    """The newest snapshot at or before each cutoff."""
    usable = inventory.where(F.col("snapshot_date") <= latest(cutoffs))
    return (
        each_cutoff(usable, cutoffs, lambda c: c >= F.col("snapshot_date"))
        .groupBy("eval_date", "material_pn")
        .agg(
            F.max("snapshot_date").alias("snapshot_date"),
            F.max_by("qty_onhand", "snapshot_date").alias("qty_onhand"),
        )
    )


def receipts(
    open_po: DataFrame, cutoffs: Sequence[Column], running: bool = True, horizon: int = HORIZON
) -> DataFrame:
    """Receipts up to each day of the horizon, or on each day when not `running`. Orders due at or
    before the cutoff count as received."""
    due = at_cutoffs(open_po, "eta_date", cutoffs, 0, horizon)
    name = "receipts_upto" if running else "receipts"
    return due.groupBy("eval_date", "material_pn").agg(
        day_sums("qty", "datediff(eta_date, eval_date) - 1", horizon, running).alias(name)
    )


def with_shortage(frame: DataFrame, received: str = "receipts_upto") -> DataFrame:
    """Adds gap_date, the first day with a negative balance, and gap_qty, the deepest shortage
    rounded up.

    The balance of a day is the stock plus all receipts minus all demand up to that day, so receipts
    land before the same day's demand.
    """
    balance = F.expr(
        f"CASE WHEN {received} IS NULL THEN transform(demand_upto, d -> qty_onhand - d) "
        f"ELSE zip_with({received}, demand_upto, (r, d) -> qty_onhand + r - d) END"
    )
    return (
        frame.withColumn("balance", balance)
        .withColumn("lowest", F.array_min("balance"))
        .withColumn(
            "gap_date",
            F.expr(
                "CASE WHEN lowest < 0 THEN date_add(eval_date, "
                "cast(array_position(transform(balance, b -> b < 0), true) as int)) END"
            ),
        )
        .withColumn("gap_qty", F.ceil(F.greatest(-F.col("lowest"), F.lit(0.0))).cast("bigint"))
        .drop("balance", "lowest")
    )


def projected_shortage(demand: DataFrame, received: DataFrame, inventory: DataFrame) -> DataFrame:
    """First short day and deepest shortage per material, from demand and receipts to date."""
    on = ["eval_date", "material_pn"]
    return with_shortage(demand.join(inventory, on).join(received, on, "left"))


def doi_and_coverage(frame: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Days of inventory (999 without demand) and its ratio to the shortest lead time."""
    average = F.element_at("demand_upto", -1) / horizon
    doi = F.when(average == 0, F.lit(NO_DEMAND_DOI)).otherwise(
        round_to(F.col("qty_onhand") / average, 1)
    )
    return frame.withColumn("doi_days", doi).withColumn(
        "lt_coverage", round_to(F.col("doi_days") / F.col("min_lt"), 2)
    )


def classify(frame: DataFrame) -> DataFrame:
    """Risk level (highest matching rule) and all matching reason codes in fixed order."""
    has_gap = F.col("gap_qty") > 0
    days_left = F.datediff("gap_date", "eval_date")
    early = F.coalesce(has_gap & (days_left < F.col("min_lt")), F.lit(False))
    later = has_gap & ~early
    low_single = (F.col("doi_days") < 0.5 * F.col("min_lt")) & (F.col("supplier_count") == 1)
    low = F.col("doi_days") < F.col("min_lt")
    concentrated = (F.col("supplier_concentration") > 70) & (
        F.col("doi_days") < 1.5 * F.col("min_lt")
    )
    reasons = F.concat_ws(
        ";",
        F.when(early, F.lit("GAP_BEFORE_LT")),
        F.when(later, F.lit("GAP_IN_HORIZON")),
        F.when(low_single, F.lit("LOW_DOI_SINGLE_SOURCE")),
        F.when(low, F.lit("LOW_DOI")),
        F.when(concentrated, F.lit("HIGH_CONCENTRATION")),
    )
    level = (
        F.when(early, F.lit("RED"))
        .when(later | low_single, F.lit("ORANGE"))
        .when(low | concentrated, F.lit("YELLOW"))
        .otherwise(F.lit("GREEN"))
    )
    return frame.withColumn("risk_level", level).withColumn("risk_reasons", reasons)


def assess(
    demand: DataFrame,
    received: DataFrame,
    inventory: DataFrame,
    profile: DataFrame,
) -> DataFrame:
    """Full risk rows with the inputs of each grade."""
    shortage = projected_shortage(demand, received, inventory)
    graded = classify(doi_and_coverage(shortage.join(profile, "material_pn")))
    return graded.select(
        *RISK_COLUMNS,
        F.col("qty_onhand").alias("inventory_qty"),
        "min_lt",
        "supplier_count",
        "primary_supplier_id",
    )


def material_risk(
    forecast: DataFrame,
    bom: DataFrame,
    inventory: DataFrame,
    open_po: DataFrame,
    supply_split: DataFrame,
    cutoffs: Sequence[Column],
    digits: int | None = None,
) -> DataFrame:
    """Risk snapshot of every material with demand rows, for each cutoff."""
    return assess(
        demand_to_date(forecast, bom, digits=digits),
        receipts(open_po, cutoffs),
        latest_inventory(inventory, cutoffs),
        supply_profile(supply_split),
    )


def level_counts(prefix: str = "") -> list[Column]:
    return [
        F.count_if(F.col("risk_level") == level).alias(f"{prefix}{level.lower()}_count")
        for level in LEVELS
    ]


def risk_by_dimension(risk: DataFrame, materials: DataFrame, dimension: str) -> DataFrame:
    return (
        risk.join(materials.select("material_pn", dimension), "material_pn")
        .groupBy("eval_date", dimension)
        .agg(*level_counts(), F.sum("gap_qty").alias("total_gap_qty"))
    )


def risk_rollup(risk: DataFrame, materials: DataFrame) -> DataFrame:
    """Commodity totals and item-group totals from one pass with grouping sets."""
    joined = risk.join(materials.select("material_pn", "commodity", "item_group"), "material_pn")
    return (
        joined.groupingSets(
            [["eval_date", "commodity"], ["eval_date", "item_group"]],
            "eval_date",
            "commodity",
            "item_group",
        )
        .agg(*level_counts(), F.sum("gap_qty").alias("total_gap_qty"))
    )


def risk_by_supplier(risk: DataFrame, supply_split: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Materials at risk and share-weighted gap per supplier."""
    at_risk = F.col("risk_level").isin("RED", "ORANGE")
    weighted = F.when(at_risk, F.col("gap_qty") * F.col("split_pct") / 100).otherwise(F.lit(0.0))
    return (
        risk.select("material_pn", "eval_date", "risk_level", "gap_qty")
        .join(supply_split.select("material_pn", "supplier_id", "split_pct"), "material_pn")
        .groupBy("eval_date", "supplier_id")
        .agg(
            F.count_distinct(F.when(at_risk, F.col("material_pn"))).alias(
                "red_orange_material_count"
            ),
            round_to(F.sum(weighted), 4).alias("weighted_gap_qty"),
        )
        .join(suppliers.select("supplier_id", "supplier_name"), "supplier_id")
        .select(
            "eval_date",
            "supplier_id",
            "supplier_name",
            "red_orange_material_count",
            "weighted_gap_qty",
        )
    )


def snapshot_summary(risk: DataFrame) -> DataFrame:
    """Level counts and total gap by evaluation date."""
    return risk.groupBy("eval_date").agg(
        *level_counts(), F.sum("gap_qty").alias("total_gap_qty")
    )


def top_contributors(
    forecast: DataFrame, bom: DataFrame, k: int = 3
) -> DataFrame:
    """The k SKUs with the greatest future demand per material."""
    total = F.aggregate("yhat", F.lit(0.0), lambda a, v: a + v)
    by_sku = (
        forecast.select("sku_id", total.alias("units"))
        .join(bom, "sku_id")
        .groupBy("material_pn", "sku_id")
        .agg(F.sum(F.col("units") * F.col("qty_per_unit")).alias("demand_qty"))
    )
    ranked = Window.partitionBy("material_pn").orderBy(F.desc("demand_qty"), "sku_id")
    return (
        by_sku.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    )


def explain(risk: DataFrame, contributors: DataFrame) -> DataFrame:
    """One sentence per material with every reason code and its numbers."""
    sku_names = (
        contributors.groupBy("material_pn")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "sku_id"))).alias("ranked"))
        .select(
            "material_pn",
            F.transform("ranked", lambda r: r["sku_id"].cast("string")).alias("skus"),
        )
    )

    def part(code: str, text: Column) -> Column:
        return F.when(F.array_contains(F.split("risk_reasons", ";"), code), text)

    gap = F.format_number(F.col("gap_qty"), 0)
    doi = F.format_string("%.1f", "doi_days")
    share = F.concat(F.bround("supplier_concentration", 0).cast("int").cast("string"), F.lit("%"))
    sentence = F.concat_ws(
        "; ",
        part(
            "GAP_BEFORE_LT",
            F.concat(
                F.lit("runs out on "), F.col("gap_date").cast("string"),
                F.lit(", stock lasts "), doi, F.lit(" days, shortest lead time "),
                F.col("min_lt").cast("string"), F.lit(" days, too late to expedite, short by "), gap,
            ),
        ),
        part(
            "GAP_IN_HORIZON",
            F.concat(
                F.lit("short by "), gap, F.lit(" from "), F.col("gap_date").cast("string"),
                F.lit(", still reachable within the lead time of "),
                F.col("min_lt").cast("string"), F.lit(" days"),
            ),
        ),
        part(
            "LOW_DOI_SINGLE_SOURCE",
            F.concat(
                F.lit("single source "), F.col("primary_supplier_id").cast("string"),
                F.lit(" holds "), share, F.lit(", stock lasts "), doi,
                F.lit(" days, under half the lead time"),
            ),
        ),
        part(
            "LOW_DOI",
            F.concat(
                F.lit("stock of "), doi, F.lit(" days is under the lead time of "),
                F.col("min_lt").cast("string"), F.lit(" days"),
            ),
        ),
        part(
            "HIGH_CONCENTRATION",
            F.concat(
                F.lit("supplier share "), share,
                F.lit(" with stock under 1.5 lead times"),
            ),
        ),
        F.when(F.col("risk_reasons") == "", F.lit("no shortage, stock or concentration rule matched")),
        F.when(
            F.size("skus") > 0,
            F.concat(F.lit("demand comes from SKUs "), F.array_join("skus", ", ")),
        ),
    )
    return risk.join(sku_names, "material_pn", "left").select(
        "material_pn", "eval_date", "risk_level", sentence.alias("explanation")
    )
