"""Supplier outage: one supplier's receipts arrive late."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortfall.functions.dates import HORIZON
from shortfall.functions.numbers import round_to
from shortfall.operators import risk as rk
from shortfall.operators.shape import latest_per_key


def check_days(days: int) -> None:
    if not 1 <= days <= HORIZON:
        raise ValueError(f"days must be between 1 and {HORIZON}")


def both_scenarios(open_po: DataFrame, supplier: Column | int, today: Column, days: int) -> DataFrame:
    """Every order once as baseline and once as scenario; the supplier's orders due within the
    outage move `days` later in the scenario."""
    check_days(days)
    hit = (F.col("supplier_id") == supplier) & (F.col("eta_date") <= F.date_add(today, days))
    moved = F.when(hit, F.date_add("eta_date", days)).otherwise(F.col("eta_date"))
    versions = F.array(
        F.struct(F.lit("baseline").alias("scenario"), F.col("eta_date").alias("due")),
        F.struct(F.lit("scenario").alias("scenario"), moved.alias("due")),
    )
    return (
        open_po.where(F.col("eta_date") > today)
        .select("po_id", "material_pn", "supplier_id", "qty", F.explode(versions).alias("v"))
        .select(
            "po_id", "material_pn", "supplier_id", "qty",
            F.col("v.scenario").alias("scenario"), F.col("v.due").alias("eta_date"),
        )
    )


def scenario_orders(open_po: DataFrame, supplier: Column | int, today: Column, days: int) -> DataFrame:
    """Receipts per material and day after the shift."""
    return (
        both_scenarios(open_po, supplier, today, days)
        .where("scenario = 'scenario'")
        .groupBy("material_pn", "eta_date")
        .agg(F.sum("qty").alias("qty"))
    )


def compare(
    demand: DataFrame,
    open_po: DataFrame,
    inventory: DataFrame,
    profile: DataFrame,
    supplier: Column | int,
    today: Column,
    days: int,
) -> DataFrame:
    """Baseline and scenario level and gap of every material, from the demand to date.

    Both receipt arrays are built in one aggregation, so every input is read and shuffled once.
    """
    due = both_scenarios(open_po, supplier, today, days).withColumn("eval_date", today)

    def arrivals(name: str) -> Column:
        mine = f"CASE WHEN scenario = '{name}' THEN qty END"
        position = "datediff(eta_date, eval_date) - 1"
        return rk.day_sums(mine, position, HORIZON, True).alias(f"receipts_{name}")

    both = due.groupBy("eval_date", "material_pn").agg(arrivals("baseline"), arrivals("scenario"))
    base = demand.join(inventory, ["eval_date", "material_pn"]).join(
        both, ["eval_date", "material_pn"], "left"
    ).join(profile, "material_pn")
    graded = base
    for name in ("baseline", "scenario"):
        graded = _graded(graded, name)
    gap_delta = F.col("gap_qty_scenario") - F.col("gap_qty_baseline")
    level_delta = rk.level_rank(F.col("risk_level_baseline")) - rk.level_rank(
        F.col("risk_level_scenario")
    )
    return graded.select(
        "material_pn",
        "risk_level_baseline",
        "risk_level_scenario",
        "gap_qty_baseline",
        "gap_qty_scenario",
        gap_delta.alias("gap_delta"),
        level_delta.alias("level_delta"),
    )


def _graded(frame: DataFrame, name: str) -> DataFrame:
    """Adds gap and level of one scenario."""
    graded = rk.classify(rk.doi_and_coverage(rk.with_shortage(frame, f"receipts_{name}")))
    return (
        graded.withColumnRenamed("gap_qty", f"gap_qty_{name}")
        .withColumnRenamed("risk_level", f"risk_level_{name}")
        .drop("gap_date", "doi_days", "lt_coverage", "risk_reasons")
    )


def worsened(compared: DataFrame, supply_split: DataFrame, supplier: Column | int) -> DataFrame:
    """Materials with a larger gap or a worse level, with the supplier's share."""
    share = supply_split.where(F.col("supplier_id") == supplier).select("material_pn", "split_pct")
    return (
        compared.where("gap_delta > 0 OR level_delta > 0")
        .join(share, "material_pn", "left")
        .withColumn("split_pct", F.coalesce("split_pct", F.lit(0.0)))
    )


def monotonic_violations(compared: DataFrame) -> DataFrame:
    """Materials whose gap shrank, which an outage can never cause."""
    return compared.where("gap_delta < 0")


def sku_exposure(
    compared: DataFrame,
    forecast: DataFrame,
    bom: DataFrame,
    prices: DataFrame,
    today: Column,
    days: int,
) -> DataFrame:
    """Units and value each SKU may lose: the gap increase is split by demand share within the
    outage, turned into units, and the scarcest material counts."""
    in_outage = F.aggregate(F.slice("yhat", 1, days), F.lit(0.0), lambda a, v: a + v)
    need = (
        forecast.select("sku_id", in_outage.alias("units"))
        .join(bom, "sku_id")
        .join(compared.where("gap_delta > 0").select("material_pn", "gap_delta"), "material_pn")
        .withColumn("material_demand", F.col("units") * F.col("qty_per_unit"))
    )
    totals = need.groupBy("material_pn").agg(F.sum("material_demand").alias("total"))
    lost = (
        F.col("gap_delta") * F.col("material_demand") / F.col("total") / F.col("qty_per_unit")
    )
    bottleneck = (
        need.join(totals.where("total > 0"), "material_pn")
        .groupBy("sku_id")
        .agg(F.max(lost).alias("affected_units"))
    )
    latest_price = latest_per_key(prices, ["sku_id"], "week_start", today).select(
        "sku_id", F.col("sell_price").alias("unit_price")
    )
    price = F.coalesce("unit_price", F.lit(0.0))
    return bottleneck.join(latest_price, "sku_id", "left").select(
        "sku_id",
        round_to(F.col("affected_units"), 2).alias("affected_units"),
        round_to(price, 2).alias("unit_price"),
        round_to(F.col("affected_units") * price, 2).alias("exposure_amount"),
    )


def summary(compared: DataFrame, exposure: DataFrame) -> DataFrame:
    """One row with level counts, new RED and ORANGE materials, gap change and exposure."""
    before, after = F.col("risk_level_baseline"), F.col("risk_level_scenario")
    counts = compared.agg(
        F.count_if(before == "RED").alias("baseline_red_count"),
        F.count_if(before == "ORANGE").alias("baseline_orange_count"),
        F.count_if((after == "RED") & (before != "RED")).alias("new_red_count"),
        F.count_if((after == "ORANGE") & before.isin("GREEN", "YELLOW")).alias("new_orange_count"),
        F.coalesce(F.sum("gap_delta"), F.lit(0)).alias("total_gap_delta"),
    )
    money = exposure.agg(
        F.count(F.lit(1)).alias("affected_sku_count"),
        round_to(F.coalesce(F.sum("exposure_amount"), F.lit(0.0)), 2).alias("exposure_amount"),
    )
    # Both sides are single rows of a global aggregate.
    return counts.withColumn("one", F.lit(1)).join(money.withColumn("one", F.lit(1)), "one").drop("one")
