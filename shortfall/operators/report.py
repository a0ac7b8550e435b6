"""Report tables over one or more risk snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortfall.functions.numbers import round_to
from shortfall.operators.risk import LEVELS, level_counts, level_rank


def latest_snapshot(risk: DataFrame) -> DataFrame:
    return risk.where(F.col("eval_date") == risk.agg(F.max("eval_date")).scalar())


def kpi(risk: DataFrame) -> DataFrame:
    """Level counts, total gap and the RED plus ORANGE percentage per snapshot."""
    hot = F.count_if(F.col("risk_level").isin("RED", "ORANGE"))
    return risk.groupBy("eval_date").agg(
        *level_counts(),
        F.coalesce(F.sum("gap_qty"), F.lit(0)).alias("total_gap_qty"),
        round_to(hot * 100 / F.count(F.lit(1)), 2).alias("red_orange_pct"),
    )


def change(risk: DataFrame) -> DataFrame:
    """Difference in RED and ORANGE counts to the previous snapshot.

    The window runs over one row per snapshot date.
    """
    counts = risk.groupBy("eval_date").agg(*level_counts()).select(
        "eval_date", "red_count", "orange_count"
    )
    by_date = Window.orderBy("eval_date")
    return counts.select(
        "eval_date",
        F.lag("eval_date").over(by_date).alias("previous_date"),
        "red_count",
        "orange_count",
        (F.col("red_count") - F.lag("red_count").over(by_date)).alias("red_change"),
        (F.col("orange_count") - F.lag("orange_count").over(by_date)).alias("orange_change"),
    )


def top_red(risk: DataFrame, materials: DataFrame, profile: DataFrame, n: int = 10) -> DataFrame:
    supply = profile.select("material_pn", "min_lt", "primary_supplier_id")
    return (
        risk.where("risk_level = 'RED'")
        .join(materials.select("material_pn", "material_name"), "material_pn")
        .join(supply, "material_pn", "left")
        .select(
            "material_pn", "material_name", "doi_days", "gap_qty", "gap_date", "risk_reasons",
            "supplier_concentration",
            F.coalesce("min_lt", F.lit(0)).alias("min_lt"),
            F.coalesce("primary_supplier_id", F.lit(-1)).alias("primary_supplier_id"),
        )
        .orderBy(F.desc("gap_qty"), "material_pn")
        .limit(n)
    )


def top_suppliers(by_supplier: DataFrame, n: int) -> DataFrame:
    return by_supplier.orderBy(F.desc("weighted_gap_qty"), "supplier_id").limit(n)


def ranked(risk: DataFrame) -> DataFrame:
    """Most severe first, then the larger gap."""
    return risk.orderBy(level_rank(F.col("risk_level")), F.desc("gap_qty"), "material_pn")


def search(
    risk: DataFrame,
    materials: DataFrame,
    level: str | None = None,
    commodity: str | None = None,
    text: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Risk rows by optional level, commodity and case-insensitive text in key or name."""
    rows = risk.join(
        materials.select("material_pn", "material_name", "commodity", "item_group"), "material_pn"
    )
    if level is not None:
        rows = rows.where(F.col("risk_level") == level)
    if commodity is not None:
        rows = rows.where(F.col("commodity") == commodity)
    if text is not None:
        pattern = f"%{text}%"
        rows = rows.where(
            F.col("material_pn").cast("string").ilike(pattern) | F.col("material_name").ilike(pattern)
        )
    return ranked(rows).limit(limit)


def level_distribution(risk: DataFrame) -> DataFrame:
    """Materials per level, with zero for a level that does not occur."""
    counted = risk.agg(
        *[F.count_if(F.col("risk_level") == name).alias(name) for name in LEVELS]
    )
    return counted.unpivot([], list(LEVELS), "risk_level", "materials")


def missing_dates(risk: DataFrame, reports: DataFrame) -> DataFrame:
    """Snapshot dates that have no report yet."""
    return risk.select("eval_date").distinct().join(reports, "eval_date", "left_anti")


def availability(risk: DataFrame, day: Column) -> DataFrame:
    """First and last snapshot and the number of rows on one day."""
    return risk.agg(
        F.min("eval_date").alias("first_date"),
        F.max("eval_date").alias("last_date"),
        F.count_if(F.col("eval_date") == day).alias("rows_on_day"),
    )


def date_dimension(risk: DataFrame) -> DataFrame:
    latest = risk.agg(F.max("eval_date")).scalar()
    return risk.select(F.col("eval_date").alias("date")).distinct().select(
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.weekofyear("date").alias("week_of_year"),
        (F.col("date") == latest).alias("is_current"),
    )
