"""Rule-based root causes of projected shortages, for all materials at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortfall.functions.dates import HORIZON


def order_buckets(open_po: DataFrame, risk: DataFrame, today: Column) -> DataFrame:
    """Future orders by arrival: up to the gap (or today without one), in the horizon, later."""
    future = open_po.where(F.col("eta_date") > today)
    bucket = (
        F.when(F.col("eta_date") <= F.coalesce("gap_date", today), "before_gap")
        .when(F.col("eta_date") <= F.date_add(today, HORIZON), "within_horizon")
        .otherwise("outside_horizon")
    )
    return future.join(risk.select("material_pn", "gap_date"), "material_pn").withColumn(
        "bucket", bucket
    )


def bucket_totals(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("material_pn", "bucket").agg(
        F.count(F.lit(1)).alias("po_count"), F.sum("qty").alias("qty")
    )


def demand_shares(forecast: DataFrame, bom: DataFrame) -> DataFrame:
    """Share of each SKU in a material's demand, and the number of SKUs that use it.

    Totals come from an aggregation joined back, not from a window, so a material used by very many
    SKUs is combined before the shuffle and can be split by the adaptive skew join.
    """
    units = F.aggregate("yhat", F.lit(0.0), lambda a, v: a + v)
    parts = (
        forecast.select("sku_id", units.alias("units"))
        .join(bom, "sku_id")
        .groupBy("material_pn", "sku_id")
        .agg(F.sum(F.col("units") * F.col("qty_per_unit")).alias("demand_qty"))
    )
    totals = parts.groupBy("material_pn").agg(
        F.sum("demand_qty").alias("total"), F.count(F.lit(1)).alias("sku_count")
    )
    share = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(
        F.col("demand_qty") / F.col("total") * 100
    )
    return parts.join(totals, "material_pn").select(
        "material_pn", "sku_id", "demand_qty", share.alias("share_pct"), "sku_count"
    )


def sku_counts(bom: DataFrame, forecast: DataFrame) -> DataFrame:
    """Number of forecast SKUs per material."""
    return (
        bom.join(forecast.select("sku_id").distinct(), "sku_id", "left_semi")
        .groupBy("material_pn")
        .agg(F.count_distinct("sku_id").alias("sku_count"))
    )


def root_cause(risk_detail: DataFrame, open_po: DataFrame, counts: DataFrame, today: Column) -> DataFrame:
    """Single source with orders on the way, shared demand, long lead time without orders, unknown:
    the first rule that matches."""
    coming = (
        open_po.where(F.col("eta_date") > today)
        .groupBy("material_pn")
        .agg(F.sum("qty").alias("po_qty"))
    )
    po_qty = F.coalesce("po_qty", F.lit(0))
    users = F.coalesce("sku_count", F.lit(0))
    category = (
        F.when((F.col("supplier_count") == 1) & (po_qty > 0), "single_source_supply")
        .when(users > 1, "shared_demand_competition")
        .when((F.col("min_lt") > HORIZON) & (po_qty == 0), "long_leadtime_no_po")
        .otherwise("unknown")
    )
    return (
        risk_detail.join(coming, "material_pn", "left")
        .join(counts, "material_pn", "left")
        .select(
            "material_pn", "risk_level", "gap_qty", "inventory_qty", "supplier_count", "min_lt",
            po_qty.alias("po_qty"), users.alias("sku_count"), category.alias("category"),
        )
    )


def accuracy(diagnosed: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of right categories per expected category."""
    right = F.col("category") == F.col("expected_category")
    return (
        diagnosed.join(truth, "material_pn")
        .groupBy("expected_category")
        .agg(
            F.count(F.lit(1)).alias("scenarios"),
            F.count_if(right).alias("right_answers"),
            (F.count_if(right) * 100 / F.count(F.lit(1))).alias("accuracy_pct"),
        )
    )
