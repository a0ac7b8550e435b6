"""Table checks. Each returns rows that describe findings; none raises."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortfall.functions.dates import day_span


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_ranges(tables: Mapping[str, DataFrame], limits: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Row count of each table against its allowed range."""
    counts = [
        table.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(limits[name][0]).cast("bigint").alias("minimum"),
            F.lit(limits[name][1]).cast("bigint").alias("maximum"),
            F.col("row_count").between(*limits[name]).alias("in_range"),
        )
        for name, table in tables.items()
    ]
    return stack(counts)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Distinct child keys without a parent."""
    keys = child.select(F.col(column).alias("orphan")).distinct()
    parents = parent.select(F.col(parent_column).alias("orphan"))
    return keys.join(parents, "orphan", "left_anti")


def orphan_report(
    tables: Mapping[str, DataFrame], relations: Sequence[tuple[str, str, str, str]]
) -> DataFrame:
    """Orphan count per foreign key."""
    return stack(
        [
            orphans(tables[child], column, tables[parent], parent_column)
            .agg(F.count(F.lit(1)).alias("orphans"))
            .select(F.lit(f"{child}.{column}").alias("relation"), "orphans")
            for child, column, parent, parent_column in relations
        ]
    )


def split_totals(supply_split: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Materials whose supplier shares do not add up to 100."""
    total = F.round(F.sum("split_pct"), 2)
    return (
        supply_split.groupBy("material_pn")
        .agg(total.alias("total_pct"))
        .where(F.abs(F.col("total_pct") - 100) > tolerance)
    )


def shared_ratio(bom: DataFrame, low: float = 0.15, high: float = 0.25) -> DataFrame:
    """Share of materials used by more than one SKU, and whether it lies in the band."""
    usage = bom.groupBy("material_pn").agg(F.count_distinct("sku_id").alias("skus"))
    ratio = F.count_if(F.col("skus") > 1) / F.count(F.lit(1))
    return usage.agg(
        F.count(F.lit(1)).alias("materials"),
        F.count_if(F.col("skus") > 1).alias("shared"),
        ratio.alias("ratio"),
    ).withColumn("in_band", F.col("ratio").between(low, high))


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_and_negative(
    tables: Mapping[str, tuple[DataFrame, Sequence[str], str]]
) -> DataFrame:
    """Duplicate keys and negative values per table."""
    rows = []
    for name, (frame, keys, value) in tables.items():
        per_key = frame.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) < 0).alias("negative")
        )
        rows.append(
            per_key.agg(
                F.count_if(F.col("n") > 1).alias("duplicate_keys"),
                F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_values"),
            ).select(F.lit(name).alias("table_name"), "duplicate_keys", "negative_values")
        )
    return stack(rows)


def null_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls per column."""
    counts = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "nulls")


def date_gaps(frame: DataFrame, day: str, first: Column, last: Column) -> DataFrame:
    """Days of the window without any row."""
    spine = frame.sparkSession.range(1).select(F.explode(day_span(first, last)).alias(day))
    return spine.join(frame.select(day).distinct(), day, "left_anti")


def missing_lookup(needed: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    return needed.select(key).distinct().join(lookup.select(key), key, "left_anti")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """The join of a side with many rows per key to one that promises a single one.

    A key with several rows on the right ends the query. The right side is reduced to a row per key on
    the partitioning that the join needs anyway, and the key itself carries the check, so that no plan can
    leave it out.
    """
    first, *others = on
    rest = [c for c in right.columns if c not in on]
    per_key = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    shown = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in on])
    broken = F.raise_error(F.concat(F.lit("join key has several rows: "), shown))
    kept = F.when(F.col("_n") == 1, F.col(first)).otherwise(broken.cast(right.schema[first].dataType))
    once = per_key.select(kept.alias(first), *others, *[F.col("_row")[c].alias(c) for c in rest])
    return left.join(once, list(on), how)


def metric_drift(recomputed: DataFrame, frozen: DataFrame, digits: int) -> DataFrame:
    """Frozen metrics that are missing or differ at their stored precision."""
    now = recomputed.select("metric", F.col("value").alias("recomputed"))
    then = frozen.select("metric", F.col("value").alias("frozen"))
    status = (
        F.when(F.col("recomputed").isNull(), "metric_missing")
        .when(F.round("recomputed", digits) != F.round("frozen", digits), "metric_drift")
        .otherwise("ok")
    )
    # Only frozen metrics are checked; a metric that is only recomputed is not a finding.
    return then.join(now, "metric", "left").select("metric", "frozen", "recomputed", status.alias("status"))


def truth_recall(risk: DataFrame, truth: DataFrame) -> DataFrame:
    """Planted materials found at RED or ORANGE with a gap, and RED materials outside the list."""
    listed = truth.select("material_pn", F.lit(True).alias("listed"))
    rows = risk.join(listed, "material_pn", "left").withColumn(
        "listed", F.coalesce("listed", F.lit(False))
    )
    found = F.col("listed") & F.col("risk_level").isin("RED", "ORANGE") & (F.col("gap_qty") > 0)
    return rows.agg(
        F.count_if("listed").alias("listed_materials"),
        F.count_if(found).alias("recalled"),
        F.count_if(~F.col("listed") & (F.col("risk_level") == "RED")).alias("other_red"),
    )


def composition(
    frame: DataFrame, category: str, key: str, required: Sequence[str], expected: DataFrame
) -> DataFrame:
    """Rows, duplicate keys and rows with missing fields per category, against expected counts."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    per_key = frame.groupBy(category, key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing")
    )
    actual = per_key.groupBy(category).agg(
        F.sum("n").alias("row_count"),
        F.count_if(F.col("n") > 1).alias("duplicate_ids"),
        F.sum("missing").alias("missing_fields"),
    )
    zero = F.lit(0)
    return expected.join(actual, category, "full_outer").select(
        category,
        F.coalesce("row_count", zero).alias("row_count"),
        F.coalesce("expected_count", zero).alias("expected_count"),
        F.coalesce("duplicate_ids", zero).alias("duplicate_ids"),
        F.coalesce("missing_fields", zero).alias("missing_fields"),
        (F.coalesce("row_count", zero) == F.coalesce("expected_count", zero)).alias("as_expected"),
    )
