"""Demand forecasting. Cutoffs are a grouping key, so all folds and snapshots are one plan.

Forecasts are kept as one row per (eval_date, sku_id) with an array of 28 daily values. The array
is only exploded to daily rows where a caller asks for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortfall.functions.dates import HORIZON, SEASON, each_cutoff, earliest, latest
from shortfall.functions.numbers import round_to


def at_cutoffs(
    frame: DataFrame, day: str, cutoffs: Sequence[Column], back: int, ahead: int
) -> DataFrame:
    """Rows whose day lies in (cutoff - back, cutoff + ahead], once per such cutoff."""
    lower = F.col(day) > F.date_sub(earliest(cutoffs), back)
    upper = F.col(day) <= F.date_add(latest(cutoffs), ahead)
    return each_cutoff(
        frame.where(lower & upper),
        cutoffs,
        lambda c: (F.col(day) > F.date_sub(c, back)) & (F.col(day) <= F.date_add(c, ahead)),
    )


def day_sums(value: str, position: str, size: int, running: bool = False) -> Column:
    """Array whose i-th element sums `value` at position i (0-based), or up to position i when
    `running`; an element without rows is 0. Both arguments are SQL expressions.

    One text is parsed instead of building hundreds of column objects.
    """
    test = "<=" if running else "="
    low = f"({position}) >= 0 AND " if running else ""
    sums = [
        f"coalesce(sum(CASE WHEN {low}({position}) {test} {i} THEN CAST({value} AS DOUBLE) END), 0D)"
        for i in range(size)
    ]
    return F.expr(f"array({', '.join(sums)})")


def running_totals(values: str, size: int) -> Column:
    """Prefix sums of an array column."""
    return F.expr(
        f"transform(sequence(1, {size}), n -> aggregate(slice({values}, 1, n), 0D, (a, v) -> a + v))"
    )


def seasonal_naive(sales: DataFrame, cutoffs: Sequence[Column], horizon: int = HORIZON) -> DataFrame:
    """Repeat the last seven days of every series over the horizon.

    The series is taken as a regular daily panel: a day without a row is a day without sales.
    A series counts from its first sale on, and stays in the forecast after its last. One pass over
    the sales serves all cutoffs: seven conditional sums per cutoff, combined before the shuffle.
    """
    dated = sales.select(
        "sku_id", "date", "units_sold", *[c.alias(f"cutoff_{i}") for i, c in enumerate(cutoffs)]
    )
    per_sku = dated.groupBy("sku_id").agg(
        F.min("date").alias("first_sale"),
        *[
            day_sums("units_sold", f"{SEASON - 1} - datediff(cutoff_{i}, date)", SEASON).alias(
                f"season_{i}"
            )
            for i in range(len(cutoffs))
        ],
    )
    versions = F.array(
        *[
            F.struct(c.alias("eval_date"), F.col(f"season_{i}").alias("season"))
            for i, c in enumerate(cutoffs)
        ]
    )
    keyed = per_sku.select("sku_id", "first_sale", F.explode(versions).alias("v")).select(
        "v.eval_date", "sku_id", "first_sale", "v.season"
    )
    return keyed.where("first_sale <= eval_date").select(
        "eval_date",
        "sku_id",
        F.lit("seasonal_naive").alias("model_name"),
        F.expr(
            f"transform(sequence(0, {horizon - 1}), h -> greatest(season[h % {SEASON}], 0D))"
        ).alias("yhat"),
    )


def rounded(forecast: DataFrame, digits: int = 2) -> DataFrame:
    """The published values."""
    return forecast.withColumn("yhat", F.transform("yhat", lambda v: round_to(v, digits)))


def daily_rows(forecast: DataFrame) -> DataFrame:
    """One row per (eval_date, sku_id, model_name, date)."""
    return forecast.select(
        "eval_date", "sku_id", "model_name", F.posexplode("yhat").alias("pos", "yhat")
    ).select(
        "eval_date",
        "sku_id",
        "model_name",
        F.date_add("eval_date", F.col("pos") + 1).alias("date"),
        "yhat",
    )


def horizon_arrays(daily: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Daily forecast rows back to one array per (eval_date, sku_id, model_name)."""
    return daily.groupBy("eval_date", "sku_id", "model_name").agg(
        day_sums("yhat", "datediff(date, eval_date) - 1", horizon).alias("yhat")
    )


def backtest_cutoffs(last_day: Column, folds: int = 3, horizon: int = HORIZON) -> list[Column]:
    """Cutoffs T-84, T-56, T-28 for the default three folds."""
    return [F.date_sub(last_day, horizon * k) for k in range(folds, 0, -1)]


def fold_number(eval_date: Column, last_day: Column, folds: int = 3, horizon: int = HORIZON) -> Column:
    return (F.lit(folds) + 1 - F.datediff(last_day, eval_date) / horizon).cast("int")


def holdout_rows(panel: DataFrame, cutoffs: Sequence[Column], horizon: int = HORIZON) -> DataFrame:
    """Actual rows of each fold's test window."""
    return at_cutoffs(panel, "date", cutoffs, 0, horizon)


def split_bounds(panel: DataFrame, cutoffs: Sequence[Column], horizon: int = HORIZON) -> DataFrame:
    """Per fold: training and test bounds, row counts and test days."""
    is_train = F.col("date") <= F.col("eval_date")
    is_test = (F.col("date") > F.col("eval_date")) & (
        F.col("date") <= F.date_add("eval_date", horizon)
    )
    # Rows are counted per day first; the folds then repeat days, not rows.
    per_day = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n")).select(
        "date", "n", F.explode(F.array(*cutoffs)).alias("eval_date")
    )
    return per_day.groupBy("eval_date").agg(
        F.min(F.when(is_train, F.col("date"))).alias("train_start"),
        F.max(F.when(is_train, F.col("date"))).alias("train_end"),
        F.sum(F.when(is_train, F.col("n")).otherwise(0)).alias("train_rows"),
        F.min(F.when(is_test, F.col("date"))).alias("test_start"),
        F.max(F.when(is_test, F.col("date"))).alias("test_end"),
        F.count(F.when(is_test, F.col("date"))).alias("test_days"),
        F.sum(F.when(is_test, F.col("n")).otherwise(0)).alias("test_rows"),
    )


def sample_weight(units: Column) -> Column:
    """1/sqrt(units) for sales, 0.05 for a day without sales."""
    root = F.sqrt(F.greatest(units.cast("double"), F.lit(1.0)))
    return F.when(units > 0, F.lit(1.0) / root).otherwise(F.lit(0.05))
