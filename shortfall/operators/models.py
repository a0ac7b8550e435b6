"""Feature panel and the two fitted forecasts: weekly smoothing and Tweedie regression."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortfall.functions.dates import HORIZON, SEASON, earliest, latest
from shortfall.operators import glm, shape
from shortfall.operators.forecast import horizon_arrays, sample_weight
from shortfall.sources.workspace import scratch_path, ship_by_value

ship_by_value(__name__)

ROLLING: tuple[str, ...] = ("rolling_mean_7", "rolling_mean_28", "rolling_std_28")


def feature_panel(
    sales: DataFrame,
    first_day: Column,
    last_day: Column,
    calendar: DataFrame,
    prices: DataFrame,
    horizon: int = HORIZON,
    backfill: bool = True,
) -> DataFrame:
    """Training and horizon rows with features known 28 days ahead; rows with a missing feature are
    left out. Horizon rows have null units."""
    panel = shape.priced_panel(sales, prices, first_day, last_day, F.date_add(last_day, horizon), backfill)
    # Lags and rolling windows share the panel's partitioning and one sort by date.
    featured = shape.rolling_features(shape.lag_features(panel))
    flagged = shape.calendar_flags(featured, calendar)
    lags = [f"lag_{n}" for n in shape.LAGS]
    return flagged.dropna(subset=[*lags, *ROLLING, "sell_price"]).select(
        "sku_id", "date", "units_sold", *lags, *ROLLING,
        "day_of_week", "is_weekend", "has_event", "sell_price",
    )


SMOOTH_ROWS = 1024  # series that are dense in memory at a time


def smoothed(values: np.ndarray, ends: np.ndarray) -> list[list[np.ndarray | None]]:
    """Forecasts of each series (a row of daily values) from the ends of its histories, given in days.

    Additive smoothing with a weekly season and fixed weights. All series advance together, one day per
    step, and a forecast is read off on the way, so any number of histories costs one pass.
    """
    alpha, gamma = 0.2, 0.1
    rows, length = values.shape
    found: list[list[np.ndarray | None]] = [[None] * ends.shape[1] for _ in range(rows)]
    head = values[:, :SEASON]
    level = head.mean(axis=1)
    season = head - level[:, None]
    wanted = set(np.unique(ends).tolist())
    for done in range(SEASON, length + 1):
        if done > SEASON:
            slot, actual, previous = (done - 1) % SEASON, values[:, done - 1], level
            level = alpha * (actual - season[:, slot]) + (1 - alpha) * previous
            season[:, slot] = gamma * (actual - level) + (1 - gamma) * season[:, slot]
        if done in wanted:
            ahead = [(done + step) % SEASON for step in range(HORIZON)]
            forecast = np.maximum(level[:, None] + season[:, ahead], 0.0)
            for row, k in zip(*np.nonzero(ends == done), strict=True):
                found[row][k] = forecast[row]
    return found


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def smooth_series(days: pd.Series, units: pd.Series, ends: pd.Series) -> pd.Series:
    """Forecasts of sparse series (day numbers from 0 and their units) from the ends of their histories."""
    found: list = []
    for start in range(0, len(days), SMOOTH_ROWS):
        stops = np.vstack(ends.iloc[start : start + SMOOTH_ROWS].to_numpy())
        values = np.zeros((len(stops), max(SEASON, int(stops.max()))))
        for row, (at, sold) in enumerate(zip(days.iloc[start : start + SMOOTH_ROWS], units.iloc[start : start + SMOOTH_ROWS], strict=True)):
            inside = at < values.shape[1]
            values[row, at[inside]] = sold[inside]
        found += smoothed(values, stops)
    return pd.Series(found, index=days.index, dtype=object)


def smoothing_forecast(sales: DataFrame, cutoffs: Sequence[Column], first_day: Column | None = None) -> DataFrame:
    """Weekly smoothing per series and cutoff, from `first_day` or else the series' first row on.

    Only rows with sales are shuffled; a series becomes dense where it is smoothed, and all its cutoffs
    are one pass over it. A series counts for the cutoffs from its first row on.
    """
    ordered = F.sort_array(F.collect_list(F.struct("date", "units_sold")))
    per_sku = (
        sales.where(F.col("date") <= latest(cutoffs))
        .groupBy("sku_id")
        .agg(F.min("date").alias("first_sale"), ordered.alias("rows"))
        .withColumn("first_day", F.col("first_sale") if first_day is None else first_day)
    )
    series = per_sku.select(
        "sku_id",
        "first_sale",
        F.transform("rows", lambda d: F.datediff(d["date"], F.col("first_day"))).alias("days"),
        F.transform("rows", lambda d: d["units_sold"].cast("double")).alias("units"),
        F.array(*[F.datediff(c, "first_day") + 1 for c in cutoffs]).alias("ends"),
    )
    versions = F.arrays_zip(F.array(*cutoffs).alias("eval_date"), F.col("found").alias("yhat"))
    return (
        series.select("sku_id", "first_sale", smooth_series("days", "units", "ends").alias("found"))
        .select("sku_id", "first_sale", F.explode(versions).alias("v"))
        .where("first_sale <= v.eval_date AND v.yhat IS NOT NULL")
        .select("v.eval_date", "sku_id", F.lit("smoothing").alias("model_name"), "v.yhat")
    )


TRAINING_DAYS = 730
AHEAD_LAG = 28  # a feature of a day is known this many days before it


def prices_known_ahead(prices: DataFrame) -> DataFrame:
    """Weekly prices from the day on which a forecast may use them: the whole week is over, and the horizon
    lies behind it, as with the lags of the sales."""
    return prices.withColumn("week_start", F.date_add("week_start", 6 + AHEAD_LAG))


def own_levels(sales: DataFrame, cutoffs: Sequence[Column], window: int) -> DataFrame:
    """sku_id, own: the logarithm of a series' mean daily units in the training window of each cutoff, held
    to one unit where there is little; null before the first sale."""
    rows = sales.where((F.col("date") > F.date_sub(earliest(cutoffs), window)) & (F.col("date") <= latest(cutoffs)))
    sums = [
        F.sum(F.when((F.col("date") > F.date_sub(c, window)) & (F.col("date") <= c), F.col("units_sold"))) for c in cutoffs
    ]
    level = F.array(*[F.log((s + 1) / F.lit(float(window))) for s in sums])
    return rows.groupBy("sku_id").agg(level.alias("own"))


def model_panel(
    sales: DataFrame,
    first_day: Column,
    last_day: Column,
    calendar: DataFrame,
    prices: DataFrame,
    cutoffs: Sequence[Column],
    window: int = TRAINING_DAYS,
) -> DataFrame:
    """Rows that the models of all cutoffs learn from and are applied to (columns of `glm.PANEL`).

    Features of a day come from 28 days before it or earlier, so they are the same for every cutoff and
    none knows what follows it.
    """
    panel = feature_panel(sales, first_day, last_day, calendar, prices_known_ahead(prices), backfill=False)
    logged = [F.log1p(F.col(c)) for c in (*[f"lag_{n}" for n in shape.LAGS], *ROLLING, "sell_price")]
    flags = [F.col(c).cast("double") for c in ("is_weekend", "has_event")]
    weekdays = [(F.col("day_of_week") == d).cast("double") for d in range(1, SEASON)]
    rows = panel.where(F.col("date") > F.date_sub(earliest(cutoffs), window))
    return rows.join(own_levels(sales, cutoffs, window), "sku_id").select(
        "sku_id",
        "date",
        F.col("units_sold").cast("double").alias("label"),
        sample_weight(F.col("units_sold")).alias("weight"),
        F.array(*logged, *flags, *weekdays).alias("features"),
        "own",
    )


def dates_of(frame: DataFrame, cutoffs: Sequence[Column]) -> list[datetime.date]:
    """The cutoffs as dates, a handful."""
    return list(frame.sparkSession.range(1).select(*cutoffs).first())


def tweedie_at(
    sales: DataFrame,
    first_day: Column,
    last_day: Column,
    calendar: DataFrame,
    prices: DataFrame,
    cutoffs: Sequence[Column],
    window: int = TRAINING_DAYS,
) -> DataFrame:
    """One global model per cutoff on the days of its training window: eval_date, sku_id, date, model_name, yhat
    of the 28 days after each cutoff."""
    dates = dates_of(sales, cutoffs)
    path = scratch_path(sales.sparkSession, "model-panel")
    rows = model_panel(sales, first_day, last_day, calendar, prices, cutoffs, window)
    rows.write.parquet(path)
    panel = sales.sparkSession.read.schema(rows.schema).parquet(path)
    return glm.predict(panel, glm.fit(panel, dates, window), dates, HORIZON).withColumn("model_name", F.lit("tweedie"))


def tweedie_forecast(
    sales: DataFrame, first_day: Column, last_day: Column, calendar: DataFrame, prices: DataFrame
) -> DataFrame:
    """The model at `last_day`, applied to the 28 days after it."""
    found = tweedie_at(sales, first_day, last_day, calendar, prices, [last_day])
    return found.select("sku_id", "date", "model_name", "yhat")


def tweedie_arrays(*inputs, cutoffs: Sequence[Column]) -> DataFrame:
    """The forecasts as one array per (eval_date, sku_id, model_name)."""
    return horizon_arrays(tweedie_at(*inputs, cutoffs))
