"""Forecast accuracy by model and fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortfall.functions.dates import HORIZON
from shortfall.functions.numbers import round_to
from shortfall.operators import shape
from shortfall.operators.forecast import holdout_rows


def scored_rows(panel: DataFrame, forecast_daily: DataFrame, cutoffs: Sequence[Column]) -> DataFrame:
    """Actual and predicted units of each fold's test window."""
    actual = holdout_rows(panel, cutoffs).select("eval_date", "sku_id", "date", "units_sold")
    return actual.join(forecast_daily, ["eval_date", "sku_id", "date"])


def mape(actual: Column, predicted: Column) -> Column:
    """Mean absolute percentage error over the rows with sales; null when there are none."""
    return F.avg(F.when(actual > 0, F.abs(actual - predicted) / actual)) * 100


def wmape(actual: Column, predicted: Column) -> Column:
    """Sum of absolute errors over the sum of sales; null when nothing was sold."""
    return F.try_divide(F.sum(F.abs(actual - predicted)), F.sum(actual)) * 100


def error_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    y, f = F.col("units_sold").cast("double"), F.col("yhat")
    return scored.groupBy(*keys).agg(mape(y, f).alias("mape"), wmape(y, f).alias("wmape"))


def naive_scale(panel: DataFrame, cutoffs: Sequence[Column]) -> DataFrame:
    """Mean squared day-to-day change of each training series, for every fold.

    The change of a day is computed once; each fold is a conditional sum over it, so the history is
    not repeated per fold.
    """
    by_day = Window.partitionBy("sku_id").orderBy("date")
    change = F.col("units_sold") - F.lag("units_sold").over(by_day)
    changes = panel.select("sku_id", "date", (change * change).cast("double").alias("sq"))
    per_fold = [F.avg(F.when(F.col("date") <= c, F.col("sq"))).alias(f"scale_{i}") for i, c in enumerate(cutoffs)]
    wide = changes.groupBy("sku_id").agg(*per_fold)
    folds = F.array(
        *[F.struct(c.alias("eval_date"), F.col(f"scale_{i}").alias("scale")) for i, c in enumerate(cutoffs)]
    )
    return wide.select("sku_id", F.explode(folds).alias("f")).select("sku_id", "f.eval_date", "f.scale")


def sparse_scale(sales: DataFrame, first_day: Column, cutoffs: Sequence[Column]) -> DataFrame:
    """`naive_scale` of the dense series that begins on `first_day`, from the days with sales alone.

    A sale changes the series on its own day, by the difference to the day before, and by its whole size on
    the day after it if that one has none. All other days change nothing, and their number is known from
    the dates.
    """
    by_day = Window.partitionBy("sku_id").orderBy("date")
    units = F.col("units_sold").cast("double")
    next_day = F.date_add("date", 1)
    sold = sales.select(
        "sku_id",
        "date",
        units.alias("units"),
        F.when(F.lag("date").over(by_day) == F.date_sub("date", 1), F.lag(units).over(by_day)).otherwise(0.0).alias("before"),
        (F.lead("date").over(by_day) == next_day).alias("goes_on"),
    )
    rise = F.when(F.col("date") > first_day, (F.col("units") - F.col("before")) ** 2).otherwise(0.0)
    fall = F.when(F.coalesce("goes_on", F.lit(False)), 0.0).otherwise(F.col("units") ** 2)
    totals = [
        (
            F.sum(F.when(F.col("date") <= c, rise).otherwise(0.0) + F.when(next_day <= c, fall).otherwise(0.0))
            / F.nullif(F.datediff(c, first_day), F.lit(0))
        ).alias(f"scale_{i}")
        for i, c in enumerate(cutoffs)
    ]
    folds = F.array(
        *[F.struct(c.alias("eval_date"), F.col(f"scale_{i}").alias("scale")) for i, c in enumerate(cutoffs)]
    )
    wide = sold.groupBy("sku_id").agg(*totals)
    return wide.select("sku_id", F.explode(folds).alias("f")).select("sku_id", "f.eval_date", "f.scale")


def revenue_weights(
    panel: DataFrame, prices: DataFrame, cutoffs: Sequence[Column], horizon: int = HORIZON
) -> DataFrame:
    """Revenue of the last 28 training days per series and fold.

    As in the scored window itself, a price is the last one known inside the fold's own window rows.
    """
    first = F.date_sub(cutoffs[0], horizon)
    recent = panel.where((F.col("date") > first) & (F.col("date") <= cutoffs[-1]))
    # A price is looked up once per day; leading days without one are back-filled per fold below.
    priced = shape.asof_price(recent, prices, backfill=False)
    windows = F.array(
        *[
            F.when((F.col("date") > F.date_sub(c, horizon)) & (F.col("date") <= c), c)
            for c in cutoffs
        ]
    )
    rows = priced.select("*", F.explode(windows).alias("eval_date")).where(
        F.col("eval_date").isNotNull()
    )
    has_price = F.col("sell_price").isNotNull()
    units = F.col("units_sold").cast("double")
    sums = rows.groupBy("sku_id", "eval_date").agg(
        F.sum(F.when(has_price, units * F.col("sell_price"))).alias("priced_revenue"),
        F.sum(F.when(~has_price, units)).alias("unpriced_units"),
        F.min_by(
            F.when(has_price, F.col("sell_price")), F.when(has_price, F.col("date"))
        ).alias("first_price"),
    )
    late = F.col("unpriced_units") * F.coalesce(F.col("first_price"), F.lit(0.0))
    return sums.select(
        "sku_id",
        "eval_date",
        (F.coalesce("priced_revenue", F.lit(0.0)) + F.coalesce(late, F.lit(0.0))).alias("revenue"),
    )


def wrmsse(
    scored: DataFrame,
    panel: DataFrame,
    prices: DataFrame,
    cutoffs: Sequence[Column],
    scale: DataFrame | None = None,
) -> DataFrame:
    """Revenue-weighted root mean squared scaled error per (eval_date, model_name).

    Series with a zero scale are left out; without any revenue all remaining series weigh the same. The
    panel may begin 28 days before the first fold where the scale comes from elsewhere.
    """
    scale = naive_scale(panel, cutoffs) if scale is None else scale
    error = F.col("units_sold") - F.col("yhat")
    mse = scored.groupBy("eval_date", "model_name", "sku_id").agg(
        F.avg(error * error).alias("mse")
    )
    per_sku = (
        mse.join(scale.where("scale > 0"), ["sku_id", "eval_date"])
        .join(revenue_weights(panel, prices, cutoffs), ["sku_id", "eval_date"], "left")
        .select(
            "eval_date",
            "model_name",
            F.sqrt(F.col("mse") / F.col("scale")).alias("rmsse"),
            F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        )
    )
    weighted = F.sum(F.col("rmsse") * F.col("revenue")) / F.sum("revenue")
    return per_sku.groupBy("eval_date", "model_name").agg(
        F.when(F.sum("revenue") > 0, weighted).otherwise(F.avg("rmsse")).alias("wrmsse")
    )


def scorecard(
    panel: DataFrame,
    forecast_daily: DataFrame,
    prices: DataFrame,
    cutoffs: Sequence[Column],
    scale: DataFrame | None = None,
) -> DataFrame:
    """MAPE, WMAPE and WRMSSE per model and fold."""
    scored = scored_rows(panel, forecast_daily, cutoffs)
    errors = error_metrics(scored, ["eval_date", "model_name"])
    scaled = wrmsse(scored, panel, prices, cutoffs, scale)
    return errors.join(scaled, ["eval_date", "model_name"])


def model_means(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("model_name").agg(
        *[F.avg(m).alias(m) for m in ("mape", "wmape", "wrmsse")]
    )


def improvement(metrics: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """Mean metrics of two models side by side, relative gains and forecast accuracy."""

    def mean(model: str, metric: str) -> Column:
        return F.avg(F.when(F.col("model_name") == model, F.col(metric)))

    means = metrics.agg(
        *[
            mean(model, metric).alias(f"{role}_{metric}")
            for role, model in (("candidate", candidate), ("baseline", baseline))
            for metric in ("mape", "wmape", "wrmsse")
        ]
    )

    def gain(metric: str) -> Column:
        base = F.col(f"baseline_{metric}")
        return ((base - F.col(f"candidate_{metric}")) / base * 100).alias(f"{metric}_gain_pct")

    return means.select(
        "*", gain("mape"), gain("wmape"), gain("wrmsse"),
        (100 - F.col("candidate_wmape")).alias("forecast_accuracy_pct"),
    )


def rounded_metrics(metrics: DataFrame, digits: int = 3) -> DataFrame:
    """Published three-decimal values."""
    names = ("mape", "wmape", "wrmsse")
    return metrics.select(
        *[c for c in metrics.columns if c not in names],
        *[round_to(F.col(n), digits).alias(n) for n in names],
    )
