"""Reshaping operators: panels, pivots, as-of joins, lags and rolling windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortfall.functions.dates import day_span, week_start


def unpivot_columns(
    frame: DataFrame, keys: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per key and value column. Cells travel as one array, so a plan over thousands of columns
    stays small."""
    columns = F.expr(f"array({', '.join(f'`{v}`' for v in values)})")
    names = F.split(F.lit("\n".join(values)), "\n")
    cells = frame.select(*keys, F.posexplode(columns).alias("_at", value))
    return cells.select(*keys, F.element_at(names, F.col("_at") + 1).alias(name), value)


def pivot_models(forecast: DataFrame, history: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per (sku, date): the history column next to one column per model."""
    wide = (
        forecast.groupBy("sku_id", "date")
        .pivot("model_name", list(models))
        .agg(F.first("yhat"))
    )
    past = history.select("sku_id", "date", F.col("units_sold").alias("history"))
    return past.join(wide, ["sku_id", "date"], "full_outer").select(
        "sku_id", "date", "history", *models
    )


def densify(
    sparse: DataFrame, key: str, value: str, first_day: Column, last_day: Column
) -> DataFrame:
    """Daily rows for every key of a sparse series; days without a row get zero.

    Every observation also writes the empty days up to the next one, so only the sparse rows are
    shuffled. One key holds at most one row per calendar day.
    """
    by_key = Window.partitionBy(key).orderBy("date")
    spans = sparse.select(
        key,
        "date",
        F.col(value).alias("observed"),
        F.when(F.lag("date").over(by_key).isNull(), F.least(first_day, F.col("date")))
        .otherwise(F.col("date"))
        .alias("span_start"),
        F.coalesce(F.date_sub(F.lead("date").over(by_key), 1), last_day).alias("span_end"),
    )
    return spans.select(
        key,
        F.col("date").alias("observed_on"),
        "observed",
        F.explode(day_span(F.col("span_start"), F.col("span_end"))).alias("date"),
    ).select(
        key,
        "date",
        F.when(F.col("date") == F.col("observed_on"), F.col("observed"))
        .otherwise(F.lit(0))
        .cast(sparse.schema[value].dataType)
        .alias(value),
    )


def priced_panel(
    sales: DataFrame, prices: DataFrame, first_day: Column, last_sale: Column, last_day: Column, backfill: bool = True
) -> DataFrame:
    """Dense daily panel up to last_day with the price known on each day; days after last_sale have
    null units, days before the first price take that price, or none without `backfill`.

    Sales and prices meet as a union of sparse rows that is shuffled once by SKU. Between two rows
    of a SKU nothing changes, so the days in between are written in place.
    """
    events = (
        sales.select("sku_id", "date", F.col("units_sold").alias("units"), F.lit(None).cast("double").alias("price"))
        .unionByName(
            prices.select(
                "sku_id",
                F.col("week_start").alias("date"),
                F.lit(None).cast(sales.schema["units_sold"].dataType).alias("units"),
                F.col("sell_price").cast("double").alias("price"),
            )
        )
        .where(F.col("date") <= last_day)
        .repartition("sku_id")
        .groupBy("sku_id", "date")
        .agg(F.max("units").alias("units"), F.max("price").alias("price"))
    )
    by_key = Window.partitionBy("sku_id").orderBy("date")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opening = F.lag("date").over(by_key).isNull()
    known = F.last("price", True).over(so_far)
    spans = events.select(
        "sku_id",
        F.col("date").alias("observed_on"),
        "units",
        (F.coalesce(known, F.first("price", True).over(whole)) if backfill else known).alias("sell_price"),
        F.when(opening, first_day).otherwise(F.greatest(F.col("date"), first_day)).alias("span_start"),
        F.coalesce(F.date_sub(F.lead("date").over(by_key), 1), last_day).alias("span_end"),
    ).where(F.col("span_start") <= F.col("span_end"))
    days = spans.select(
        "sku_id",
        F.explode(day_span(F.col("span_start"), F.col("span_end"))).alias("date"),
        "observed_on",
        "units",
        "sell_price",
    )
    sold = F.when(F.col("date") == F.col("observed_on"), F.col("units"))
    return days.select(
        "sku_id",
        "date",
        F.when(F.col("date") <= last_sale, F.coalesce(sold, F.lit(0)))
        .cast(sales.schema["units_sold"].dataType)
        .alias("units_sold"),
        "sell_price",
    )


def join_event_names(first: Column, second: Column) -> Column:
    """First non-null name; both names joined with ';'."""
    joined = F.concat_ws(";", F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    return F.nullif(joined, F.lit(""))


def calendar_flags(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Weekday number (Monday 0), weekend and event flags; a date missing from the calendar still
    gets its weekend flag from the weekday.

    The calendar has one row per date, some ten thousand rows for decades, so it is broadcast.
    """
    known = F.broadcast(
        calendar.select("date", "event_name", F.col("is_weekend").alias("listed_weekend"))
    )
    weekday = F.weekday("date")
    return days.join(known, "date", "left").select(
        *days.columns,
        weekday.cast("int").alias("day_of_week"),
        F.coalesce(F.col("listed_weekend"), weekday >= 5).cast("int").alias("is_weekend"),
        F.col("event_name").isNotNull().cast("int").alias("has_event"),
    )


def asof_price(days: DataFrame, prices: DataFrame, backfill: bool = True) -> DataFrame:
    """Attach the latest weekly price at or before each (sku, date) row.

    Prices and days go through one shuffle as a union, so no pairs are formed. With backfill, rows
    before the first price take the next known price of the same SKU.
    """
    others = [c for c in days.columns if c not in ("sku_id", "date")]
    rows = days.select("*", F.lit(None).cast("double").alias("known"), F.lit(1).alias("is_row"))
    quotes = prices.select(
        "sku_id",
        F.col("week_start").alias("date"),
        *[F.lit(None).cast(days.schema[c].dataType).alias(c) for c in others],
        F.col("sell_price").cast("double").alias("known"),
        F.lit(0).alias("is_row"),
    )
    by_day = Window.partitionBy("sku_id").orderBy("date", "is_row")
    past = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.unionByName(quotes).withColumn("sell_price", F.last("known", True).over(past))
    if backfill:
        # Only the rows before the first price are empty; they take the price of the first row
        # that has one.
        priced = F.when((F.col("is_row") == 1) & F.col("sell_price").isNotNull(), F.struct("date", "sell_price"))
        first_priced = F.min(priced).over(Window.partitionBy("sku_id"))
        filled = filled.withColumn("sell_price", F.coalesce("sell_price", first_priced["sell_price"]))
    return filled.where("is_row = 1").select(*days.columns, "sell_price")


LAGS: tuple[int, ...] = (28, 29, 30, 31, 32, 33, 34, 35, 42, 56, 364)


def lag_features(panel: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Sales n days earlier on a dense panel; the yearly lag falls back to the 56-day lag."""
    by_day = Window.partitionBy("sku_id").orderBy("date")
    columns = {f"lag_{n}": F.lag("units_sold", n).over(by_day).cast("double") for n in lags}
    lagged = panel.select("*", *[c.alias(name) for name, c in columns.items()])
    if 364 in lags and 56 in lags:
        lagged = lagged.withColumn("lag_364", F.coalesce("lag_364", "lag_56"))
    return lagged


def rolling_features(panel: DataFrame, lead: int = 28) -> DataFrame:
    """Means over 7 and 28 days and the population deviation over 28 days, all ending `lead` days
    earlier; a window that is not full gives null.

    Windows are differences of running totals, which Spark updates by one row per day instead of
    adding up every window again. Whole units keep the totals exact.
    """
    by_day = Window.partitionBy("sku_id").orderBy("date")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = F.col("units_sold").cast("double")
    totals = panel.select(
        "*",
        F.sum(units).over(so_far).alias("_sum"),
        F.sum(units * units).over(so_far).alias("_squares"),
        F.count(units).over(so_far).alias("_count"),
    )

    def inside(total: str, days: int) -> Column:
        before = F.coalesce(F.lag(total, lead + days).over(by_day), F.lit(0))
        return F.lag(total, lead).over(by_day) - before

    windows = totals.select(
        *panel.columns,
        *[
            inside(total, days).alias(f"{total}_{days}")
            for days in (7, 28)
            for total in ("_sum", "_squares", "_count")
        ],
    )
    spread = F.greatest(28 * F.col("_squares_28") - F.col("_sum_28") * F.col("_sum_28"), F.lit(0.0))
    return windows.select(
        *panel.columns,
        F.when(F.col("_count_7") == 7, F.col("_sum_7") / 7).alias("rolling_mean_7"),
        F.when(F.col("_count_28") == 28, F.col("_sum_28") / 28).alias("rolling_mean_28"),
        F.when(F.col("_count_28") == 28, F.sqrt(spread) / 28).alias("rolling_std_28"),
    )


def complete_weeks(daily: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Weekly sums. A week needs all seven rows, and a column all seven values, else it is null."""
    sums = [
        F.when(F.count(v) == 7, F.sum(v)).alias(v) for v in values
    ]
    return (
        daily.groupBy(*keys, week_start(F.col("date")).alias("week_start"))
        .agg(F.count(F.lit(1)).alias("days_in_week"), *sums)
        .where("days_in_week = 7")
        .drop("days_in_week")
    )


def latest_per_key(frame: DataFrame, keys: Sequence[str], order: str, until: Column | None = None) -> DataFrame:
    """The row with the greatest `order` value per key, at or before `until`.

    max_by keeps one candidate row per key on each map task, so a hot key never has to be sorted.
    """
    rows = frame if until is None else frame.where(F.col(order) <= until)
    rest = [c for c in frame.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("latest"))
        .select(*keys, *[F.col(f"latest.{c}").alias(c) for c in rest])
    )


def last_n_per_key(frame: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows per key."""
    newest_first = Window.partitionBy(key).orderBy(F.col(order).desc())
    return (
        frame.withColumn("rn", F.row_number().over(newest_first)).where(F.col("rn") <= n).drop("rn")
    )


def top_n_keys(frame: DataFrame, key: str, weight: Column, n: int) -> DataFrame:
    """Keys of the n greatest totals; equal totals go by key."""
    return (
        frame.groupBy(key).agg(weight.alias("total")).orderBy(F.desc("total"), key).limit(n)
    )


def exact_median(frame: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median of an integer column per group, rounded half up, from value counts.

    Equal values are counted before the shuffle, and the middle rank is found on a running count,
    so a group of any size needs one sorted pass that can spill instead of one in-memory buffer.
    """
    counts = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys)
    running = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.select(
        *keys,
        value,
        F.sum("n").over(running).alias("upto"),
        F.sum("n").over(group).alias("size"),
    )
    low = F.min(F.when(F.col("upto") >= F.expr("(size + 1) div 2"), F.col(value)))
    high = F.min(F.when(F.col("upto") >= F.expr("size div 2 + 1"), F.col(value)))
    return ranked.groupBy(*keys).agg(low.alias("low"), high.alias("high")).select(
        *keys, F.expr("(low + high + 1) div 2").alias(value)
    )
