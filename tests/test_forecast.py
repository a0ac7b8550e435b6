from __future__ import annotations

import datetime
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from conftest import day, days
from pyspark.sql import functions as F

from shortfall.operators import forecast as fc
from shortfall.operators import metrics, models, shape

SALES = "sku_id string, date date, units_sold bigint"
PRICES = "sku_id string, week_start date, sell_price double"


def lit(text):
    return F.lit(day(text))


def panel(spark, series, first="2024-01-01"):
    return spark.createDataFrame(
        [(k, d, v) for k, values in series.items() for d, v in zip(days(first, len(values)), values)], SALES
    )


@pytest.fixture(scope="module")
def noisy(spark):
    """Five series of 200 days with holes in the first one's history."""
    random.seed(3)
    series = {f"S{i}": [max(0, 10 + i + (d % 7) * 2 + random.randint(-3, 3)) for d in range(200)] for i in range(5)}
    return series, panel(spark, series)


def test_seasonal_naive_is_exact_on_a_weekly_cycle(spark):
    values = [(d % 7 + 1) * 10 for d in range(70)]
    full = panel(spark, {"A": values})
    cutoffs = [lit(str(days("2024-01-01", 70)[41]))]
    daily = fc.daily_rows(fc.seasonal_naive(full.where(F.col("date") <= cutoffs[0]), cutoffs))
    scored = metrics.scored_rows(full, daily, cutoffs)
    got = metrics.error_metrics(scored, ["eval_date"]).first()
    assert scored.count() == 28 and got.mape == 0.0 and got.wmape == 0.0


def test_naive_ignores_what_comes_after_the_cutoff(spark, noisy):
    _, full = noisy
    cutoff = lit("2024-05-01")
    seen = fc.seasonal_naive(full, [cutoff])
    known = fc.seasonal_naive(full.where(F.col("date") <= cutoff), [cutoff])
    assert seen.exceptAll(known).count() == 0


def test_folds_are_contiguous(noisy):
    _, full = noisy
    last = lit("2024-07-18")
    bounds = fc.split_bounds(full, fc.backtest_cutoffs(last)).orderBy("eval_date").collect()
    assert [(last_day.eval_date - day("2024-07-18")).days for last_day in bounds] == [-84, -56, -28]
    for b in bounds:
        assert b.train_end == b.eval_date and (b.test_start - b.eval_date).days == 1
        assert (b.test_end - b.eval_date).days == 28 and b.test_days == 28 and b.test_rows == 28 * 5


def scored_frame(spark, actual, predicted):
    data = list(zip(actual, map(float, predicted)))
    return spark.createDataFrame(data, "units_sold bigint, yhat double").withColumn("k", F.lit(1))


def test_mape_and_wmape_by_hand(spark):
    skip_zero = metrics.error_metrics(scored_frame(spark, [10, 0, 20], [8, 999, 25]), ["k"]).first()
    assert skip_zero.mape == pytest.approx(22.5)
    weighted = metrics.error_metrics(scored_frame(spark, [10, 0, 20], [8, 9, 25]), ["k"]).first()
    assert weighted.wmape == pytest.approx(53.3333333333)
    empty = metrics.error_metrics(scored_frame(spark, [0, 0], [1, 2]), ["k"]).first()
    assert empty.mape is None and empty.wmape is None


def test_wrmsse_by_hand(spark):
    full = panel(spark, {"A": [1, 2, 3, 4, 5, 5], "B": [2, 4, 6, 8, 10, 10]})
    cutoffs = [lit("2024-01-04")]
    daily = spark.createDataFrame(
        [(day("2024-01-04"), k, day(d), "m", v) for k, d, v in
         [("A", "2024-01-05", 4.0), ("A", "2024-01-06", 6.0), ("B", "2024-01-05", 8.0), ("B", "2024-01-06", 12.0)]],
        "eval_date date, sku_id string, date date, model_name string, yhat double",
    )
    prices = spark.createDataFrame([("A", day("2024-01-01"), 1.0), ("B", day("2024-01-01"), 1.0)], PRICES)
    scored = metrics.scored_rows(full, daily, cutoffs)
    assert metrics.wrmsse(scored, full, prices, cutoffs).first().wrmsse == pytest.approx(1.0)
    free = prices.withColumn("sell_price", F.lit(0.0))
    assert metrics.wrmsse(scored, full, free, cutoffs).first().wrmsse == pytest.approx(1.0)


def test_wrmsse_against_pandas(spark, noisy):
    series, full = noisy
    last = lit("2024-07-18")
    cutoffs = fc.backtest_cutoffs(last)
    # Prices start late for some series, so that the weights need the back-fill.
    quotes = [(f"S{i}", d, 1.5 + i + n * 0.25) for i in range(5) for n, d in enumerate(days("2024-04-01", 105)[i * 20 :: 7])]
    prices = spark.createDataFrame(quotes, PRICES)
    daily = fc.daily_rows(fc.seasonal_naive(full, cutoffs))
    got = {r.eval_date: r.wrmsse for r in metrics.wrmsse(metrics.scored_rows(full, daily, cutoffs), full, prices, cutoffs).collect()}
    for back in (84, 56, 28):
        cut = 200 - back
        ratios, weights = [], []
        for i in range(5):
            y = np.array(series[f"S{i}"], dtype=float)
            ahead = np.array([y[cut - 7 + h % 7] for h in range(28)])
            mse, scale = ((y[cut : cut + 28] - ahead) ** 2).mean(), (np.diff(y[:cut]) ** 2).mean()
            window = pd.DataFrame({"date": pd.to_datetime(days("2024-01-01", 200)[cut - 28 : cut]), "u": y[cut - 28 : cut]})
            mine = pd.DataFrame([(d, p) for k, d, p in quotes if k == f"S{i}"], columns=["date", "p"])
            mine["date"] = pd.to_datetime(mine["date"])
            window["date"] = window["date"].astype("datetime64[ns]")
            mine["date"] = mine["date"].astype("datetime64[ns]")
            priced = pd.merge_asof(window, mine, on="date")["p"].bfill().fillna(0.0)
            ratios.append(np.sqrt(mse / scale))
            weights.append((window["u"] * priced).sum())
        expected = np.dot(ratios, weights) / sum(weights)
        assert got[days("2024-01-01", 200)[cut - 1]] == pytest.approx(expected)


def test_densify_fills_holes_and_edges(spark):
    sparse = spark.createDataFrame(
        [("A", day("2024-01-03"), 5), ("A", day("2024-01-05"), 7), ("B", day("2024-01-01"), 1)], SALES
    )
    got = shape.densify(sparse, "sku_id", "units_sold", lit("2024-01-01"), lit("2024-01-06"))
    values = {k: [] for k in "AB"}
    for r in got.orderBy("sku_id", "date").collect():
        values[r.sku_id].append(r.units_sold)
    assert values == {"A": [0, 0, 5, 0, 7, 0], "B": [1, 0, 0, 0, 0, 0]}


def test_asof_price_and_backfill(spark):
    frame = spark.createDataFrame([("A", d) for d in days("2024-01-01", 10)] + [("B", day("2024-01-01"))], "sku_id string, date date")
    prices = spark.createDataFrame([("A", day("2024-01-03"), 2.0), ("A", day("2024-01-08"), 3.0)], PRICES)
    plain = {(r.sku_id, r.date.day): r.sell_price for r in shape.asof_price(frame, prices, backfill=False).collect()}
    filled = {(r.sku_id, r.date.day): r.sell_price for r in shape.asof_price(frame, prices).collect()}
    assert [plain[("A", d)] for d in (1, 2, 3, 7, 8, 10)] == [None, None, 2.0, 2.0, 3.0, 3.0]
    assert filled[("A", 1)] == 2.0 and filled[("B", 1)] is None
    # The first row with a price counts, not the first quote.
    gap = spark.createDataFrame([("A", day("2024-01-01")), ("A", day("2024-01-09"))], "sku_id string, date date")
    assert {r.sell_price for r in shape.asof_price(gap, prices).collect()} == {3.0}


def test_fused_panel_equals_separate_operators(spark, noisy):
    _, full = noisy
    first, last, end = lit("2024-01-01"), lit("2024-07-18"), lit("2024-08-15")
    sparse = full.where("units_sold % 3 <> 0")
    prices = spark.createDataFrame(
        [(f"S{i}", d, float(n)) for i in range(4) for n, d in enumerate(days("2023-12-25", 230)[i * 9 :: 7])], PRICES
    )
    fused = shape.priced_panel(sparse, prices, first, last, end)
    dense = shape.densify(sparse, "sku_id", "units_sold", first, end).withColumn(
        "units_sold", F.when(F.col("date") <= last, F.col("units_sold"))
    )
    separate = shape.asof_price(dense, prices)
    assert fused.exceptAll(separate).count() == 0 and separate.exceptAll(fused).count() == 0


def test_lags_and_rolling_windows_against_pandas(spark, noisy):
    series, full = noisy
    got = shape.rolling_features(shape.lag_features(full)).where("sku_id = 'S2'").orderBy("date").toPandas()
    y = pd.Series(series["S2"], dtype=float)
    for n in (28, 35, 42, 56):
        pd.testing.assert_series_equal(got[f"lag_{n}"], y.shift(n), check_names=False)
    pd.testing.assert_series_equal(got["lag_364"], y.shift(56), check_names=False)
    moved = y.shift(28)
    pd.testing.assert_series_equal(got["rolling_mean_7"], moved.rolling(7).mean(), check_names=False)
    pd.testing.assert_series_equal(got["rolling_mean_28"], moved.rolling(28).mean(), check_names=False)
    pd.testing.assert_series_equal(got["rolling_std_28"], moved.rolling(28).std(ddof=0), check_names=False)


def test_exact_median(spark):
    random.seed(1)
    groups = {k: [random.randint(1, 30) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 101), ("d", 100))}
    frame = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, v bigint")
    got = {r.k: r.v for r in shape.exact_median(frame, ["k"], "v").collect()}
    assert got == {k: int(statistics.median(v) + 0.5) for k, v in groups.items()}


def test_complete_weeks_need_seven_rows_and_values(spark):
    data = [("A", d, 1, None if d.day == 10 else 2) for d in days("2024-01-01", 17)]
    frame = spark.createDataFrame(data, "sku_id string, date date, x bigint, y bigint")
    got = shape.complete_weeks(frame, ["sku_id"], ["x", "y"]).orderBy("week_start").collect()
    assert [(r.week_start.day, r.x, r.y) for r in got] == [(1, 7, 14), (8, 7, None)]


def test_smoothing_against_a_plain_loop(spark, noisy):
    series, full = noisy
    cut = 150
    got = models.smoothing_forecast(full, [lit(str(days("2024-01-01", 200)[cut - 1]))]).collect()
    for r in got:
        y = series[r.sku_id][:cut]
        level = sum(y[:7]) / 7
        season = [v - level for v in y[:7]]
        for i in range(7, cut):
            previous, level = level, 0.2 * (y[i] - season[i % 7]) + 0.8 * level
            season[i % 7] = 0.1 * (y[i] - level) + 0.9 * season[i % 7]
        assert r.yhat == pytest.approx([max(level + season[(cut + h) % 7], 0) for h in range(28)])


def test_weights_and_improvement(spark):
    frame = spark.createDataFrame([(0,), (1,), (4,)], "u bigint")
    assert [r[0] for r in frame.select(fc.sample_weight(F.col("u"))).collect()] == [0.05, 1.0, 0.5]
    card = spark.createDataFrame(
        [("a", 40.0, 30.0, 0.9), ("b", 50.0, 40.0, 1.0)], "model_name string, mape double, wmape double, wrmsse double"
    )
    gain = metrics.improvement(card, "a", "b").first()
    assert (gain.mape_gain_pct, gain.wmape_gain_pct, gain.forecast_accuracy_pct) == (20.0, 25.0, 70.0)


def test_tweedie_learns_a_weekly_pattern(spark):
    series = {f"S{i}": [(5 + i) * (3 if d % 7 == 5 else 1) for d in range(430)] for i in range(6)}
    full = panel(spark, series, "2023-01-02")
    calendar = spark.createDataFrame(
        [(d, None, d.weekday() >= 5) for d in days("2023-01-02", 460)], "date date, event_name string, is_weekend boolean"
    )
    prices = spark.createDataFrame([(k, day("2023-01-02"), 2.0) for k in series], PRICES)
    last = days("2023-01-02", 430)[-1]
    got = models.tweedie_forecast(full, lit("2023-01-02"), F.lit(last), calendar, prices)
    assert got.count() == 6 * 28
    by_day = {r.dow: r.m for r in got.groupBy(F.weekday("date").alias("dow")).agg(F.avg("yhat").alias("m")).collect()}
    assert by_day[5] > 2 * by_day[1] and min(by_day.values()) >= 0


def test_sparse_scale_equals_the_dense_one(spark):
    random.seed(4)
    rows = [(f"S{i}", d, random.randint(1, 9)) for i in range(6) for d in days("2024-01-01", 60)[i:] if random.random() < 0.2 + 0.15 * i]
    rows += [("first", day("2024-01-01"), 5), ("last", day("2024-02-20"), 3), ("pair", day("2024-01-10"), 4), ("pair", day("2024-01-11"), 4)]
    sales = spark.createDataFrame(rows, "sku_id string, date date, units_sold bigint")
    cutoffs = [lit("2024-01-11"), lit("2024-02-01"), lit("2024-02-20"), lit("2024-02-21")]
    dense = shape.densify(sales, "sku_id", "units_sold", lit("2024-01-01"), lit("2024-02-29"))
    wanted = {(r.sku_id, r.eval_date): r.scale for r in metrics.naive_scale(dense, cutoffs).collect()}
    found = {(r.sku_id, r.eval_date): r.scale for r in metrics.sparse_scale(sales, lit("2024-01-01"), cutoffs).collect()}
    assert found == {k: pytest.approx(v) for k, v in wanted.items()} and len(found) == 9 * 4


def test_smoothing_of_many_cutoffs_equals_each_alone(spark, noisy):
    _, full = noisy
    sparse = full.where("units_sold > 0").where("sku_id <> 'S1' OR date > '2024-03-01'")
    first = lit("2024-01-01")
    cutoffs = [lit(d) for d in ("2024-01-06", "2024-01-07", "2024-02-28", "2024-07-18")]
    together = models.smoothing_forecast(sparse, cutoffs, first).collect()
    alone = [r for c in cutoffs for r in models.smoothing_forecast(sparse, [c], first).collect()]
    assert sorted(together, key=str) == sorted(alone, key=str)
    # Six days are not enough, and a series counts from its first sale on.
    assert {(r.sku_id, str(r.eval_date)) for r in together} == {
        (f"S{i}", d) for i in range(5) for d in ("2024-01-07", "2024-02-28", "2024-07-18") if i != 1 or d > "2024-03"
    }


def test_models_of_many_cutoffs_equal_a_plain_fit(spark):
    from shortfall.operators import glm

    rng = np.random.default_rng(3)
    dates = days("2024-01-01", 120)
    data = []
    for i in range(8):
        for d in dates:
            x = rng.normal(size=2)
            own = [None if i == 7 else 0.3 * i, 0.2 * i - 0.1]
            data.append((i, d, float(rng.poisson(np.exp(0.5 * x[0] + 0.1 * i))), float(rng.uniform(0.1, 1)), x.tolist(), own))
    schema = "sku_id bigint, date date, label double, weight double, features array<double>, own array<double>"
    frame = spark.createDataFrame(data, schema).repartition(3)
    cutoffs, window = [day("2024-03-01"), day("2024-04-20")], 50
    found = glm.fit(frame, cutoffs, window)
    for k, cut in enumerate(cutoffs):
        rows = [r for r in data if cut - datetime.timedelta(window) < r[1] <= cut and r[5][k] is not None]
        x = np.array([[1, *r[4], r[5][k]] for r in rows])
        y, w = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        mean = y + 0.5
        for _ in range(60):
            weight = w * mean**0.8
            line = np.log(mean) + (y - mean) / mean
            gram = (x * weight[:, None]).T @ x
            hold = 1e-3 * gram[0, 0] * np.diag([0, 1, 1, 1])
            model = np.linalg.solve(gram + hold, (x * weight[:, None]).T @ line)
            mean = np.exp(x @ model)
        assert found[k] == pytest.approx(model, abs=1e-5)
    ahead = glm.predict(frame, found, cutoffs, 28).collect()
    assert len(ahead) == 7 * 28 + 8 * 9
    assert all(0 < (r.date - r.eval_date).days <= 28 for r in ahead)


@pytest.fixture(scope="module")
def shop(spark):
    random.seed(9)
    dates = days("2023-01-02", 500)
    rows = [(i, d, random.randint(1, 6 + i)) for i in range(5) for n, d in enumerate(dates) if random.random() < 0.5 and (i < 4 or n > 300)]
    quotes = [(i, d, 1.0 + i + random.random()) for i in range(5) for d in dates[::7]]
    calendar = [(d, "Fair" if d.day == 3 else None, d.weekday() >= 5) for d in days("2023-01-02", 600)]
    return (
        spark.createDataFrame(rows, "sku_id bigint, date date, units_sold bigint"),
        spark.createDataFrame(quotes, "sku_id bigint, week_start date, sell_price double"),
        spark.createDataFrame(calendar, "date date, event_name string, is_weekend boolean"),
        dates,
    )


@pytest.mark.parametrize("model", ["seasonal_naive", "smoothing", "tweedie"])
def test_no_row_after_a_cutoff_is_used(spark, shop, model):
    sales, prices, calendar, dates = shop
    cutoffs = [F.lit(dates[-60]), F.lit(dates[-32])]
    first, last = F.lit(dates[0]), F.lit(dates[-1])

    def forecast(rows, quotes):
        if model == "seasonal_naive":
            found = fc.seasonal_naive(rows, cutoffs)
        elif model == "smoothing":
            found = models.smoothing_forecast(rows, cutoffs, first)
        else:
            found = models.tweedie_arrays(rows, first, last, calendar, quotes, cutoffs=cutoffs)
        return {(r.eval_date, r.sku_id): r.yhat for r in found.collect()}

    plain = forecast(sales, prices)
    assert {k[0] for k in plain} == {dates[-60], dates[-32]} and len(plain) == 10
    later = F.col("date") > cutoffs[1]
    # Later rows change or come anew, a week that is still open at the cutoff changes its price.
    changed = sales.withColumn("units_sold", F.when(later, F.col("units_sold") * 50).otherwise(F.col("units_sold")))
    changed = changed.unionByName(spark.createDataFrame([(99, dates[-10], 7)], sales.schema))
    open_week = F.date_add("week_start", 6) > cutoffs[1]
    raised = prices.withColumn("sell_price", F.when(open_week, F.col("sell_price") * 9).otherwise(F.col("sell_price")))
    assert forecast(changed, raised) == {k: pytest.approx(v, rel=1e-6) for k, v in plain.items()}


def test_risk_takes_any_model(small):
    for model in ("seasonal_naive", "smoothing", "tweedie"):
        rows = small.risk_at(small.past_cutoffs[:2], model).groupBy("eval_date").count().collect()
        assert len(rows) == 2 and all(r["count"] > 0 for r in rows)
    with pytest.raises(ValueError):
        small.forecast_at(small.now, "oracle")
