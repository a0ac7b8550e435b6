"""Forecast, accuracy, risk, scenario, report, export and diagnosis queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.functions.dates import HORIZON
from shortfall.functions.numbers import round_to
from shortfall.operators import diagnose, metrics, quality, report, scenario, shape
from shortfall.operators import forecast as fc
from shortfall.operators import models
from shortfall.operators import risk as rk
from shortfall.oracle.ctes import (
    CTES,
    RISK_LIST,
    demand_cte,
    forecast_cte,
    inventory_cte,
    level_counts,
    risk_cte,
    rnd,
    smoothing_ctes,
)
from shortfall.plans.registry import query
from shortfall.plans.tables import SEVERITY, lag_sql, rolling_sql
from shortfall.sources.tables import DEMAND_DIGITS

OUTAGE_DAYS = 14

# -- source builds -----------------------------------------------------------------------


@query("build_sales_daily", "SELECT sku_id, date, units_sold FROM sales_daily")
def build_sales_daily(p):
    return p.sales_daily.select("sku_id", "date", "units_sold")


@query("build_calendar", "SELECT date, weekday, event_name, is_weekend FROM calendar")
def build_calendar(p):
    return p.calendar


@query("build_prices", "SELECT sku_id, week_start, sell_price FROM prices")
def build_prices(p):
    return p.prices


@query(
    "avg_material_demand",
    """SELECT material_pn, sum(units * qty_per_unit) / (SELECT t - d0 + 1 FROM bounds) AS avg_demand FROM (
       SELECT sku_id, sum(units_sold)::BIGINT AS units FROM sales GROUP BY sku_id) JOIN bom USING (sku_id)
       GROUP BY material_pn""",
)
def avg_material_demand(p):
    units = p.sales.groupBy("sku_id").agg(F.sum("units_sold").alias("units"))
    days = F.datediff(p.today, p.first_day) + 1
    total = units.join(p.bom, "sku_id").groupBy("material_pn").agg(
        F.sum(F.col("units") * F.col("qty_per_unit")).alias("total")
    )
    return total.select("material_pn", (F.col("total") / days).alias("avg_demand"))


# -- forecasting -------------------------------------------------------------------------

FOLDS = {
    "folds": "SELECT (4 - k)::INTEGER AS fold, (t - 28 * k::INTEGER)::DATE AS eval_date FROM bounds, (SELECT unnest(range(1, 4)) AS k)",
    "naive_folds": forecast_cte("folds"),
    **smoothing_ctes("folds", "fold"),
    "fold_forecast": "SELECT * FROM naive_folds UNION ALL SELECT * FROM fold_smoothing",
    "scored": """SELECT f.eval_date, f.sku_id, f.model_name, f.date, f.yhat, s.units_sold
        FROM fold_forecast f JOIN sales_daily s ON s.sku_id = f.sku_id AND s.date = f.date""",
    "errors": """SELECT eval_date, model_name,
        avg(CASE WHEN units_sold > 0 THEN abs(units_sold - yhat) / units_sold END) * 100 AS mape,
        sum(abs(units_sold - yhat)) / sum(units_sold) * 100 AS wmape FROM scored GROUP BY eval_date, model_name""",
    "changes": """SELECT sku_id, date, ((units_sold - lag(units_sold) OVER (PARTITION BY sku_id ORDER BY date)) ** 2)::DOUBLE
        AS sq FROM sales_daily""",
    "scales": """SELECT sku_id, eval_date, avg(sq) AS scale FROM changes JOIN folds ON date <= eval_date
        GROUP BY sku_id, eval_date""",
    "revenue_rows": """SELECT f.eval_date, s.sku_id, s.date, s.units_sold, p.sell_price FROM sales_daily s
        JOIN folds f ON s.date > f.eval_date - 28 AND s.date <= f.eval_date
        ASOF LEFT JOIN prices p ON p.sku_id = s.sku_id AND p.week_start <= s.date""",
    "revenue": """SELECT sku_id, eval_date, sum(units_sold * coalesce(price, 0)) AS revenue FROM (
        SELECT *, coalesce(sell_price, first_value(sell_price IGNORE NULLS) OVER (PARTITION BY sku_id, eval_date
          ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM revenue_rows)
        GROUP BY sku_id, eval_date""",
    "scaled": """SELECT eval_date, model_name, CASE WHEN sum(revenue) > 0 THEN sum(rmsse * revenue) / sum(revenue)
        ELSE avg(rmsse) END AS wrmsse FROM (
        SELECT m.eval_date, m.model_name, sqrt(m.mse / s.scale) AS rmsse, coalesce(r.revenue, 0) AS revenue FROM (
          SELECT eval_date, model_name, sku_id, avg((units_sold - yhat) ** 2) AS mse FROM scored GROUP BY ALL) m
        JOIN scales s ON s.sku_id = m.sku_id AND s.eval_date = m.eval_date AND s.scale > 0
        LEFT JOIN revenue r ON r.sku_id = m.sku_id AND r.eval_date = m.eval_date) GROUP BY eval_date, model_name""",
}
FOLDS["scorecard"] = "SELECT * FROM errors JOIN scaled USING (eval_date, model_name) JOIN folds USING (eval_date)"


def folds_of(p):
    return fc.backtest_cutoffs(p.today)


def fold_forecasts(p) -> DataFrame:
    """Daily forecasts of both models in the three folds."""
    return p.published_at(folds_of(p))


def before_folds(p) -> DataFrame:
    """The days that the three folds test, and the 28 before the first of them."""
    return p.recent_daily(4 * HORIZON)


def scales(p) -> DataFrame:
    return metrics.sparse_scale(p.sales, p.first_day, folds_of(p))


def scored(p) -> DataFrame:
    # The three folds test the last 84 days.
    return metrics.scored_rows(p.recent_daily(3 * HORIZON), fold_forecasts(p), folds_of(p))


def with_fold(p, frame: DataFrame) -> DataFrame:
    return frame.withColumn("fold", fc.fold_number(F.col("eval_date"), p.today))


@query(
    "backtest_splits",
    """SELECT fold, eval_date, min(date) FILTER (WHERE date <= eval_date) AS train_start,
       max(date) FILTER (WHERE date <= eval_date) AS train_end,
       count(*) FILTER (WHERE date <= eval_date) AS train_rows,
       min(date) FILTER (WHERE date > eval_date AND date <= eval_date + 28) AS test_start,
       max(date) FILTER (WHERE date > eval_date AND date <= eval_date + 28) AS test_end,
       count(DISTINCT date) FILTER (WHERE date > eval_date AND date <= eval_date + 28) AS test_days,
       count(*) FILTER (WHERE date > eval_date AND date <= eval_date + 28) AS test_rows
       FROM sales_daily, folds GROUP BY fold, eval_date""",
    FOLDS,
)
def backtest_splits(p):
    return with_fold(p, fc.split_bounds(p.sales_daily, folds_of(p)))


@query("forecast_naive", "SELECT eval_date, sku_id, model_name, date, yhat FROM forecast_daily")
def forecast_naive(p):
    return p.forecast_daily


@query(
    "feature_panel",
    f"""SELECT sku_id, date, units_sold, {", ".join(f"lag_{n}" for n in shape.LAGS)},
        {rnd("rolling_mean_7", 6)} AS rolling_mean_7, {rnd("rolling_mean_28", 6)} AS rolling_mean_28,
        {rnd("rolling_std_28", 6)} AS rolling_std_28, day_of_week, is_weekend, has_event, sell_price FROM features""",
    {
        "panel": """SELECT sku_id, date, units_sold FROM sales_daily UNION ALL SELECT s.sku_id, h.date, NULL FROM (
            SELECT DISTINCT sku_id FROM sales) s CROSS JOIN (SELECT c.date FROM calendar c, bounds WHERE c.date > t) h""",
        "panel_features": f"SELECT *, {lag_sql()}, {rolling_sql()} FROM panel",
        "asof_panel": """SELECT d.sku_id, d.date, p.sell_price AS known FROM panel d
            ASOF LEFT JOIN prices p ON p.sku_id = d.sku_id AND p.week_start <= d.date""",
        "priced": """SELECT sku_id, date, coalesce(known, first_value(known IGNORE NULLS) OVER (PARTITION BY sku_id
            ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sell_price FROM asof_panel""",
        "features": """SELECT f.*, (isodow(f.date) - 1)::INTEGER AS day_of_week, c.is_weekend::INTEGER AS is_weekend,
            (c.event_name IS NOT NULL)::INTEGER AS has_event, p.sell_price FROM panel_features f
            JOIN calendar c ON c.date = f.date JOIN priced p ON p.sku_id = f.sku_id AND p.date = f.date
            WHERE lag_56 IS NOT NULL AND rolling_mean_28 IS NOT NULL""",
    },
)
def feature_panel(p):
    panel = models.feature_panel(p.sales, p.first_day, p.today, p.calendar, p.prices)
    rolled = ("rolling_mean_7", "rolling_mean_28", "rolling_std_28")
    return panel.select(
        *[round_to(F.col(c), 6).alias(c) if c in rolled else F.col(c) for c in panel.columns]
    )


@query(
    "sample_weights",
    "SELECT sku_id, date, CASE WHEN units_sold > 0 THEN 1 / sqrt(greatest(units_sold, 1)::DOUBLE) ELSE 0.05::DOUBLE END AS weight FROM sales_daily",
)
def sample_weights(p):
    return p.sales_daily.select("sku_id", "date", fc.sample_weight(F.col("units_sold")).alias("weight"))



@query("forecast_smoothing", "SELECT eval_date, sku_id, model_name, date, yhat FROM now_smoothing")
def forecast_smoothing(p):
    return p.published_forecasts.where("model_name = 'smoothing'")


@query("forecast_tweedie")
def forecast_tweedie(p):
    return models.tweedie_forecast(p.sales, p.first_day, p.today, p.calendar, p.prices)


# -- accuracy ----------------------------------------------------------------------------


@query("metric_mape", f"SELECT fold, model_name, {rnd('mape', 6)} AS mape FROM errors JOIN folds USING (eval_date)", FOLDS)
def metric_mape(p):
    errors = with_fold(p, metrics.error_metrics(scored(p), ["eval_date", "model_name"]))
    return errors.select("fold", "model_name", round_to(F.col("mape"), 6).alias("mape"))


@query("metric_wmape", f"SELECT fold, model_name, {rnd('wmape', 6)} AS wmape FROM errors JOIN folds USING (eval_date)", FOLDS)
def metric_wmape(p):
    errors = with_fold(p, metrics.error_metrics(scored(p), ["eval_date", "model_name"]))
    return errors.select("fold", "model_name", round_to(F.col("wmape"), 6).alias("wmape"))


@query("metric_wrmsse", f"SELECT fold, model_name, {rnd('wrmsse', 6)} AS wrmsse FROM scaled JOIN folds USING (eval_date)", FOLDS)
def metric_wrmsse(p):
    scaled = with_fold(p, metrics.wrmsse(scored(p), before_folds(p), p.prices, folds_of(p), scales(p)))
    return scaled.select("fold", "model_name", round_to(F.col("wrmsse"), 6).alias("wrmsse"))


def scorecard(p) -> DataFrame:
    card = metrics.scorecard(before_folds(p), fold_forecasts(p), p.prices, folds_of(p), scales(p))
    return with_fold(p, card)


def rounded3(prefix: str = "") -> str:
    return ", ".join(f"{rnd(prefix + m, 3)} AS {m}" for m in ("mape", "wmape", "wrmsse"))


@query("backtest_scorecard", f"SELECT model_name, fold, {rounded3()} FROM scorecard", FOLDS)
def backtest_scorecard(p):
    return metrics.rounded_metrics(scorecard(p)).drop("eval_date")


GAINS = ("mape", "wmape", "wrmsse")


@query(
    "model_improvement",
    f"""SELECT {", ".join(f"{rnd(f'c.{m}', 4)} AS candidate_{m}, {rnd(f'b.{m}', 4)} AS baseline_{m}, "
                          f"{rnd(f'(b.{m} - c.{m}) / b.{m} * 100', 4)} AS {m}_gain_pct" for m in GAINS)},
        {rnd("100 - c.wmape", 4)} AS forecast_accuracy_pct
        FROM (SELECT * FROM means WHERE model_name = 'smoothing') c
        CROSS JOIN (SELECT * FROM means WHERE model_name = 'seasonal_naive') b""",
    {**FOLDS, "means": "SELECT model_name, avg(mape) AS mape, avg(wmape) AS wmape, avg(wrmsse) AS wrmsse FROM scorecard GROUP BY model_name"},
)
def model_improvement(p):
    """Smoothing against the seasonal-naive forecast."""
    gains = metrics.improvement(scorecard(p), "smoothing", "seasonal_naive")
    names = [f"{role}_{m}" for m in GAINS for role in ("candidate", "baseline")]
    names += [f"{m}_gain_pct" for m in GAINS] + ["forecast_accuracy_pct"]
    return gains.select(*[round_to(F.col(n), 4).alias(n) for n in names])


# -- risk --------------------------------------------------------------------------------


@query("projected_shortage", "SELECT material_pn, eval_date, gap_date, gap_qty FROM risk_detail")
def projected_shortage(p):
    shortage = rk.projected_shortage(
        p.demand_to_date, rk.receipts(p.open_po, p.now), rk.latest_inventory(p.inventory_onhand, p.now)
    )
    return shortage.select("material_pn", "eval_date", "gap_date", "gap_qty")


@query("doi_coverage", "SELECT material_pn, inventory_qty, min_lt, doi_days, lt_coverage FROM risk_detail")
def doi_coverage(p):
    return p.risk_detail.select("material_pn", "inventory_qty", "min_lt", "doi_days", "lt_coverage")


@query("risk_classify", "SELECT risk_level, risk_reasons, count(*) AS materials FROM risk_detail GROUP BY risk_level, risk_reasons")
def risk_classify(p):
    return p.risk_detail.groupBy("risk_level", "risk_reasons").agg(F.count(F.lit(1)).alias("materials"))


@query("material_risk", f"SELECT {RISK_LIST} FROM material_risk")
def material_risk(p):
    return p.material_risk


@query("risk_kpi", f"SELECT eval_date, {level_counts()}, sum(gap_qty)::BIGINT AS total_gap_qty FROM material_risk GROUP BY eval_date")
def risk_kpi(p):
    return rk.snapshot_summary(p.material_risk)


@query("risk_by_commodity", "SELECT * FROM v_risk_by_commodity")
def risk_by_commodity(p):
    return p.risk_by_commodity


@query("risk_by_item_group", "SELECT * FROM v_risk_by_item_group")
def risk_by_item_group(p):
    return p.risk_by_item_group


@query("risk_by_supplier", "SELECT * FROM v_risk_by_supplier")
def risk_by_supplier(p):
    return p.risk_by_supplier


def reason_sql(code: str, text: str) -> str:
    return f"CASE WHEN list_contains(string_split(risk_reasons, ';'), '{code}') THEN {text} END"


GAP_TEXT, DOI_TEXT = "format('{:,}', gap_qty)", "printf('%.1f', doi_days)"
SHARE_TEXT = "round_even(supplier_concentration, 0)::INTEGER || '%'"
EXPLAIN_SQL = ", ".join(
    [
        reason_sql(
            "GAP_BEFORE_LT",
            f"'runs out on ' || gap_date || ', stock lasts ' || {DOI_TEXT} || ' days, shortest lead time ' || min_lt || ' days, too late to expedite, short by ' || {GAP_TEXT}",
        ),
        reason_sql(
            "GAP_IN_HORIZON",
            f"'short by ' || {GAP_TEXT} || ' from ' || gap_date || ', still reachable within the lead time of ' || min_lt || ' days'",
        ),
        reason_sql(
            "LOW_DOI_SINGLE_SOURCE",
            f"'single source ' || primary_supplier_id || ' holds ' || {SHARE_TEXT} || ', stock lasts ' || {DOI_TEXT} || ' days, under half the lead time'",
        ),
        reason_sql("LOW_DOI", f"'stock of ' || {DOI_TEXT} || ' days is under the lead time of ' || min_lt || ' days'"),
        reason_sql("HIGH_CONCENTRATION", f"'supplier share ' || {SHARE_TEXT} || ' with stock under 1.5 lead times'"),
        "CASE WHEN risk_reasons = '' THEN 'no shortage, stock or concentration rule matched' END",
        "'demand comes from SKUs ' || skus",
    ]
)


@query(
    "risk_explained",
    f"""SELECT material_pn, eval_date, risk_level, concat_ws('; ', {EXPLAIN_SQL}) AS explanation FROM risk_detail
        LEFT JOIN (SELECT material_pn, string_agg(sku_id::VARCHAR, ', ' ORDER BY demand_qty DESC, sku_id) AS skus FROM (
          SELECT material_pn, sku_id, sum(yhat * qty_per_unit) AS demand_qty FROM forecast_daily JOIN bom USING (sku_id)
          GROUP BY material_pn, sku_id QUALIFY row_number() OVER (PARTITION BY material_pn
            ORDER BY sum(yhat * qty_per_unit) DESC, sku_id) <= 3) GROUP BY material_pn) USING (material_pn)""",
)
def risk_explained(p):
    return rk.explain(p.risk_detail, rk.top_contributors(p.forecast, p.bom))


@query(
    "risk_backfill",
    f"SELECT {RISK_LIST} FROM risk_history WHERE eval_date < (SELECT t FROM bounds)",
)
def risk_backfill(p):
    return p.risk_at(p.past_cutoffs).select(*rk.RISK_COLUMNS)


@query(
    "risk_backfill_summary",
    f"""SELECT eval_date, {level_counts()}, sum(gap_qty)::BIGINT AS total_gap_qty FROM risk_history
        WHERE eval_date < (SELECT t FROM bounds) GROUP BY eval_date""",
)
def risk_backfill_summary(p):
    return rk.snapshot_summary(p.risk_at(p.past_cutoffs))


FITTED = {
    **smoothing_ctes("past_cutoffs", "past"),
    "fitted_demand": demand_cte("past_smoothing"),
    "fitted_inventory": inventory_cte("past_cutoffs"),
    "fitted_risk": risk_cte("fitted_demand", "fitted_inventory", "past_cutoffs", digits=DEMAND_DIGITS),
}


@query("risk_backfill_smoothing", f"SELECT {RISK_LIST} FROM fitted_risk", FITTED)
def risk_backfill_smoothing(p):
    """Past snapshots on the smoothing model, fitted at each cutoff on what was known then."""
    return p.risk_at(p.past_cutoffs, "smoothing").select(*rk.RISK_COLUMNS)


@query("risk_backfill_tweedie")
def risk_backfill_tweedie(p):
    """Past snapshots on the regression, fitted at each cutoff on what was known then."""
    return p.risk_at(p.past_cutoffs, "tweedie").select(*rk.RISK_COLUMNS)


@query(
    "risk_model_changes",
    f"""SELECT n.eval_date, n.risk_level AS naive_level, s.risk_level AS fitted_level, count(*) AS materials,
        sum(s.gap_qty - n.gap_qty)::BIGINT AS gap_delta FROM risk_history n
        JOIN fitted_risk s USING (eval_date, material_pn) GROUP BY ALL""",
    FITTED,
)
def risk_model_changes(p):
    """How levels and gaps of past snapshots differ between the naive and the smoothing model."""
    naive, fitted = (
        p.risk_at(p.past_cutoffs, model).select(
            "eval_date", "material_pn", F.col("risk_level").alias(f"{name}_level"), F.col("gap_qty").alias(f"{name}_gap")
        )
        for model, name in (("seasonal_naive", "naive"), ("smoothing", "fitted"))
    )
    both = naive.join(fitted, ["eval_date", "material_pn"])
    return both.groupBy("eval_date", "naive_level", "fitted_level").agg(
        F.count(F.lit(1)).alias("materials"), F.sum(F.col("fitted_gap") - F.col("naive_gap")).alias("gap_delta")
    )


# -- supplier outage ---------------------------------------------------------------------

OUTAGE = {
    "target": "SELECT supplier_id AS hit FROM open_po GROUP BY supplier_id ORDER BY sum(qty) DESC, supplier_id LIMIT 1",
    "versions": f"""SELECT 'baseline' AS scenario, po_id, material_pn, supplier_id, qty, eta_date FROM open_po
        UNION ALL SELECT 'scenario', po_id, material_pn, supplier_id, qty,
        CASE WHEN supplier_id = hit AND eta_date <= t + {OUTAGE_DAYS} THEN eta_date + {OUTAGE_DAYS} ELSE eta_date END
        FROM open_po, bounds, target""",
    "graded": risk_cte("material_demand", "latest_inventory", "cutoffs", "versions", "scenario"),
    "compared": f"""SELECT b.material_pn, b.risk_level AS risk_level_baseline, s.risk_level AS risk_level_scenario,
        b.gap_qty AS gap_qty_baseline, s.gap_qty AS gap_qty_scenario, s.gap_qty - b.gap_qty AS gap_delta,
        ({SEVERITY.replace("risk_level", "b.risk_level")} - {SEVERITY.replace("risk_level", "s.risk_level")})::INTEGER AS level_delta
        FROM (SELECT * FROM graded WHERE scenario = 'baseline') b
        JOIN (SELECT * FROM graded WHERE scenario = 'scenario') s USING (material_pn)""",
    "need": f"""SELECT f.sku_id, b.material_pn, b.qty_per_unit, c.gap_delta, sum(f.yhat) * b.qty_per_unit AS md
        FROM forecast_daily f JOIN bom b USING (sku_id) JOIN compared c USING (material_pn)
        WHERE c.gap_delta > 0 AND f.date <= f.eval_date + {OUTAGE_DAYS}
        GROUP BY f.sku_id, b.material_pn, b.qty_per_unit, c.gap_delta""",
    "bottleneck": """SELECT sku_id, max(gap_delta * md / total / qty_per_unit) AS affected FROM (
        SELECT *, sum(md) OVER (PARTITION BY material_pn) AS total FROM need) WHERE total > 0 GROUP BY sku_id""",
    "last_price": "SELECT sku_id, arg_max(sell_price, week_start) AS price FROM prices GROUP BY sku_id",
    "exposure": f"""SELECT sku_id, {rnd("affected", 2)} AS affected_units, {rnd("coalesce(price, 0)", 2)} AS unit_price,
        {rnd("affected * coalesce(price, 0)", 2)} AS exposure_amount FROM bottleneck LEFT JOIN last_price USING (sku_id)""",
}


def outage_target(p):
    """The supplier with the greatest open quantity."""
    by_supplier = p.open_po.groupBy("supplier_id").agg(F.sum("qty").alias("qty"))
    return by_supplier.agg(
        F.max_by("supplier_id", F.struct(F.col("qty"), -F.col("supplier_id")))
    ).scalar()


def outage(p) -> DataFrame:
    return scenario.compare(
        p.demand_to_date, p.open_po, rk.latest_inventory(p.inventory_onhand, p.now), p.profile,
        outage_target(p), p.today, OUTAGE_DAYS,
    )


@query(
    "scenario_orders",
    "SELECT material_pn, eta_date, sum(qty)::BIGINT AS qty FROM versions WHERE scenario = 'scenario' GROUP BY material_pn, eta_date",
    OUTAGE,
)
def scenario_orders(p):
    return scenario.scenario_orders(p.open_po, outage_target(p), p.today, OUTAGE_DAYS)


@query("scenario_compare", "SELECT * FROM compared", OUTAGE)
def scenario_compare(p):
    return outage(p)


@query(
    "scenario_worsened",
    """SELECT c.*, coalesce(s.split_pct, 0.0::DOUBLE) AS split_pct FROM compared c LEFT JOIN (
       SELECT material_pn, split_pct FROM supply_split, target WHERE supplier_id = hit) s USING (material_pn)
       WHERE gap_delta > 0 OR level_delta > 0""",
    OUTAGE,
)
def scenario_worsened(p):
    return scenario.worsened(outage(p), p.supply_split, outage_target(p))


def exposure(p, compared: DataFrame) -> DataFrame:
    return scenario.sku_exposure(compared, p.forecast, p.bom, p.prices, p.today, OUTAGE_DAYS)


@query("scenario_sku_exposure", "SELECT * FROM exposure", OUTAGE)
def scenario_sku_exposure(p):
    return exposure(p, outage(p))


@query(
    "scenario_summary",
    f"""SELECT count(*) FILTER (WHERE risk_level_baseline = 'RED') AS baseline_red_count,
        count(*) FILTER (WHERE risk_level_baseline = 'ORANGE') AS baseline_orange_count,
        count(*) FILTER (WHERE risk_level_scenario = 'RED' AND risk_level_baseline <> 'RED') AS new_red_count,
        count(*) FILTER (WHERE risk_level_scenario = 'ORANGE' AND risk_level_baseline IN ('GREEN', 'YELLOW')) AS new_orange_count,
        sum(gap_delta)::BIGINT AS total_gap_delta, (SELECT count(*) FROM exposure) AS affected_sku_count,
        {rnd("(SELECT coalesce(sum(exposure_amount), 0) FROM exposure)", 2)} AS exposure_amount FROM compared""",
    OUTAGE,
)
def scenario_summary(p):
    compared = p.stored(outage(p), "outage")
    return scenario.summary(compared, exposure(p, compared))


@query(
    "scenario_suppliers",
    "SELECT supplier_id, supplier_name, red_orange_material_count, weighted_gap_qty FROM v_risk_by_supplier",
)
def scenario_suppliers(p):
    return p.risk_by_supplier.drop("eval_date").orderBy(F.desc("weighted_gap_qty"), "supplier_id")


# -- report ------------------------------------------------------------------------------


@query(
    "report_kpi",
    f"""SELECT eval_date, {level_counts()}, sum(gap_qty)::BIGINT AS total_gap_qty,
        {rnd("count(*) FILTER (WHERE risk_level IN ('RED', 'ORANGE')) * 100 / count(*)", 2)} AS red_orange_pct
        FROM risk_history GROUP BY eval_date""",
)
def report_kpi(p):
    return report.kpi(p.risk_history)


@query(
    "supplier_exposure_top",
    """SELECT supplier_id, supplier_name, red_orange_material_count, weighted_gap_qty FROM v_risk_by_supplier
       ORDER BY weighted_gap_qty DESC, supplier_id LIMIT 5""",
)
def supplier_exposure_top(p):
    return report.top_suppliers(p.risk_by_supplier, 5).drop("eval_date")


@query("commodity_distribution", "SELECT * EXCLUDE (eval_date) FROM v_risk_by_commodity")
def commodity_distribution(p):
    return p.risk_by_commodity.drop("eval_date").orderBy(
        F.desc("red_count"), F.desc("orange_count"), "commodity"
    )


@query(
    "snapshot_availability",
    """SELECT min(eval_date) AS first_date, max(eval_date) AS last_date, count(*) FILTER (WHERE eval_date =
       (SELECT t - 14 FROM bounds)) AS rows_on_day FROM risk_history""",
)
def snapshot_availability(p):
    return report.availability(p.snapshots, F.date_sub(p.today, 14))


@query("list_skus", "SELECT sku_id, product_name, product_family FROM products ORDER BY sku_id")
def list_skus(p):
    return p.products.orderBy("sku_id")


@query("list_metrics", f"SELECT model_name, fold, {rounded3()} FROM scorecard ORDER BY model_name, fold", FOLDS)
def list_metrics(p):
    return metrics.rounded_metrics(scorecard(p)).drop("eval_date").orderBy("model_name", "fold")


@query("list_snapshots", "SELECT DISTINCT eval_date FROM risk_history ORDER BY eval_date DESC")
def list_snapshots(p):
    return p.snapshots.select("eval_date").distinct().orderBy(F.desc("eval_date"))


@query(
    "material_suppliers",
    "SELECT material_pn, supplier_id, supplier_name, split_pct, lead_time_days, moq FROM supply_split JOIN suppliers USING (supplier_id)",
)
def material_suppliers(p):
    return p.supply_split.join(p.suppliers, "supplier_id").select(
        "material_pn", "supplier_id", "supplier_name", "split_pct", "lead_time_days", "moq"
    )


@query(
    "material_open_pos",
    """SELECT material_pn, po_id, supplier_id, supplier_name, qty, eta_date FROM open_po JOIN suppliers USING (supplier_id)
       WHERE eta_date > (SELECT t FROM bounds)""",
)
def material_open_pos(p):
    return p.open_po.where(F.col("eta_date") > p.today).join(p.suppliers, "supplier_id").select(
        "material_pn", "po_id", "supplier_id", "supplier_name", "qty", "eta_date"
    )


# -- star schema -------------------------------------------------------------------------

FACT = "material_pn, eval_date, risk_level, doi_days, lt_coverage, supplier_concentration, gap_qty, gap_date"


@query("star_fact", f"SELECT {FACT} FROM risk_history")
def star_fact(p):
    return p.risk_history.select(*FACT.split(", "))


@query("star_dim_material", "SELECT material_pn, material_name, commodity, item_group, unit_cost FROM materials")
def star_dim_material(p):
    return p.materials


@query("star_dim_supplier", "SELECT supplier_id, supplier_name, region FROM suppliers")
def star_dim_supplier(p):
    return p.suppliers


@query("star_bridge", "SELECT material_pn, supplier_id, split_pct, lead_time_days, moq FROM supply_split")
def star_bridge(p):
    return p.supply_split


# -- diagnosis ---------------------------------------------------------------------------


@query(
    "po_timing_buckets",
    """SELECT material_pn, bucket, count(*) AS po_count, sum(qty)::BIGINT AS qty FROM (
       SELECT o.material_pn, o.qty, CASE WHEN eta_date <= coalesce(gap_date, t) THEN 'before_gap'
       WHEN eta_date <= t + 28 THEN 'within_horizon' ELSE 'outside_horizon' END AS bucket
       FROM open_po o JOIN material_risk r USING (material_pn), bounds WHERE eta_date > t) GROUP BY material_pn, bucket""",
)
def po_timing_buckets(p):
    return diagnose.bucket_totals(diagnose.order_buckets(p.open_po, p.material_risk, p.today))


CAUSE = {
    "causes": """SELECT r.material_pn, r.risk_level, r.gap_qty, r.inventory_qty, r.supplier_count, r.min_lt,
        coalesce(o.qty, 0)::BIGINT AS po_qty, coalesce(u.n, 0) AS sku_count,
        CASE WHEN r.supplier_count = 1 AND coalesce(o.qty, 0) > 0 THEN 'single_source_supply'
          WHEN coalesce(u.n, 0) > 1 THEN 'shared_demand_competition'
          WHEN r.min_lt > 28 AND coalesce(o.qty, 0) = 0 THEN 'long_leadtime_no_po' ELSE 'unknown' END AS category
        FROM risk_detail r LEFT JOIN (SELECT material_pn, sum(qty) AS qty FROM open_po GROUP BY material_pn) o USING (material_pn)
        LEFT JOIN (SELECT material_pn, count(DISTINCT sku_id) AS n FROM bom WHERE sku_id IN (SELECT sku_id FROM sales)
          GROUP BY material_pn) u USING (material_pn)""",
    # The planted labels follow the key alone, so they do not depend on the engine.
    "truth": """SELECT material_pn, CASE material_pn % 3 WHEN 0 THEN 'single_source_supply'
        WHEN 1 THEN 'shared_demand_competition' ELSE 'long_leadtime_no_po' END AS expected_category FROM materials""",
}


def causes(p) -> DataFrame:
    return diagnose.root_cause(p.risk_detail, p.open_po, diagnose.sku_counts(p.bom, p.forecast), p.today)


def truth(p) -> DataFrame:
    kind = F.col("material_pn") % 3
    return p.materials.select(
        "material_pn",
        F.when(kind == 0, "single_source_supply").when(kind == 1, "shared_demand_competition")
        .otherwise("long_leadtime_no_po").alias("expected_category"),
    )


@query("root_cause", "SELECT * FROM causes", CAUSE)
def root_cause(p):
    return causes(p)


@query(
    "root_cause_accuracy",
    f"""SELECT expected_category, count(*) AS scenarios, count(*) FILTER (WHERE category = expected_category) AS right_answers,
        {rnd("count(*) FILTER (WHERE category = expected_category) * 100 / count(*)", 4)} AS accuracy_pct
        FROM causes JOIN truth USING (material_pn) GROUP BY expected_category""",
    CAUSE,
)
def root_cause_accuracy(p):
    return diagnose.accuracy(causes(p), truth(p)).withColumn("accuracy_pct", round_to(F.col("accuracy_pct"), 4))


@query(
    "risk_detail",
    """SELECT material_pn, risk_level, doi_days, gap_qty, gap_date, supplier_count, min_lt, supplier_concentration,
       primary_supplier_id, qty_onhand, snapshot_date FROM risk_detail JOIN latest_inventory USING (material_pn)""",
)
def risk_detail(p):
    stock = rk.latest_inventory(p.inventory_onhand, p.now).drop("eval_date")
    return p.risk_detail.join(stock, "material_pn").select(
        "material_pn", "risk_level", "doi_days", "gap_qty", "gap_date", "supplier_count", "min_lt",
        "supplier_concentration", "primary_supplier_id", "qty_onhand", "snapshot_date",
    )


# -- quality -----------------------------------------------------------------------------

# Allowed row counts; the last one is out of range on purpose.
ROW_LIMITS = {
    "materials": (1, 10**12),
    "products": (1, 10**12),
    "bom": (1, 10**12),
    "suppliers": (1, 10),
    "supply_split": (1, 10**12),
    "open_po": (1, 10**12),
    "prices": (0, 10),
}


def table_map(p, names) -> dict[str, DataFrame]:
    return {name: getattr(p, name) for name in names}


@query(
    "dq_row_ranges",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, count(*) AS row_count, {lo}::BIGINT AS minimum, {hi}::BIGINT AS maximum,
            count(*) BETWEEN {lo} AND {hi} AS in_range FROM {n}"""
        for n, (lo, hi) in ROW_LIMITS.items()
    ),
)
def dq_row_ranges(p):
    return quality.row_ranges(table_map(p, ROW_LIMITS), ROW_LIMITS)


RELATIONS = (
    ("bom", "sku_id", "products", "sku_id"),
    ("bom", "material_pn", "materials", "material_pn"),
    ("supply_split", "material_pn", "materials", "material_pn"),
    ("supply_split", "supplier_id", "suppliers", "supplier_id"),
    ("open_po", "material_pn", "materials", "material_pn"),
    ("open_po", "supplier_id", "suppliers", "supplier_id"),
    ("materials", "material_pn", "open_po", "material_pn"),
)


@query(
    "dq_fk_report",
    " UNION ALL ".join(
        f"""SELECT '{c}.{k}' || CASE WHEN '{c}' = 'materials' THEN ' without orders' ELSE '' END AS relation,
            count(*) AS orphans FROM (SELECT DISTINCT {k} FROM {c} WHERE {k} NOT IN (SELECT {pk} FROM {t}))"""
        for c, k, t, pk in RELATIONS
    ),
)
def dq_fk_report(p):
    names = {r[0] for r in RELATIONS} | {r[2] for r in RELATIONS}
    found = quality.orphan_report(table_map(p, names), RELATIONS)
    label = F.when(
        F.col("relation") == "materials.material_pn", "materials.material_pn without orders"
    ).otherwise(F.col("relation"))
    return found.select(label.alias("relation"), "orphans")


@query(
    "dq_split_totals",
    """SELECT material_pn, round(sum(pct), 2) AS total_pct FROM (SELECT material_pn,
       CASE WHEN material_pn % 7 = 0 AND lead_time_days % 2 = 0 THEN split_pct - 10 ELSE split_pct END AS pct FROM supply_split)
       GROUP BY material_pn HAVING abs(round(sum(pct), 2) - 100) > 0.01""",
)
def dq_split_totals(p):
    # Some shares are spoiled, so that the check has something to find.
    spoiled = (F.col("material_pn") % 7 == 0) & (F.col("lead_time_days") % 2 == 0)
    shares = p.supply_split.withColumn(
        "split_pct", F.when(spoiled, F.col("split_pct") - 10).otherwise(F.col("split_pct"))
    )
    return quality.split_totals(shares)


@query(
    "dq_shared_ratio",
    """SELECT count(*) AS materials, count(*) FILTER (WHERE n > 1) AS shared, count(*) FILTER (WHERE n > 1) / count(*) AS ratio,
       count(*) FILTER (WHERE n > 1) / count(*) BETWEEN 0.15 AND 0.25 AS in_band FROM (
       SELECT material_pn, count(DISTINCT sku_id) AS n FROM bom GROUP BY material_pn)""",
)
def dq_shared_ratio(p):
    return quality.shared_ratio(p.bom)


@query(
    "dq_duplicates",
    """SELECT 'lineitem' AS table_name, count(*) FILTER (WHERE n > 1) AS duplicate_keys, sum(neg)::BIGINT AS negative_values FROM (
       SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity - 2 < 0) AS neg FROM lineitem GROUP BY l_orderkey, l_linenumber)
       UNION ALL SELECT 'sales', count(*) FILTER (WHERE n > 1), sum(neg)::BIGINT FROM (
       SELECT count(*) AS n, count(*) FILTER (WHERE units_sold < 0) AS neg FROM sales GROUP BY sku_id, date)""",
)
def dq_duplicates(p):
    # Two units are taken off the order lines, so single-unit lines count as negative.
    raw = p.read("lineitem").withColumn("l_quantity", F.col("l_quantity") - 2)
    return quality.duplicate_and_negative(
        {
            "lineitem": (raw, ["l_orderkey", "l_linenumber"], "l_quantity"),
            "sales": (p.sales, ["sku_id", "date"], "units_sold"),
        }
    )


CRITICAL = ["material_pn", "eval_date", "risk_level", "doi_days", "lt_coverage", "gap_qty", "gap_date"]


@query(
    "dq_nulls",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM material_risk" for c in CRITICAL
    ),
)
def dq_nulls(p):
    return quality.null_counts(p.material_risk, CRITICAL)


@query(
    "dq_date_gaps",
    """SELECT d.date FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE, (SELECT max(l_shipdate)::DATE FROM lineitem),
       INTERVAL 1 DAY))::DATE AS date FROM orders) d WHERE d.date NOT IN (SELECT o_orderdate::DATE FROM orders)""",
)
def dq_date_gaps(p):
    days = p.read("orders").select(F.col("o_orderdate").cast("date").alias("date"))
    first = days.agg(F.min("date")).scalar()
    last = p.read("lineitem").agg(F.max("l_shipdate").cast("date")).scalar()
    return quality.date_gaps(days, "date", first, last)


@query(
    "dq_missing_lookup",
    """SELECT material_pn, 'inventory' AS lookup FROM materials WHERE material_pn NOT IN (SELECT material_pn FROM latest_inventory)
       UNION ALL SELECT material_pn, 'profile' FROM materials WHERE material_pn NOT IN (SELECT material_pn FROM profile)
       UNION ALL SELECT material_pn, 'open_po' FROM materials WHERE material_pn NOT IN (SELECT material_pn FROM open_po)""",
)
def dq_missing_lookup(p):
    """Materials without a stock snapshot at T or a supply profile, which cannot be graded, and those
    without an open order."""
    lookups = {"inventory": rk.latest_inventory(p.inventory_onhand, p.now), "profile": p.profile, "open_po": p.open_po}
    found = [
        quality.missing_lookup(p.materials, lookup, "material_pn").withColumn("lookup", F.lit(name))
        for name, lookup in lookups.items()
    ]
    return reduce(DataFrame.unionByName, found)


DRIFT = {
    "now_metrics": "SELECT 'LEVEL_' || risk_level AS metric, count(*)::DOUBLE AS value FROM material_risk GROUP BY risk_level",
    "frozen": """SELECT 'LEVEL_' || risk_level AS metric, count(*)::DOUBLE AS value FROM risk_history
        WHERE eval_date = (SELECT t - 7 FROM bounds) GROUP BY risk_level
        UNION ALL SELECT 'TOTAL_GAP', sum(gap_qty)::DOUBLE FROM material_risk""",
}


@query(
    "metric_drift",
    """SELECT f.metric, f.value AS frozen, n.value AS recomputed, CASE WHEN n.value IS NULL THEN 'metric_missing'
       WHEN n.value <> f.value THEN 'metric_drift' ELSE 'ok' END AS status FROM frozen f LEFT JOIN now_metrics n USING (metric)""",
    DRIFT,
)
def metric_drift(p):
    def by_level(risk):
        return risk.groupBy(F.concat(F.lit("LEVEL_"), "risk_level").alias("metric")).agg(
            F.count(F.lit(1)).cast("double").alias("value")
        )

    # The snapshot of a week ago plays the frozen part; the total gap is never recomputed.
    kept = p.snapshots_at([F.date_sub(p.today, 7), p.today])
    week_ago, now = (kept.where(F.col("eval_date") == F.date_sub(p.today, n)) for n in (7, 0))
    total = now.agg(F.sum("gap_qty").cast("double").alias("value")).select(
        F.lit("TOTAL_GAP").alias("metric"), "value"
    )
    return quality.metric_drift(by_level(now), by_level(week_ago).unionByName(total), 3)


@query(
    "ground_truth_recall",
    """SELECT count(*) FILTER (WHERE listed) AS listed_materials,
       count(*) FILTER (WHERE listed AND risk_level IN ('RED', 'ORANGE') AND gap_qty > 0) AS recalled,
       count(*) FILTER (WHERE NOT listed AND risk_level = 'RED') AS other_red
       FROM (SELECT *, material_pn IN (SELECT material_pn FROM planted) AS listed FROM material_risk)""",
    {"planted": "SELECT material_pn FROM materials WHERE item_group LIKE '%-0'"},
)
def ground_truth_recall(p):
    planted = p.materials.where(F.col("item_group").endswith("-0"))
    return quality.truth_recall(p.material_risk, planted)


@query(
    "dq_composition",
    """SELECT coalesce(a.lang, e.lang) AS lang, coalesce(row_count, 0) AS row_count, coalesce(expected_count, 0) AS expected_count,
       coalesce(duplicate_ids, 0) AS duplicate_ids, coalesce(missing_fields, 0)::BIGINT AS missing_fields,
       coalesce(row_count, 0) = coalesce(expected_count, 0) AS as_expected FROM (
       SELECT lang, sum(n)::BIGINT AS row_count, count(*) FILTER (WHERE n > 1) AS duplicate_ids, sum(missing) AS missing_fields
       FROM (SELECT lang, doc_id, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR quality IS NULL) AS missing
         FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, doc_id) GROUP BY lang) a
       FULL JOIN (SELECT lang, count(*) AS expected_count FROM documents JOIN labels USING (doc_id) GROUP BY lang) e
       ON e.lang = a.lang""",
)
def dq_composition(p):
    labelled = p.read("documents").join(p.read("labels"), "doc_id", "left")
    expected = labelled.where(F.col("quality").isNotNull()).groupBy("lang").agg(
        F.count(F.lit(1)).alias("expected_count")
    )
    return quality.composition(labelled, "lang", "doc_id", ["text", "quality"], expected)


# -- model questions of the catalogue -------------------------------------------------------

BEST_SQL = """SELECT {0} FROM (SELECT model_name, avg(mape) AS m, avg(wrmsse) AS w FROM scorecard GROUP BY model_name)
    ORDER BY m, model_name LIMIT 1"""


def best_model(p) -> DataFrame:
    return metrics.model_means(scorecard(p)).orderBy("mape", "model_name").limit(1)


@query("q_t19", BEST_SQL.format(f"model_name, {rnd('m', 4)} AS avg_mape, {rnd('w', 4)} AS avg_wrmsse"), FOLDS)
def q_t19(p):
    return best_model(p).select(
        "model_name", round_to(F.col("mape"), 4).alias("avg_mape"), round_to(F.col("wrmsse"), 4).alias("avg_wrmsse")
    )


@query("q_o19", BEST_SQL.format("model_name"), FOLDS)
def q_o19(p):
    return best_model(p).select("model_name")
