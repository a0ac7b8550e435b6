"""Reshaping, joins, aggregates, windows, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortfall.functions.dates import HORIZON, week_start
from shortfall.functions.numbers import round_to
from shortfall.operators import diagnose, evidence, quality, report, shape
from shortfall.operators import forecast as fc
from shortfall.operators import risk as rk
from shortfall.oracle.ctes import RISK_LIST, level_counts, rnd
from shortfall.plans.registry import query
from shortfall.sources.tables import PlanningTables


def day_columns(p: PlanningTables) -> list[str]:
    """d_1 ... d_n, one for every day from the first sale to T."""
    count = p.spark.range(1).select(F.datediff(p.today, p.first_day) + 1).first()[0]
    return [f"d_{i}" for i in range(1, count + 1)]


def wide_days(p: PlanningTables) -> DataFrame:
    """Sales with one column per day, d_1 the first. A SKU has at most one entry a calendar day."""
    entry = F.struct((F.datediff("date", p.first_day) + 1).alias("n"), "units_sold")
    by_day = p.sales.groupBy("sku_id").agg(F.sort_array(F.collect_list(entry)).alias("sold"))
    names = day_columns(p)
    zero = F.lit(0).cast("bigint")

    # One pass over the entries: each one follows its own empty days, so no day is looked up.
    def with_gap(entry, at):
        before = F.coalesce(F.get("sold", at - 1)["n"], F.lit(0))
        return F.concat(F.array_repeat(zero, entry["n"] - before - 1), F.array(F.coalesce(entry["units_sold"], zero)))

    last = F.element_at("sold", -1)["n"]
    filled = F.concat(F.flatten(F.transform("sold", with_gap)), F.array_repeat(zero, F.lit(len(names)) - last))
    return by_day.select("sku_id", filled.alias("days")).selectExpr(
        "sku_id", *(f"days[{i}] AS {name}" for i, name in enumerate(names))
    )


# -- reshaping ---------------------------------------------------------------------------


@query("unpivot_days", "SELECT sku_id, date, units_sold FROM sales_daily")
def unpivot_days(p):
    names = day_columns(p)
    long = shape.unpivot_columns(wide_days(p), ["sku_id"], names, "d", "units_sold")
    day = F.date_add(p.first_day, F.substring("d", 3, 10).cast("int") - 1)
    return long.select("sku_id", day.alias("date"), "units_sold")


@query(
    "forecast_wide",
    """SELECT coalesce(h.sku_id, f.sku_id) AS sku_id, coalesce(h.date, f.date) AS date,
       h.units_sold AS history, f.seasonal_naive, f.smoothing
       FROM (SELECT s.* FROM sales_daily s, bounds WHERE date > t - 90) h
       FULL JOIN (SELECT sku_id, date, max(yhat) FILTER (WHERE model_name = 'seasonal_naive') AS seasonal_naive,
           max(yhat) FILTER (WHERE model_name = 'smoothing') AS smoothing FROM published_forecasts GROUP BY sku_id, date) f
       ON f.sku_id = h.sku_id AND f.date = h.date""",
)
def forecast_wide(p):
    return shape.pivot_models(p.published_forecasts, p.recent_daily(90), ["seasonal_naive", "smoothing"])


@query("calendar_events", "SELECT date, event_name FROM calendar WHERE event_name IS NOT NULL")
def calendar_events(p):
    return p.calendar.where(F.col("event_name").isNotNull()).select("date", "event_name")


@query(
    "calendar_flags",
    """SELECT d.date, (isodow(d.date) - 1)::INTEGER AS day_of_week, (isodow(d.date) >= 6)::INTEGER AS is_weekend,
       (k.event_name IS NOT NULL)::INTEGER AS has_event FROM calendar d
       LEFT JOIN (SELECT c.* FROM calendar c, bounds WHERE date <= t) k ON k.date = d.date""",
)
def calendar_flags(p):
    # Days after T are missing from the calendar here and take the derived weekend flag.
    return shape.calendar_flags(p.day_spine, p.calendar.where(F.col("date") <= p.today))


@query("panel_dense", "SELECT * FROM sales_daily")
def panel_dense(p):
    return p.sales_daily


@query(
    "week_buckets",
    """SELECT date_trunc('week', date)::DATE AS week_start, min(date) AS first_date, count(*) AS sku_days,
       sum(units_sold)::BIGINT AS units_sold FROM sales GROUP BY 1""",
)
def week_buckets(p):
    return p.sales.groupBy(week_start(F.col("date")).alias("week_start")).agg(
        F.min("date").alias("first_date"),
        F.count(F.lit(1)).alias("sku_days"),
        F.sum("units_sold").alias("units_sold"),
    )


@query(
    "risk_latest",
    f"SELECT {RISK_LIST} FROM risk_history WHERE eval_date = (SELECT max(eval_date) FROM risk_history)",
)
def risk_latest(p):
    return report.latest_snapshot(p.snapshots_at(p.now))


SEARCH_COLUMNS = "material_pn, material_name, commodity, item_group, risk_level, doi_days, gap_qty, gap_date"
SEVERITY = "CASE risk_level WHEN 'RED' THEN 1 WHEN 'ORANGE' THEN 2 WHEN 'YELLOW' THEN 3 ELSE 4 END"


@query(
    "risk_search",
    f"""SELECT {SEARCH_COLUMNS} FROM material_risk JOIN materials USING (material_pn)
        WHERE risk_level = 'RED' AND (material_pn::VARCHAR ILIKE '%widget%' OR material_name ILIKE '%widget%')
        ORDER BY {SEVERITY}, gap_qty DESC, material_pn LIMIT 100""",
)
def risk_search(p):
    found = report.search(p.material_risk, p.materials, level="RED", text="WIDGET", limit=100)
    return found.select(*SEARCH_COLUMNS.split(", "))


@query(
    "recent_sales_top",
    """SELECT sku_id, sum(units_sold)::BIGINT AS units_sold FROM sales, bounds WHERE date > t - 14
       GROUP BY sku_id ORDER BY 2 DESC, 1 LIMIT 5""",
)
def recent_sales_top(p):
    recent = p.sales.where(F.col("date") > F.date_sub(p.today, 14))
    return (
        recent.groupBy("sku_id").agg(F.sum("units_sold").alias("units_sold"))
        .orderBy(F.desc("units_sold"), "sku_id").limit(5)
    )


@query(
    "filter_semi",
    """SELECT material_pn, material_name, commodity FROM materials WHERE commodity IN ('PROMO', 'LARGE')
       AND starts_with(material_name, 'red') AND material_pn IN (SELECT material_pn FROM open_po)""",
)
def filter_semi(p):
    kept = p.materials.where(
        F.col("commodity").isin("PROMO", "LARGE") & F.col("material_name").startswith("red")
    )
    return kept.join(p.open_po, "material_pn", "left_semi").select(
        "material_pn", "material_name", "commodity"
    )


@query(
    "forecast_union",
    """SELECT sku_id, date, model_name, yhat FROM published_forecasts UNION ALL
       SELECT sku_id, date, 'actual', units_sold::DOUBLE FROM sales_daily, bounds WHERE date > t - 28""",
)
def forecast_union(p):
    actual = p.recent_daily(HORIZON).select(
        "sku_id", "date", F.lit("actual").alias("model_name"),
        F.col("units_sold").cast("double").alias("yhat"),
    )
    return p.published_forecasts.drop("eval_date").unionByName(actual)


# -- joins -------------------------------------------------------------------------------


@query(
    "join_inner_dim",
    "SELECT po_id, material_pn, supplier_id, supplier_name, region, qty, eta_date FROM open_po JOIN suppliers USING (supplier_id)",
)
def join_inner_dim(p):
    return p.open_po.join(p.suppliers, "supplier_id").select(
        "po_id", "material_pn", "supplier_id", "supplier_name", "region", "qty", "eta_date"
    )


@query(
    "join_left_default",
    """SELECT m.material_pn, coalesce(s.min_lt, 0) AS min_lt, coalesce(o.qty, 0)::BIGINT AS open_qty
       FROM materials m LEFT JOIN profile s USING (material_pn)
       LEFT JOIN (SELECT material_pn, sum(qty) AS qty FROM open_po GROUP BY material_pn) o USING (material_pn)""",
)
def join_left_default(p):
    coming = p.open_po.groupBy("material_pn").agg(F.sum("qty").alias("qty"))
    return (
        p.materials.join(p.profile, "material_pn", "left").join(coming, "material_pn", "left")
        .select(
            "material_pn", F.coalesce("min_lt", F.lit(0)).alias("min_lt"),
            F.coalesce("qty", F.lit(0)).alias("open_qty"),
        )
    )


@query(
    "fk_orphans",
    "SELECT o_orderkey AS orphan FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def fk_orphans(p):
    return quality.orphans(p.read("orders"), "o_orderkey", p.read("lineitem"), "l_orderkey")


@query(
    "report_missing_dates",
    "SELECT DISTINCT eval_date FROM risk_history WHERE weekofyear(eval_date) % 2 = 1",
)
def report_missing_dates(p):
    # Reports exist for the even weeks.
    reports = p.snapshots.select("eval_date").where(F.weekofyear("eval_date") % 2 == 0).distinct()
    return report.missing_dates(p.snapshots, reports)


@query(
    "join_semi_known",
    """SELECT po_id, material_pn, qty FROM open_po WHERE material_pn IN (
       SELECT material_pn FROM bom GROUP BY material_pn HAVING count(DISTINCT sku_id) > 1)""",
)
def join_semi_known(p):
    shared = p.bom.groupBy("material_pn").agg(F.count_distinct("sku_id").alias("n")).where("n > 1")
    return p.open_po.join(shared, "material_pn", "left_semi").select("po_id", "material_pn", "qty")


@query(
    "cross_scalar_totals",
    """SELECT sku_id, sum(yhat) AS forecast_units, (SELECT sum(yhat) FROM forecast_daily) AS all_forecast_units,
       (SELECT sum(units_sold)::BIGINT FROM sales, bounds WHERE date > t - 28) AS recent_units
       FROM forecast_daily GROUP BY sku_id""",
)
def cross_scalar_totals(p):
    total = F.aggregate("yhat", F.lit(0.0), lambda a, v: a + v)
    by_sku = p.forecast.select("sku_id", total.alias("forecast_units"))
    recent = p.sales.where(F.col("date") > F.date_sub(p.today, 28)).agg(F.sum("units_sold"))
    return by_sku.select(
        "sku_id", "forecast_units",
        by_sku.agg(F.sum("forecast_units")).scalar().alias("all_forecast_units"),
        recent.scalar().alias("recent_units"),
    )


ASOF_SQL = """SELECT d.sku_id, d.date, p.sell_price FROM sales_daily d
    ASOF LEFT JOIN prices p ON p.sku_id = d.sku_id AND p.week_start <= d.date"""


@query("asof_price", ASOF_SQL)
def asof_price(p):
    return shape.asof_price(p.sales_daily.select("sku_id", "date"), p.prices, backfill=False)


@query(
    "asof_price_bfill",
    f"""SELECT sku_id, date, coalesce(sell_price, first_value(sell_price IGNORE NULLS) OVER (
        PARTITION BY sku_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sell_price
        FROM ({ASOF_SQL})""",
)
def asof_price_bfill(p):
    return shape.asof_price(p.sales_daily.select("sku_id", "date"), p.prices)


@query("material_demand_daily", "SELECT material_pn, date, demand_qty FROM material_demand")
def material_demand_daily(p):
    return rk.demand_rows(p.material_demand).drop("eval_date")


@query(
    "affected_skus_single_source",
    """SELECT DISTINCT sku_id FROM material_risk JOIN profile USING (material_pn) JOIN bom USING (material_pn)
       WHERE risk_level = 'RED' AND supplier_count = 1""",
)
def affected_skus_single_source(p):
    single = p.risk_detail.where("risk_level = 'RED' AND supplier_count = 1")
    return single.join(p.bom, "material_pn").select("sku_id").distinct()


@query(
    "join_checked",
    "SELECT sku_id, count(*) AS n FROM prices GROUP BY sku_id HAVING count(*) > 1",
)
def join_checked(p):
    """The keys that break a many-to-one promise of the prices."""
    return quality.duplicate_keys(p.prices, ["sku_id"])


@query(
    "join_many_to_one",
    "SELECT r.sku_id, week_start, sell_price, product_name, product_family FROM prices r JOIN products USING (sku_id)",
)
def join_many_to_one(p):
    """Every price with its product; a second row of a product would end the query."""
    return quality.checked_join(p.prices, p.products, ["sku_id"])


# -- aggregates --------------------------------------------------------------------------


@query(
    "agg_basic",
    """SELECT sku_id, count(*) AS days, sum(units_sold)::BIGINT AS total, avg(units_sold) AS mean,
       min(units_sold) AS lowest, max(units_sold) AS highest FROM sales GROUP BY sku_id""",
)
def agg_basic(p):
    units = "units_sold"
    return p.sales.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum(units).alias("total"), F.avg(units).alias("mean"),
        F.min(units).alias("lowest"), F.max(units).alias("highest"),
    )


@query(
    "supply_profile",
    "SELECT material_pn, min_lt, supplier_concentration, supplier_count, primary_supplier_id FROM profile",
)
def supply_profile(p):
    return p.profile


@query("single_source", "SELECT material_pn FROM supply_split GROUP BY material_pn HAVING count(*) = 1")
def single_source(p):
    return p.profile.where("supplier_count = 1").select("material_pn")


@query(
    "shared_materials",
    "SELECT material_pn, count(DISTINCT sku_id) AS sku_count FROM bom GROUP BY material_pn HAVING count(DISTINCT sku_id) > 1",
)
def shared_materials(p):
    return p.bom.groupBy("material_pn").agg(
        F.count_distinct("sku_id").alias("sku_count")
    ).where("sku_count > 1")


@query("weekly_median_price", "SELECT sku_id, week_start, sell_price FROM prices")
def weekly_median_price(p):
    return p.prices


@query(
    "shared_ratio",
    f"""SELECT commodity, {rnd("count(*) FILTER (WHERE n > 1) * 100.0 / count(*)", 2)} AS shared_pct FROM (
        SELECT material_pn, count(DISTINCT sku_id) AS n FROM bom GROUP BY material_pn)
        JOIN materials USING (material_pn) GROUP BY commodity""",
)
def shared_ratio(p):
    usage = p.bom.groupBy("material_pn").agg(F.count_distinct("sku_id").alias("n"))
    return usage.join(p.materials, "material_pn").groupBy("commodity").agg(
        round_to(F.count_if(F.col("n") > 1) * 100.0 / F.count(F.lit(1)), 2).alias("shared_pct")
    )


@query(
    "earliest_gap_ties",
    """SELECT material_pn, gap_date, gap_qty FROM material_risk
       WHERE gap_date = (SELECT min(gap_date) FROM material_risk)""",
)
def earliest_gap_ties(p):
    earliest = p.stored_risk.agg(F.min("gap_date")).scalar()
    return p.stored_risk.where(F.col("gap_date") == earliest).select(
        "material_pn", "gap_date", "gap_qty"
    )


@query(
    "most_shared_ties",
    """SELECT material_pn, n AS sku_count FROM (SELECT material_pn, count(DISTINCT sku_id) AS n FROM bom
       GROUP BY material_pn) QUALIFY rank() OVER (ORDER BY n DESC) = 1""",
)
def most_shared_ties(p):
    usage = p.bom.groupBy("material_pn").agg(F.count_distinct("sku_id").alias("sku_count"))
    return usage.where(F.col("sku_count") == usage.agg(F.max("sku_count")).scalar())


@query(
    "risk_level_counts",
    """SELECT l.risk_level, count(r.material_pn) AS materials FROM (VALUES ('RED'), ('ORANGE'), ('YELLOW'),
       ('GREEN')) l(risk_level) LEFT JOIN material_risk r USING (risk_level) GROUP BY l.risk_level""",
)
def risk_level_counts(p):
    return report.level_distribution(p.material_risk)


@query(
    "dim_date",
    """SELECT date, year(date)::INTEGER AS year, month(date)::INTEGER AS month,
       weekofyear(date)::INTEGER AS week_of_year, date = (SELECT t FROM bounds) AS is_current
       FROM (SELECT DISTINCT eval_date AS date FROM risk_history)""",
)
def dim_date(p):
    return report.date_dimension(p.snapshots)


@query(
    "weekly_complete",
    """SELECT sku_id, week_start, CASE WHEN count(history) = 7 THEN sum(history)::BIGINT END AS history,
       CASE WHEN count(seasonal_naive) = 7 THEN sum(seasonal_naive) END AS seasonal_naive FROM (
       SELECT sku_id, date_trunc('week', date)::DATE AS week_start, h.units_sold AS history, f.yhat AS seasonal_naive
       FROM (SELECT s.* FROM sales_daily s, bounds WHERE date > t - 90) h
       FULL JOIN forecast_daily f USING (sku_id, date))
       GROUP BY sku_id, week_start HAVING count(*) = 7""",
)
def weekly_complete(p):
    wide = shape.pivot_models(p.forecast_daily, p.recent_daily(90), ["seasonal_naive"])
    return shape.complete_weeks(wide, ["sku_id"], ["history", "seasonal_naive"])


@query(
    "risk_rollup",
    f"""SELECT eval_date, commodity, item_group, {level_counts()}, sum(gap_qty)::BIGINT AS total_gap_qty
        FROM material_risk JOIN materials USING (material_pn)
        GROUP BY GROUPING SETS ((eval_date, commodity), (eval_date, item_group))""",
)
def risk_rollup(p):
    return rk.risk_rollup(p.material_risk, p.materials)


# -- windows -----------------------------------------------------------------------------


@query("latest_inventory", "SELECT eval_date, material_pn, snapshot_date, qty_onhand FROM latest_inventory")
def latest_inventory(p):
    return rk.latest_inventory(p.inventory_onhand, p.now)


@query(
    "latest_price",
    "SELECT sku_id, week_start, sell_price FROM prices QUALIFY row_number() OVER (PARTITION BY sku_id ORDER BY week_start DESC) = 1",
)
def latest_price(p):
    return shape.latest_per_key(p.prices, ["sku_id"], "week_start", p.today)


def lag_sql(lags=shape.LAGS) -> str:
    over = "OVER (PARTITION BY sku_id ORDER BY date)"
    plain = [f"lag(units_sold, {n}) {over}::DOUBLE AS lag_{n}" for n in lags if n != 364]
    yearly = f"coalesce(lag(units_sold, 364) {over}, lag(units_sold, 56) {over})::DOUBLE AS lag_364"
    return ", ".join([*plain, yearly])


def rolling_sql() -> str:
    def one(days: int, function: str, name: str) -> str:
        frame = f"OVER (PARTITION BY sku_id ORDER BY date ROWS BETWEEN {27 + days} PRECEDING AND 28 PRECEDING)"
        return (
            f"CASE WHEN count(units_sold) {frame} = {days} THEN {function}(units_sold::DOUBLE) {frame} END AS {name}"
        )

    return ", ".join(
        [one(7, "avg", "rolling_mean_7"), one(28, "avg", "rolling_mean_28"), one(28, "stddev_pop", "rolling_std_28")]
    )


@query("lag_features", f"SELECT sku_id, date, units_sold, {lag_sql()} FROM sales_daily")
def lag_features(p):
    return shape.lag_features(p.sales_daily)


@query(
    "rolling_features",
    f"""SELECT sku_id, date, units_sold, {rnd("rolling_mean_7", 6)} AS rolling_mean_7,
        {rnd("rolling_mean_28", 6)} AS rolling_mean_28, {rnd("rolling_std_28", 6)} AS rolling_std_28
        FROM (SELECT *, {rolling_sql()} FROM sales_daily)""",
)
def rolling_features(p):
    rolled = shape.rolling_features(p.sales_daily)
    names = ["rolling_mean_7", "rolling_mean_28", "rolling_std_28"]
    return rolled.select("sku_id", "date", "units_sold", *[round_to(F.col(n), 6).alias(n) for n in names])


@query(
    "projected_balance",
    """SELECT d.material_pn, d.date, d.demand_qty, coalesce(r.qty, 0)::DOUBLE AS receipt_qty,
       qty_onhand + sum(coalesce(r.qty, 0) - demand_qty) OVER (PARTITION BY d.material_pn ORDER BY d.date) AS balance
       FROM material_demand d JOIN latest_inventory i ON i.material_pn = d.material_pn
       LEFT JOIN (SELECT material_pn, eta_date, sum(qty) AS qty FROM open_po GROUP BY ALL) r
       ON r.material_pn = d.material_pn AND r.eta_date = d.date""",
)
def projected_balance(p):
    nothing = F.transform("demand", lambda _: F.lit(0.0))
    received = F.coalesce(F.col("receipts"), nothing)
    daily = (
        p.material_demand.join(rk.latest_inventory(p.inventory_onhand, p.now), ["eval_date", "material_pn"])
        .join(rk.receipts(p.open_po, p.now, running=False), ["eval_date", "material_pn"], "left")
        .select(
            "eval_date", "material_pn", "qty_onhand",
            F.posexplode(F.arrays_zip(F.col("demand"), received.alias("received"))).alias("pos", "d"),
        )
    )
    so_far = Window.partitionBy("material_pn").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return daily.select(
        "material_pn",
        F.date_add("eval_date", F.col("pos") + 1).alias("date"),
        F.col("d.demand").alias("demand_qty"),
        F.col("d.received").alias("receipt_qty"),
        (F.col("qty_onhand") + F.sum(F.col("d.received") - F.col("d.demand")).over(so_far)).alias("balance"),
    )


@query("sku_history_tail", "SELECT s.* FROM sales_daily s, bounds WHERE date > t - 90")
def sku_history_tail(p):
    """The last 90 days of every SKU, days without a sale as zero. Only these days are written out."""
    return p.recent_daily(90)


@query(
    "shared_demand_share",
    f"""SELECT material_pn, sku_id, demand_qty, sku_count, {rnd("CASE WHEN total = 0 THEN 0 ELSE demand_qty / total * 100 END", 6)}
        AS share_pct FROM (SELECT material_pn, sku_id, demand_qty, count(*) OVER (PARTITION BY material_pn) AS sku_count,
        sum(demand_qty) OVER (PARTITION BY material_pn) AS total FROM (
        SELECT material_pn, sku_id, sum(yhat * qty_per_unit) AS demand_qty FROM forecast_daily JOIN bom USING (sku_id)
        GROUP BY material_pn, sku_id))""",
)
def shared_demand_share(p):
    shares = diagnose.demand_shares(p.forecast, p.bom)
    return shares.withColumn("share_pct", round_to(F.col("share_pct"), 6))


@query(
    "risk_change",
    """SELECT eval_date, lag(eval_date) OVER w AS previous_date, red_count, orange_count,
       red_count - lag(red_count) OVER w AS red_change, orange_count - lag(orange_count) OVER w AS orange_change
       FROM (SELECT eval_date, count(*) FILTER (WHERE risk_level = 'RED') AS red_count,
       count(*) FILTER (WHERE risk_level = 'ORANGE') AS orange_count FROM risk_history GROUP BY eval_date)
       WINDOW w AS (ORDER BY eval_date)""",
)
def risk_change(p):
    return report.change(p.risk_history)


# -- order, top-k, sets ------------------------------------------------------------------


@query(
    "top_red_materials",
    """SELECT material_pn, material_name, doi_days, gap_qty, gap_date, risk_reasons,
       r.supplier_concentration, coalesce(p.min_lt, 0) AS min_lt, coalesce(p.primary_supplier_id, -1) AS primary_supplier_id
       FROM material_risk r JOIN materials USING (material_pn) LEFT JOIN profile p USING (material_pn)
       WHERE risk_level = 'RED' ORDER BY gap_qty DESC, material_pn LIMIT 10""",
)
def top_red_materials(p):
    return report.top_red(p.material_risk, p.materials, p.profile)


@query("risk_ranked", f"SELECT {RISK_LIST} FROM material_risk ORDER BY {SEVERITY}, gap_qty DESC, material_pn")
def risk_ranked(p):
    return report.ranked(p.material_risk)


@query("lowest_doi", "SELECT material_pn, doi_days FROM material_risk ORDER BY doi_days, material_pn LIMIT 5")
def lowest_doi(p):
    return p.material_risk.select("material_pn", "doi_days").orderBy("doi_days", "material_pn").limit(5)


@query(
    "highest_concentration",
    "SELECT material_pn, supplier_concentration FROM material_risk ORDER BY supplier_concentration DESC, material_pn LIMIT 10",
)
def highest_concentration(p):
    return (
        p.material_risk.select("material_pn", "supplier_concentration")
        .orderBy(F.desc("supplier_concentration"), "material_pn").limit(10)
    )


@query(
    "top_sku_restrict",
    """SELECT sku_id, week_start, sell_price FROM prices WHERE sku_id IN (SELECT sku_id FROM sales GROUP BY sku_id
       ORDER BY sum(units_sold) DESC, sku_id LIMIT 20)""",
)
def top_sku_restrict(p):
    best = shape.top_n_keys(p.sales, "sku_id", F.sum("units_sold"), 20)
    return p.prices.join(best, "sku_id", "left_semi")


@query(
    "top_contributors",
    """SELECT material_pn, sku_id, demand_qty, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY material_pn
       ORDER BY demand_qty DESC, sku_id) AS rank FROM (SELECT material_pn, sku_id, sum(yhat * qty_per_unit) AS demand_qty
       FROM forecast_daily JOIN bom USING (sku_id) GROUP BY material_pn, sku_id)) WHERE rank <= 3""",
)
def top_contributors(p):
    return rk.top_contributors(p.forecast, p.bom)


@query(
    "gap_with_open_po",
    """SELECT DISTINCT material_pn FROM material_risk JOIN open_po USING (material_pn)
       WHERE gap_qty > 0 AND eta_date > eval_date""",
)
def gap_with_open_po(p):
    short = p.material_risk.where("gap_qty > 0").select("material_pn", "eval_date")
    return (
        p.open_po.join(short, "material_pn").where("eta_date > eval_date")
        .select("material_pn").distinct()
    )


@query(
    "set_difference",
    "SELECT material_pn FROM materials EXCEPT SELECT material_pn FROM open_po",
)
def set_difference(p):
    return p.materials.select("material_pn").subtract(p.open_po.select("material_pn"))


@query(
    "resultset_compare",
    """SELECT count(*) FILTER (WHERE NOT hit) AS missing_values, count(*) AS expected_values FROM (
       SELECT e.commodity, e.value, EXISTS (SELECT 1 FROM actual a WHERE a.commodity = e.commodity
         AND (199 * e.value <= 200 * a.value AND 200 * a.value <= 201 * e.value)) AS hit FROM expected e)""",
    {
        "expected": "SELECT DISTINCT commodity, gap_qty::DOUBLE AS value FROM material_risk JOIN materials USING (material_pn)",
        "actual": """SELECT DISTINCT commodity, (gap_qty + material_pn % 3)::DOUBLE AS value FROM material_risk
            JOIN materials USING (material_pn)""",
    },
)
def resultset_compare(p):
    # The compared result is off by up to two units, which the tolerance forgives for large gaps.
    rows = p.material_risk.join(p.materials, "material_pn")
    expected = rows.select("commodity", F.col("gap_qty").cast("double").alias("value"))
    actual = rows.select(
        "commodity", (F.col("gap_qty") + F.col("material_pn") % 3).cast("double").alias("value")
    )
    missing = evidence.values_without_match(expected, actual, "commodity")
    wanted = expected.distinct()
    flagged = wanted.join(missing.withColumn("missing", F.lit(True)), ["commodity", "value"], "left")
    return flagged.agg(
        F.count_if(F.col("missing")).alias("missing_values"), F.count(F.lit(1)).alias("expected_values")
    )
