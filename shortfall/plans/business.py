"""The question catalogue: one saved query per fixed business question.

Points of interest (a material, an SKU) are parameters of the questions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shortfall.functions.numbers import round_to
from shortfall.operators import report, shape
from shortfall.operators import risk as rk
from shortfall.oracle.ctes import rnd
from shortfall.plans.registry import query

MATERIAL = 3
SKU = 1
SHARED_MATERIAL = 20
COMMODITY = "PROMO"
MODEL = "seasonal_naive"


def save(key: str, sql: str):
    return query(f"q_{key}", sql)


def red(p):
    return p.material_risk.where("risk_level = 'RED'")


def recent(p, days: int):
    return p.sales.where(F.col("date") > F.date_sub(p.today, days))


def recent_total(p, days: int = 28):
    return recent(p, days).agg(F.sum("units_sold")).scalar()


def top(frame, *order, n: int):
    return frame.orderBy(*order).limit(n)


def forecast_totals(p):
    units = F.aggregate("yhat", F.lit(0.0), lambda a, v: a + v)
    return p.forecast.select("sku_id", "model_name", units.alias("forecast_units"))


RED_SQL = "SELECT material_pn FROM material_risk JOIN materials USING (material_pn) WHERE risk_level = 'RED'"


@save("t01", RED_SQL)
def t01(p):
    return red(p).join(p.materials, "material_pn").select("material_pn")


@save("o01", "SELECT material_pn FROM material_risk WHERE risk_level = 'RED'")
def o01(p):
    return red(p).select("material_pn")


@save("t02", f"SELECT material_pn, risk_level, doi_days, gap_qty, gap_date, risk_reasons FROM material_risk WHERE material_pn = {MATERIAL}")
def t02(p):
    return p.material_risk.where(F.col("material_pn") == MATERIAL).select(
        "material_pn", "risk_level", "doi_days", "gap_qty", "gap_date", "risk_reasons"
    )


@save("t03", "SELECT material_pn FROM material_risk ORDER BY doi_days, material_pn LIMIT 5")
def t03(p):
    return top(p.material_risk, "doi_days", "material_pn", n=5).select("material_pn")


GAP_SQL = "SELECT material_pn FROM material_risk WHERE gap_qty > 0"


@save("t04", GAP_SQL)
def t04(p):
    return p.material_risk.where("gap_qty > 0").select("material_pn")


@save("o04", GAP_SQL)
def o04(p):
    return p.material_risk.where("gap_qty > 0").select("material_pn")


@save("t05", "SELECT material_pn, gap_date, gap_qty FROM material_risk WHERE gap_date = (SELECT min(gap_date) FROM material_risk)")
def t05(p):
    first = p.stored_risk.agg(F.min("gap_date")).scalar()
    return p.stored_risk.where(F.col("gap_date") == first).select("material_pn", "gap_date", "gap_qty")


@save("t06", "SELECT material_pn FROM supply_split GROUP BY material_pn HAVING count(*) = 1")
def t06(p):
    return p.profile.where("supplier_count = 1").select("material_pn")


@save("t07", "SELECT material_pn FROM material_risk ORDER BY supplier_concentration DESC, material_pn LIMIT 10")
def t07(p):
    return top(p.material_risk, F.desc("supplier_concentration"), "material_pn", n=10).select("material_pn")


@save("t08", "SELECT supplier_id FROM v_risk_by_supplier ORDER BY weighted_gap_qty DESC, supplier_id LIMIT 5")
def t08(p):
    return report.top_suppliers(p.risk_by_supplier, 5).select("supplier_id")


@save("o03", "SELECT supplier_id, supplier_name FROM v_risk_by_supplier ORDER BY weighted_gap_qty DESC, supplier_id LIMIT 3")
def o03(p):
    return report.top_suppliers(p.risk_by_supplier, 3).select("supplier_id", "supplier_name")


@save("o12", "SELECT supplier_name, red_orange_material_count, weighted_gap_qty FROM v_risk_by_supplier ORDER BY weighted_gap_qty DESC, supplier_id LIMIT 1")
def o12(p):
    return report.top_suppliers(p.risk_by_supplier, 1).select(
        "supplier_name", "red_orange_material_count", "weighted_gap_qty"
    )


@save(
    "t09",
    """SELECT * FROM (SELECT commodity, red_count AS commodity_red, total_gap_qty AS commodity_gap FROM v_risk_by_commodity ORDER BY commodity LIMIT 1)
       CROSS JOIN (SELECT item_group, red_count AS group_red, total_gap_qty AS group_gap FROM v_risk_by_item_group ORDER BY item_group LIMIT 1)""",
)
def t09(p):
    # The first commodity and the first item group side by side: two single rows.
    left = p.risk_by_commodity.agg(F.min_by(F.struct("commodity", "red_count", "total_gap_qty"), "commodity").alias("c"))
    right = p.risk_by_item_group.agg(F.min_by(F.struct("item_group", "red_count", "total_gap_qty"), "item_group"))
    return left.select("c", right.scalar().alias("i")).select(
        "c.commodity", F.col("c.red_count").alias("commodity_red"), F.col("c.total_gap_qty").alias("commodity_gap"),
        "i.item_group", F.col("i.red_count").alias("group_red"), F.col("i.total_gap_qty").alias("group_gap"),
    )


def usage(p):
    return p.bom.groupBy("material_pn").agg(F.count_distinct("sku_id").alias("sku_count"))


@save("t10", "SELECT material_pn FROM bom GROUP BY material_pn HAVING count(DISTINCT sku_id) > 1 ORDER BY count(DISTINCT sku_id) DESC, material_pn LIMIT 10")
def t10(p):
    return top(usage(p).where("sku_count > 1"), F.desc("sku_count"), "material_pn", n=10).select("material_pn")


@save("t11", f"SELECT material_pn FROM bom WHERE sku_id = {SKU}")
def t11(p):
    return p.bom.where(F.col("sku_id") == SKU).select("material_pn")


@save("t12", f"SELECT sku_id FROM bom WHERE material_pn = {SHARED_MATERIAL}")
def t12(p):
    return p.bom.where(F.col("material_pn") == SHARED_MATERIAL).select("sku_id")


@save("t13", "SELECT po_id, supplier_name FROM open_po JOIN suppliers USING (supplier_id), bounds WHERE eta_date > t ORDER BY qty DESC, po_id LIMIT 5")
def t13(p):
    largest = top(p.open_po.where(F.col("eta_date") > p.today), F.desc("qty"), "po_id", n=5)
    return largest.join(p.suppliers, "supplier_id").select("po_id", "supplier_name")


@save("t14", f"SELECT material_pn, snapshot_date, qty_onhand FROM latest_inventory WHERE material_pn = {MATERIAL}")
def t14(p):
    mine = p.inventory_onhand.where(F.col("material_pn") == MATERIAL)
    return shape.latest_per_key(mine, ["material_pn"], "snapshot_date")


@save("t15", f"SELECT sku_id, week_start, sell_price FROM prices WHERE sku_id = {SKU} ORDER BY week_start DESC LIMIT 1")
def t15(p):
    return top(p.prices.where(F.col("sku_id") == SKU), F.desc("week_start"), n=1)


@save("t16", "SELECT sku_id FROM sales, bounds WHERE date > t - 14 GROUP BY sku_id ORDER BY sum(units_sold) DESC, sku_id LIMIT 5")
def t16(p):
    return shape.top_n_keys(recent(p, 14), "sku_id", F.sum("units_sold"), 5).select("sku_id")


@save(
    "o06",
    """SELECT sku_id, product_name FROM sales JOIN products USING (sku_id), bounds WHERE date > t - 14 GROUP BY sku_id, product_name
       ORDER BY sum(units_sold) DESC, sku_id LIMIT 5""",
)
def o06(p):
    best = shape.top_n_keys(recent(p, 14), "sku_id", F.sum("units_sold"), 5)
    return best.join(p.products, "sku_id").select("sku_id", "product_name")


def events_by_units(p):
    # Daily totals first: the join then carries one row per day.
    daily = p.sales.groupBy("date").agg(F.sum("units_sold").alias("units"))
    named = p.calendar.where(F.col("event_name").isNotNull())
    return named.join(daily, "date").groupBy("event_name").agg(F.sum("units").alias("units"))


EVENT_SQL = "SELECT event_name FROM calendar JOIN sales USING (date) WHERE event_name IS NOT NULL GROUP BY event_name ORDER BY sum(units_sold) DESC, event_name"


@save("t17", f"{EVENT_SQL} LIMIT 5")
def t17(p):
    return top(events_by_units(p), F.desc("units"), "event_name", n=5).select("event_name")


@save("o17", f"{EVENT_SQL} LIMIT 1")
def o17(p):
    return top(events_by_units(p), F.desc("units"), "event_name", n=1).select("event_name")


@save(
    "t18",
    f"""SELECT sku_id, product_name, sum(yhat) AS forecast_units, (SELECT sum(units_sold)::BIGINT FROM sales, bounds WHERE date > t - 28) AS actual_units
        FROM forecast_daily JOIN products USING (sku_id) WHERE model_name = '{MODEL}' GROUP BY sku_id, product_name
        ORDER BY forecast_units DESC, sku_id LIMIT 5""",
)
def t18(p):
    best = top(forecast_totals(p).where(F.col("model_name") == MODEL), F.desc("forecast_units"), "sku_id", n=5)
    return best.join(p.products, "sku_id").select(
        "sku_id", "product_name", "forecast_units", recent_total(p).alias("actual_units")
    )


@save("o13", f"SELECT sku_id FROM forecast_daily JOIN products USING (sku_id) WHERE model_name = '{MODEL}' GROUP BY sku_id ORDER BY sum(yhat) DESC, sku_id LIMIT 3")
def o13(p):
    totals = forecast_totals(p).where(F.col("model_name") == MODEL)
    return top(totals, F.desc("forecast_units"), "sku_id", n=3).select("sku_id")


@save("o14", f"""SELECT (SELECT sum(yhat) FROM forecast_daily WHERE model_name = '{MODEL}') AS forecast_units,
    (SELECT sum(units_sold)::BIGINT FROM sales, bounds WHERE date > t - 28) AS actual_units""")
def o14(p):
    total = forecast_totals(p).where(F.col("model_name") == MODEL).agg(F.sum("forecast_units").alias("forecast_units"))
    return total.select("forecast_units", recent_total(p).alias("actual_units"))


@save("t20", "SELECT material_pn FROM material_demand JOIN materials USING (material_pn) GROUP BY material_pn ORDER BY sum(demand_qty) DESC, material_pn LIMIT 10")
def t20(p):
    total = F.aggregate("demand", F.lit(0.0), lambda a, v: a + v)
    demand = p.material_demand.join(p.materials, "material_pn", "left_semi").select("material_pn", total.alias("total"))
    return top(demand, F.desc("total"), "material_pn", n=10).select("material_pn")


@save("o02", f"SELECT commodity, red_count, orange_count, yellow_count, green_count, total_gap_qty FROM v_risk_by_commodity WHERE commodity = '{COMMODITY}'")
def o02(p):
    # The filter on the dimension reaches the part scan.
    return rk.risk_by_dimension(
        p.material_risk, p.materials.where(F.col("commodity") == COMMODITY), "commodity"
    ).drop("eval_date")


@save("o05", "SELECT DISTINCT sku_id FROM material_risk JOIN profile USING (material_pn) JOIN bom USING (material_pn) WHERE risk_level = 'RED' AND supplier_count = 1")
def o05(p):
    single = p.risk_detail.where("risk_level = 'RED' AND supplier_count = 1")
    return single.join(p.bom, "material_pn").select("sku_id").distinct()


@save("o07", "SELECT material_pn FROM material_risk WHERE gap_qty > 0 ORDER BY gap_date, gap_qty DESC, material_pn LIMIT 10")
def o07(p):
    return top(p.material_risk.where("gap_qty > 0"), "gap_date", F.desc("gap_qty"), "material_pn", n=10).select("material_pn")


@save("o08", "SELECT material_pn, gap_qty, doi_days, risk_reasons FROM material_risk ORDER BY gap_qty DESC, material_pn LIMIT 1")
def o08(p):
    return top(p.material_risk, F.desc("gap_qty"), "material_pn", n=1).select(
        "material_pn", "gap_qty", "doi_days", "risk_reasons"
    )


@save("o09", "SELECT commodity FROM v_risk_by_commodity ORDER BY red_count DESC, orange_count DESC, commodity LIMIT 1")
def o09(p):
    return top(p.risk_by_commodity, F.desc("red_count"), F.desc("orange_count"), "commodity", n=1).select("commodity")


@save("o10", "SELECT item_group FROM v_risk_by_item_group ORDER BY red_count DESC, orange_count DESC, item_group LIMIT 1")
def o10(p):
    return top(p.risk_by_item_group, F.desc("red_count"), F.desc("orange_count"), "item_group", n=1).select("item_group")


@save(
    "o11",
    """SELECT DISTINCT sku_id FROM bom WHERE material_pn IN (SELECT material_pn FROM bom GROUP BY material_pn
       HAVING count(DISTINCT sku_id) = (SELECT max(n) FROM (SELECT count(DISTINCT sku_id) AS n FROM bom GROUP BY material_pn)))""",
)
def o11(p):
    counts = usage(p)
    most = counts.where(F.col("sku_count") == counts.agg(F.max("sku_count")).scalar())
    return p.bom.join(most, "material_pn", "left_semi").select("sku_id").distinct()


@save("o15", "SELECT DISTINCT material_pn FROM material_risk JOIN open_po USING (material_pn) WHERE gap_qty > 0 AND eta_date > eval_date")
def o15(p):
    future = p.open_po.where(F.col("eta_date") > p.today)
    return p.material_risk.where("gap_qty > 0").join(future, "material_pn", "left_semi").select("material_pn")


@save("o16", "SELECT material_pn FROM material_risk WHERE supplier_concentration > 70 AND risk_level <> 'GREEN'")
def o16(p):
    return p.material_risk.where("supplier_concentration > 70 AND risk_level <> 'GREEN'").select("material_pn")


@save("o18", "SELECT sku_id FROM (SELECT sku_id, arg_max(sell_price, week_start) AS price FROM prices GROUP BY sku_id) ORDER BY price DESC, sku_id LIMIT 5")
def o18(p):
    newest = shape.latest_per_key(p.prices, ["sku_id"], "week_start")
    return top(newest, F.desc("sell_price"), "sku_id", n=5).select("sku_id")


@save("o20", """SELECT count(*) FILTER (WHERE risk_level = 'RED') AS red_count, count(*) FILTER (WHERE risk_level = 'ORANGE') AS orange_count,
    count(*) FILTER (WHERE risk_level = 'YELLOW') AS yellow_count, count(*) FILTER (WHERE risk_level = 'GREEN') AS green_count FROM material_risk""")
def o20(p):
    return p.material_risk.agg(*rk.level_counts())


@save("f01", "SELECT material_pn, material_name, doi_days, gap_qty, gap_date FROM material_risk JOIN materials USING (material_pn) WHERE risk_level = 'RED' ORDER BY gap_qty DESC")
def f01(p):
    return red(p).join(p.materials, "material_pn").select(
        "material_pn", "material_name", "doi_days", "gap_qty", "gap_date"
    ).orderBy(F.desc("gap_qty"), "material_pn")


@save("f02", "SELECT material_pn, doi_days, gap_qty, gap_date FROM material_risk ORDER BY doi_days, material_pn LIMIT 1")
def f02(p):
    return top(p.material_risk, "doi_days", "material_pn", n=1).select("material_pn", "doi_days", "gap_qty", "gap_date")


@save(
    "f03",
    """SELECT material_pn, max(split_pct) AS supplier_concentration, min(supplier_name) AS supplier_name FROM supply_split
       JOIN suppliers USING (supplier_id) GROUP BY material_pn HAVING count(*) = 1""",
)
def f03(p):
    single = p.profile.where("supplier_count = 1").withColumnRenamed("primary_supplier_id", "supplier_id")
    return single.join(p.suppliers, "supplier_id").select(
        "material_pn", "supplier_concentration", "supplier_name"
    ).orderBy(F.desc("supplier_concentration"), "material_pn")


@save("f04", "SELECT * FROM v_risk_by_commodity ORDER BY red_count DESC, orange_count DESC, commodity")
def f04(p):
    return p.risk_by_commodity.orderBy(F.desc("red_count"), F.desc("orange_count"), "commodity")


@save("f05", f"""SELECT model_name, {rnd("sum(yhat)", 2)} AS forecast_units, (SELECT sum(units_sold)::BIGINT FROM sales, bounds WHERE date > t - 28) AS actual_units
    FROM published_forecasts GROUP BY model_name""")
def f05(p):
    by_model = p.published_forecasts.groupBy("model_name").agg(round_to(F.sum("yhat"), 2).alias("forecast_units"))
    return by_model.select("model_name", "forecast_units", recent_total(p).alias("actual_units"))


@save(
    "f06",
    """SELECT supplier_id, supplier_name, count(*) AS po_count, sum(qty)::BIGINT AS open_qty FROM open_po JOIN suppliers USING (supplier_id), bounds
       WHERE eta_date > t GROUP BY supplier_id, supplier_name""",
)
def f06(p):
    by_supplier = p.open_po.where(F.col("eta_date") > p.today).groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("po_count"), F.sum("qty").alias("open_qty")
    )
    return by_supplier.join(p.suppliers, "supplier_id").select(
        "supplier_id", "supplier_name", "po_count", "open_qty"
    ).orderBy(F.desc("open_qty"))


@save(
    "f07",
    """SELECT material_pn, material_name, count(DISTINCT sku_id) AS sku_count FROM bom JOIN materials USING (material_pn)
       GROUP BY material_pn, material_name HAVING count(DISTINCT sku_id) > 1 ORDER BY sku_count DESC, material_pn LIMIT 20""",
)
def f07(p):
    best = top(usage(p).where("sku_count > 1"), F.desc("sku_count"), "material_pn", n=20)
    return best.join(p.materials, "material_pn").select("material_pn", "material_name", "sku_count")


@save(
    "f08",
    """SELECT r.material_pn, r.risk_level, b.sku_id, product_name, qty_per_unit FROM material_risk r JOIN bom b USING (material_pn)
       JOIN products USING (sku_id) WHERE risk_level IN ('RED', 'ORANGE') ORDER BY CASE risk_level WHEN 'RED' THEN 1 ELSE 2 END,
       gap_qty DESC, r.material_pn, b.sku_id LIMIT 20""",
)
def f08(p):
    hot = p.material_risk.where(F.col("risk_level").isin("RED", "ORANGE"))
    pairs = hot.join(p.bom, "material_pn")
    first = top(pairs, rk.level_rank(F.col("risk_level")), F.desc("gap_qty"), "material_pn", "sku_id", n=20)
    return first.join(p.products, "sku_id").select("material_pn", "risk_level", "sku_id", "product_name", "qty_per_unit")


@save("f09", "SELECT material_pn, lt_coverage, doi_days, risk_level FROM material_risk ORDER BY lt_coverage, material_pn LIMIT 5")
def f09(p):
    return top(p.material_risk, "lt_coverage", "material_pn", n=5).select(
        "material_pn", "lt_coverage", "doi_days", "risk_level"
    )
