"""DuckDB definitions of the planning tables, for the side-by-side check.

`sql(body)` puts the common table expressions that `body` needs, directly or through others, in
front of it.
"""

from __future__ import annotations

import re

HORIZON = 28

# floor(x * 10^d + 0.5) / 10^d, as in functions.numbers.round_to
def rnd(expression: str, digits: int) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expression})::DOUBLE * {scale} + 0.5::DOUBLE) / {scale})"


RISK_LIST = (
    "material_pn, eval_date, doi_days, lt_coverage, supplier_concentration, gap_qty, gap_date, "
    "risk_level, risk_reasons"
)


def level_counts() -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE risk_level = '{level}') AS {level.lower()}_count"
        for level in ("RED", "ORANGE", "YELLOW", "GREEN")
    )


CTES: dict[str, str] = {
    "bounds": """SELECT (SELECT max(o_orderdate)::DATE FROM orders) AS t,
        (SELECT min(l_shipdate)::DATE FROM lineitem) AS d0""",
    "lines": """SELECT l_orderkey, l_linenumber, l_partkey AS material_pn, l_partkey // 20 AS sku_id,
        l_suppkey % 10 AS supplier_id, l_quantity::BIGINT AS quantity, l_extendedprice,
        l_shipdate::DATE AS date, t, d0 FROM lineitem, bounds""",
    "sales": """SELECT sku_id, date, sum(quantity)::BIGINT AS units_sold FROM lines
        WHERE date <= t GROUP BY sku_id, date""",
    "sales_daily": """SELECT s.sku_id, c.date, coalesce(x.units_sold, 0)::BIGINT AS units_sold
        FROM (SELECT DISTINCT sku_id FROM sales) s
        CROSS JOIN (SELECT unnest(generate_series(d0, t, INTERVAL 1 DAY))::DATE AS date FROM bounds) c
        LEFT JOIN sales x ON x.sku_id = s.sku_id AND x.date = c.date""",
    "event_peaks": """SELECT peak, min(event_type) AS name FROM (
        SELECT event_type, arg_max(dom, n * 100 - dom) AS peak FROM (
        SELECT event_type, day(ts) AS dom, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type) GROUP BY peak""",
    "raw_calendar": """SELECT date, coalesce(name, '') AS event_name_1,
        CASE WHEN day(date) = 1 AND month(date) % 3 = 1 THEN 'QuarterStart' ELSE '' END AS event_name_2
        FROM (SELECT unnest(generate_series(d0, t + 28, INTERVAL 1 DAY))::DATE AS date FROM bounds)
        LEFT JOIN event_peaks ON peak = day(date)""",
    "calendar": """SELECT date, dayname(date) AS weekday,
        CASE WHEN event_name_1 <> '' AND event_name_2 <> '' THEN event_name_1 || ';' || event_name_2
             ELSE coalesce(nullif(event_name_1, ''), nullif(event_name_2, '')) END AS event_name,
        isodow(date) >= 6 AS is_weekend FROM raw_calendar""",
    "price_rows": """SELECT sku_id, date_trunc('week', date)::DATE AS week_start,
        (2 * round(l_extendedprice * 100)::BIGINT + quantity) // (2 * quantity) AS cents
        FROM lines WHERE date <= t""",
    "prices": """SELECT sku_id, week_start, ((lo + hi + 1) // 2) / 100.0::DOUBLE AS sell_price FROM (
        SELECT sku_id, week_start, quantile_disc(cents, 0.5) AS lo,
        list_sort(list(cents))[(count(*) // 2 + 1)::BIGINT] AS hi
        FROM price_rows GROUP BY sku_id, week_start)""",
    "materials": """SELECT p_partkey AS material_pn, p_name AS material_name, p_type AS commodity,
        p_type || '-' || (p_size // 10)::VARCHAR AS item_group, p_retailprice AS unit_cost FROM part""",
    "products": """SELECT p_partkey // 20 AS sku_id, arg_min(p_name, p_partkey) AS product_name,
        'FAMILY-' || (p_partkey // 20 % 4)::VARCHAR AS product_family FROM part GROUP BY p_partkey // 20""",
    "bom": """SELECT p_partkey // 20 AS sku_id, p_partkey AS material_pn,
        (1 + p_partkey % 8)::DOUBLE / 16 AS qty_per_unit FROM part
        UNION ALL SELECT p_partkey // 20 + 1, p_partkey, (1 + p_partkey % 8)::DOUBLE / 16 FROM part
        WHERE p_partkey % 5 = 0 AND p_partkey + 20 IN (SELECT p_partkey FROM part)""",
    "suppliers": """SELECT supplier_id, s_name AS supplier_name, r_name AS region FROM (
        SELECT s_suppkey % 10 AS supplier_id, s_name, s_nationkey,
        row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey) AS rn FROM supplier)
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE rn = 1""",
    "split_points": """SELECT material_pn, supplier_id, rank, (10000 * q) // total AS points FROM (
        SELECT *, sum(q) OVER (PARTITION BY material_pn)::BIGINT AS total FROM (
          SELECT material_pn, supplier_id, q,
          row_number() OVER (PARTITION BY material_pn ORDER BY q DESC, supplier_id) AS rank FROM (
            SELECT material_pn, supplier_id, sum(quantity)::BIGINT AS q FROM lines
            GROUP BY material_pn, supplier_id)) WHERE rank <= 1 + material_pn % 3)""",
    "supply_split": """SELECT material_pn, supplier_id, CASE WHEN rank = 1 THEN 10000 -
        coalesce(sum(points) FILTER (WHERE rank > 1) OVER (PARTITION BY material_pn), 0)::BIGINT
        ELSE points END / 100.0::DOUBLE AS split_pct,
        7 + (material_pn * 7 + supplier_id * 13) % 84 AS lead_time_days,
        100 + (material_pn * 31 + supplier_id * 17) % 4900 AS moq FROM split_points""",
    "open_po": """SELECT 'PO-' || l_orderkey || '-' || l_linenumber || '-' || material_pn || '-' ||
        supplier_id || '-' || strftime(date, '%Y%m%d') AS po_id, material_pn, supplier_id,
        sum(quantity)::BIGINT AS qty, date AS eta_date FROM lines WHERE date > t
        GROUP BY l_orderkey, l_linenumber, material_pn, supplier_id, date""",
    "inventory_onhand": """SELECT material_pn, (t - 7 * k::INTEGER)::DATE AS snapshot_date,
        floor(base * (1 + (material_pn * 37 + k * 11) % 90) / (t - d0 + 1))::BIGINT AS qty_onhand
        FROM (SELECT material_pn, sum(units * qty_per_unit) AS base FROM
            (SELECT sku_id, sum(units_sold)::BIGINT AS units FROM sales GROUP BY sku_id)
            JOIN bom USING (sku_id) GROUP BY material_pn),
        bounds, (SELECT unnest(range(9))::BIGINT AS k)""",
    "cutoffs": "SELECT t AS eval_date FROM bounds",
    "past_cutoffs": "SELECT (t - 7 * k::INTEGER)::DATE AS eval_date FROM bounds, (SELECT unnest(range(1, 9)) AS k)",
    "all_cutoffs": "SELECT eval_date FROM cutoffs UNION ALL SELECT eval_date FROM past_cutoffs",
    "first_sales": "SELECT sku_id, min(date) AS first_sale FROM sales GROUP BY sku_id",
    "profile": """SELECT material_pn, min(lead_time_days) AS min_lt, max(split_pct) AS supplier_concentration,
        count(*) AS supplier_count, (list(supplier_id ORDER BY split_pct DESC, supplier_id))[1]
        AS primary_supplier_id FROM supply_split GROUP BY material_pn""",
}


def forecast_cte(cutoffs: str) -> str:
    return f"""SELECT c.eval_date, f.sku_id, 'seasonal_naive' AS model_name,
        (c.eval_date + h.h::INTEGER)::DATE AS date, coalesce(s.units_sold, 0)::DOUBLE AS yhat
        FROM first_sales f JOIN {cutoffs} c ON f.first_sale <= c.eval_date
        CROSS JOIN (SELECT unnest(range(1, 29)) AS h) h
        LEFT JOIN sales s ON s.sku_id = f.sku_id
          AND s.date = c.eval_date - 6 + ((h.h - 1) % 7)::INTEGER"""


def smoothing_ctes(cutoffs: str, prefix: str) -> dict[str, str]:
    """Weekly smoothing at every cutoff, to two decimals. Day by day over all series at once; the season
    is a list that is rotated to the current day."""
    head = "list_sum(v[1:7]) / 7"
    season = ", ".join(f"v[{i}] - {head}" for i in range(1, 8))
    return {
        f"{prefix}_series": f"""SELECT eval_date, sku_id, list(units_sold::DOUBLE ORDER BY date) AS v
            FROM sales_daily JOIN {cutoffs} ON date <= eval_date JOIN first_sales USING (sku_id)
            WHERE first_sale <= eval_date GROUP BY eval_date, sku_id""",
        f"{prefix}_state": f"""SELECT * FROM (WITH RECURSIVE state AS (
            SELECT eval_date, sku_id, 7 AS i, len(v) AS n, {head} AS level, [{season}] AS season FROM {prefix}_series
            UNION ALL SELECT eval_date, sku_id, i + 1, n, level_new, list_append(season[2:7],
                0.1::DOUBLE * (y - level_new) + (1 - 0.1::DOUBLE) * season[1]) FROM (
              SELECT s.eval_date, s.sku_id, i, n, season, v[i + 1] AS y,
                0.2::DOUBLE * (v[i + 1] - season[1]) + (1 - 0.2::DOUBLE) * level AS level_new
              FROM state s JOIN {prefix}_series r ON r.eval_date = s.eval_date AND r.sku_id = s.sku_id WHERE i < n))
            SELECT eval_date, sku_id, level, season FROM state WHERE i = n)""",
        f"{prefix}_smoothing": f"""SELECT eval_date, sku_id, 'smoothing' AS model_name, (eval_date + h::INTEGER)::DATE AS date,
            {rnd("greatest(level + season[(h - 1) % 7 + 1], 0)", 2)} AS yhat
            FROM {prefix}_state, (SELECT unnest(range(1, 29)) AS h)""",
    }


def demand_cte(forecast: str) -> str:
    return f"""SELECT f.eval_date, b.material_pn, f.date, sum(f.yhat * b.qty_per_unit) AS demand_qty
        FROM {forecast} f JOIN bom b USING (sku_id) GROUP BY f.eval_date, b.material_pn, f.date"""


def inventory_cte(cutoffs: str) -> str:
    return f"""SELECT eval_date, material_pn, snapshot_date, qty_onhand FROM (
        SELECT c.eval_date, i.*, row_number() OVER (PARTITION BY c.eval_date, material_pn
          ORDER BY snapshot_date DESC) AS rn FROM inventory_onhand i
        JOIN {cutoffs} c ON i.snapshot_date <= c.eval_date) WHERE rn = 1"""


def risk_cte(demand: str, inventory: str, cutoffs: str, orders: str = "open_po", key: str = "", digits: int | None = None) -> str:
    """Grading over (eval_date, material_pn[, key]); key is a column of the order table. With `digits`, demand
    to date is settled to so many decimals."""
    def settled(total: str) -> str:
        return total if digits is None else rnd(total, digits)

    extra = f", {key}" if key else ""
    po_key = f", o.{key}" if key else ""
    keyed = f"CROSS JOIN (SELECT DISTINCT {key} FROM {orders}) z" if key else ""
    key_on = f" AND r.{key} = z.{key}" if key else ""
    z_key = f", z.{key}" if key else ""
    return f"""SELECT r.*, CASE WHEN early THEN 'RED' WHEN later OR low_single THEN 'ORANGE'
          WHEN low OR concentrated THEN 'YELLOW' ELSE 'GREEN' END AS risk_level,
        concat_ws(';', CASE WHEN early THEN 'GAP_BEFORE_LT' END, CASE WHEN later THEN 'GAP_IN_HORIZON' END,
          CASE WHEN low_single THEN 'LOW_DOI_SINGLE_SOURCE' END, CASE WHEN low THEN 'LOW_DOI' END,
          CASE WHEN concentrated THEN 'HIGH_CONCENTRATION' END) AS risk_reasons FROM (
      SELECT *, gap_qty > 0 AND coalesce(gap_date - eval_date < min_lt, false) AS early,
        gap_qty > 0 AND NOT coalesce(gap_date - eval_date < min_lt, false) AS later,
        doi_days < 0.5::DOUBLE * min_lt AND supplier_count = 1 AS low_single, doi_days < min_lt AS low,
        supplier_concentration > 70 AND doi_days < 1.5::DOUBLE * min_lt AS concentrated,
        {rnd("doi_days / min_lt", 2)} AS lt_coverage FROM (
        SELECT b.eval_date, b.material_pn{extra}, gap_date, gap_qty, inventory_qty, min_lt,
          supplier_concentration, supplier_count, primary_supplier_id,
          CASE WHEN total = 0 THEN 999.0::DOUBLE ELSE {rnd("inventory_qty / (total / 28)", 1)} END AS doi_days
        FROM (SELECT eval_date, material_pn{extra}, any_value(qty_onhand) AS inventory_qty,
            {settled("sum(demand_qty)")} AS total, min(date) FILTER (WHERE balance < 0) AS gap_date,
            ceil(greatest(-min(balance), 0))::BIGINT AS gap_qty FROM (
            SELECT d.eval_date, d.material_pn{z_key}, d.date, d.demand_qty, i.qty_onhand,
              i.qty_onhand + sum(coalesce(r.qty, 0)) OVER days - {settled("sum(d.demand_qty) OVER days")} AS balance
            FROM {demand} d JOIN {inventory} i ON i.eval_date = d.eval_date AND i.material_pn = d.material_pn
            {keyed}
            LEFT JOIN (SELECT o.material_pn, o.eta_date{po_key}, c.eval_date, sum(o.qty)::DOUBLE AS qty
              FROM {orders} o JOIN {cutoffs} c ON o.eta_date > c.eval_date
              GROUP BY o.material_pn, o.eta_date{po_key}, c.eval_date) r
              ON r.eval_date = d.eval_date AND r.material_pn = d.material_pn AND r.eta_date = d.date{key_on}
            WINDOW days AS (PARTITION BY d.eval_date, d.material_pn{z_key} ORDER BY d.date))
          GROUP BY eval_date, material_pn{extra}) b JOIN profile USING (material_pn))) r"""


CTES["forecast_daily"] = forecast_cte("cutoffs")
CTES |= smoothing_ctes("cutoffs", "now")
CTES["published_forecasts"] = "SELECT * FROM forecast_daily UNION ALL SELECT * FROM now_smoothing"
CTES["material_demand"] = demand_cte("forecast_daily")
CTES["latest_inventory"] = inventory_cte("cutoffs")
CTES["risk_detail"] = risk_cte("material_demand", "latest_inventory", "cutoffs")
CTES["material_risk"] = f"SELECT {RISK_LIST} FROM risk_detail"
CTES["forecast_all"] = forecast_cte("all_cutoffs")
CTES["demand_all"] = demand_cte("forecast_all")
CTES["inventory_all"] = inventory_cte("all_cutoffs")
CTES["risk_all"] = risk_cte("demand_all", "inventory_all", "all_cutoffs")
CTES["risk_history"] = f"SELECT {RISK_LIST} FROM risk_all"
for _dimension in ("commodity", "item_group"):
    CTES[f"v_risk_by_{_dimension}"] = f"""SELECT eval_date, {_dimension}, {level_counts()},
        sum(gap_qty)::BIGINT AS total_gap_qty FROM material_risk JOIN materials USING (material_pn)
        GROUP BY eval_date, {_dimension}"""
CTES["v_risk_by_supplier"] = f"""SELECT eval_date, supplier_id, supplier_name,
    count(DISTINCT material_pn) FILTER (WHERE risk_level IN ('RED', 'ORANGE')) AS red_orange_material_count,
    {rnd("sum(CASE WHEN risk_level IN ('RED', 'ORANGE') THEN gap_qty * split_pct / 100 ELSE 0.0::DOUBLE END)", 4)}
    AS weighted_gap_qty FROM material_risk JOIN supply_split USING (material_pn)
    JOIN suppliers USING (supplier_id) GROUP BY eval_date, supplier_id, supplier_name"""


def needed(text: str, known: dict[str, str]) -> list[str]:
    """Names used by the text, dependencies first."""
    ordered: list[str] = []

    def visit(sql_text: str) -> None:
        for word in re.findall(r"[a-z_0-9]+", sql_text):
            if word in known and word not in ordered and known[word] is not sql_text:
                visit(known[word])
                if word not in ordered:
                    ordered.append(word)

    visit(text)
    return ordered


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    known = {**CTES, **(extra or {})}
    names = needed(body, known)
    if not names:
        return body
    parts = ",\n".join(f"{name} AS ({known[name]})" for name in names)
    return f"WITH {parts}\n{body}"
