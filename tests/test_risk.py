from __future__ import annotations

import itertools
import math
import random

import pytest
from conftest import day, days
from pyspark.sql import functions as F

from shortfall.operators import diagnose, report
from shortfall.operators import forecast as fc
from shortfall.operators import risk as rk
from shortfall.operators import scenario

T = "2024-01-01"


def cutoffs(text=T):
    return [F.lit(day(text))]


def arrays(spark, per_material):
    """Demand to date from {pn: {day index: quantity}}."""
    data = [
        (day(T), pn, list(itertools.accumulate(float(v.get(i, 0)) for i in range(28))))
        for pn, v in per_material.items()
    ]
    return spark.createDataFrame(data, "eval_date date, material_pn string, demand_upto array<double>")


def inventory(spark, stock):
    return spark.createDataFrame(
        [(pn, day(T), q) for pn, q in stock.items()],
        "material_pn string, snapshot_date date, qty_onhand bigint",
    )


def orders(spark, data):
    return spark.createDataFrame(
        [(f"PO{i}", pn, sup, q, day(d)) for i, (pn, sup, q, d) in enumerate(data)],
        "po_id string, material_pn string, supplier_id bigint, qty bigint, eta_date date",
    )


def test_bom_explosion_and_contributors(spark):
    daily = spark.createDataFrame(
        [(day(T), "SKU-A", "m", day("2024-01-02"), 10.0), (day(T), "SKU-B", "m", day("2024-01-02"), 4.0),
         (day(T), "SKU-A", "other", day("2024-01-02"), 999.0)],
        "eval_date date, sku_id string, model_name string, date date, yhat double",
    )
    bom = spark.createDataFrame(
        [("SKU-A", "PN", 2.0), ("SKU-B", "PN", 1.0)], "sku_id string, material_pn string, qty_per_unit double"
    )
    forecast = fc.horizon_arrays(daily).where("model_name = 'm'")
    demand = rk.demand_rows(rk.explode_bom(forecast, bom)).where("demand_qty > 0").collect()
    assert [(r.material_pn, r.date, r.demand_qty) for r in demand] == [("PN", day("2024-01-02"), 24.0)]
    best = rk.top_contributors(forecast, bom, 2).orderBy("rank").collect()
    assert [(r.sku_id, r.demand_qty) for r in best] == [("SKU-A", 20.0), ("SKU-B", 4.0)]


def test_receipts_land_before_demand(spark):
    demand = arrays(spark, {"PN": {0: 10, 1: 10, 2: 10}})
    received = rk.receipts(orders(spark, [("PN", 1, 5, "2024-01-03")]), cutoffs())
    stock = rk.latest_inventory(inventory(spark, {"PN": 15}), cutoffs())
    got = rk.projected_shortage(demand, received, stock).first()
    assert (got.gap_date, got.gap_qty) == (day("2024-01-04"), 10)


def test_shortage_against_a_plain_loop(spark):
    random.seed(7)
    stock, demand, due, expected = {}, {}, [], {}
    for i in range(60):
        pn = f"PN{i}"
        stock[pn] = random.randint(-5 if i % 10 == 0 else 0, 60)
        demand[pn] = {d: random.randint(0, 9) / 4 for d in range(28) if random.random() < 0.6}
        arrivals = [random.randint(-3, 40) for _ in range(random.randint(0, 4))]
        due += [(pn, 1, 5, str(days(T, 60)[a] if a >= 0 else day("2023-12-30"))) for a in arrivals]
        balance, lowest, first = float(stock[pn]), 0.0, None
        for d in range(28):
            balance += 5 * sum(1 for a in arrivals if a == d + 1) - demand[pn].get(d, 0)
            if balance < 0 and first is None:
                first = days(T, 29)[d + 1]
            lowest = min(lowest, balance)
        expected[pn] = (first, math.ceil(-lowest))
    got = rk.projected_shortage(
        arrays(spark, demand),
        rk.receipts(orders(spark, due), cutoffs()),
        rk.latest_inventory(inventory(spark, stock), cutoffs()),
    ).collect()
    assert {r.material_pn: (r.gap_date, r.gap_qty) for r in got} == expected


CASES = [
    ("2024-01-03", 10, 20.0, 3, 2, 60.0, "RED", "GAP_BEFORE_LT"),
    ("2024-01-06", 10, 20.0, 3, 2, 60.0, "ORANGE", "GAP_IN_HORIZON"),
    (None, 0, 4.0, 10, 1, 100.0, "ORANGE", "LOW_DOI_SINGLE_SOURCE;LOW_DOI;HIGH_CONCENTRATION"),
    (None, 0, 9.0, 10, 2, 50.0, "YELLOW", "LOW_DOI"),
    (None, 0, 12.0, 10, 2, 80.0, "YELLOW", "HIGH_CONCENTRATION"),
    (None, 0, 20.0, 10, 2, 60.0, "GREEN", ""),
]


def test_classification_paths(spark):
    data = [(i, day(T), None if c[0] is None else day(c[0]), *c[1:6]) for i, c in enumerate(CASES)]
    frame = spark.createDataFrame(
        data,
        "n int, eval_date date, gap_date date, gap_qty bigint, doi_days double, min_lt bigint, "
        "supplier_count bigint, supplier_concentration double",
    )
    got = rk.classify(frame).orderBy("n").collect()
    assert [(r.risk_level, r.risk_reasons) for r in got] == [c[6:] for c in CASES]


def test_no_demand_sentinel(spark):
    split = spark.createDataFrame(
        [("PN", 1, 50.0, 10, 1), ("PN", 2, 50.0, 12, 1)],
        "material_pn string, supplier_id bigint, split_pct double, lead_time_days bigint, moq bigint",
    )
    got = rk.assess(
        arrays(spark, {"PN": {}}), rk.receipts(orders(spark, [("PN", 1, 5, "2023-12-31")]), cutoffs()),
        rk.latest_inventory(inventory(spark, {"PN": 10}), cutoffs()), rk.supply_profile(split),
    ).first()
    assert (got.doi_days, got.risk_level, got.risk_reasons) == (999.0, "GREEN", "")
    assert got.primary_supplier_id == 1  # equal shares go to the smaller id


def test_snapshots_are_independent_of_each_other(small):
    """One cutoff alone gives the same rows as among nine cutoffs."""
    alone = small.risk_at([small.past_cutoffs[3]]).select(*rk.RISK_COLUMNS)
    together = small.risk_history.where(F.col("eval_date") == small.past_cutoffs[3])
    assert alone.exceptAll(together).count() == 0 and together.exceptAll(alone).count() == 0


def test_views_add_up_to_the_base_table(small):
    total = small.material_risk.agg(F.sum("gap_qty"), F.count(F.lit(1))).first()
    for dimension in ("commodity", "item_group"):
        by = rk.risk_by_dimension(small.material_risk, small.materials, dimension)
        counted = sum((F.col(f"{level.lower()}_count") for level in rk.LEVELS), F.lit(0))
        assert tuple(by.agg(F.sum("total_gap_qty"), F.sum(counted)).first()) == tuple(total)


@pytest.mark.parametrize("supplier", [0, 3, 7])
def test_outage_never_shrinks_a_gap(small, supplier):
    stock = rk.latest_inventory(small.inventory_onhand, small.now)
    compared = scenario.compare(
        small.demand_to_date, small.open_po, stock, small.profile, supplier, small.today, 14
    )
    assert scenario.monotonic_violations(compared).count() == 0
    assert compared.where("level_delta < 0").count() == 0
    baseline = compared.select("material_pn", F.col("gap_qty_baseline").alias("gap_qty"))
    assert baseline.exceptAll(small.material_risk.select("material_pn", "gap_qty")).count() == 0


def test_outage_days_are_limited(small):
    for wrong in (0, 29):
        with pytest.raises(ValueError):
            scenario.scenario_orders(small.open_po, 0, small.today, wrong)


def report_rows(spark):
    data = [
        ("PN-00101", "2024-01-01", 8.0, 100.0, 10, "ORANGE"), ("PN-00202", "2024-01-01", 15.0, 80.0, 0, "YELLOW"),
        ("PN-00303", "2024-01-01", 9.0, 100.0, 20, "ORANGE"), ("PN-00404", "2024-01-01", 30.0, 100.0, 0, "GREEN"),
        ("PN-00101", "2024-01-08", 2.0, 100.0, 1000, "RED"), ("PN-00202", "2024-01-08", 3.0, 80.0, 500, "RED"),
        ("PN-00303", "2024-01-08", 7.0, 100.0, 200, "ORANGE"), ("PN-00404", "2024-01-08", 30.0, 100.0, 0, "GREEN"),
    ]
    return spark.createDataFrame(
        [(pn, day(d), doi, share, gap, day("2024-01-20") if gap else None, level, "") for pn, d, doi, share, gap, level in data],
        "material_pn string, eval_date date, doi_days double, supplier_concentration double, gap_qty bigint, "
        "gap_date date, risk_level string, risk_reasons string",
    )


def test_report_tables(spark):
    risk = report_rows(spark)
    newest = report.latest_snapshot(risk)
    kpi = report.kpi(newest).first()
    assert (kpi.red_count, kpi.orange_count, kpi.yellow_count, kpi.green_count) == (2, 1, 0, 1)
    assert (kpi.total_gap_qty, kpi.red_orange_pct) == (1700, 75.0)
    change = report.change(risk).where("previous_date IS NOT NULL").first()
    assert (change.red_change, change.orange_change) == (2, -1)
    names = spark.createDataFrame([(f"PN-00{i}0{i}", f"Name {i}") for i in range(1, 5)], "material_pn string, material_name string")
    profile = spark.createDataFrame([("PN-00101", 10, 1)], "material_pn string, min_lt bigint, primary_supplier_id bigint")
    top = report.top_red(newest, names, profile).collect()
    assert [r.material_pn for r in top] == ["PN-00101", "PN-00202"]
    assert [(r.min_lt, r.primary_supplier_id) for r in top] == [(10, 1), (0, -1)]
    assert {r.risk_level: r.materials for r in report.level_distribution(newest).collect()} == {
        "RED": 2, "ORANGE": 1, "YELLOW": 0, "GREEN": 1,
    }
    seen = report.availability(risk, F.lit(day("2024-01-02"))).first()
    assert (seen.first_date, seen.last_date, seen.rows_on_day) == (day("2024-01-01"), day("2024-01-08"), 0)


def test_report_backfill_is_idempotent(spark):
    risk = report_rows(spark)
    none = spark.createDataFrame([], "eval_date date")
    first = report.missing_dates(risk, none)
    assert first.count() == 2
    assert report.missing_dates(risk, first).count() == 0


def test_root_cause_rule_order(spark):
    detail = spark.createDataFrame(
        [("A", "RED", 5, 1, 1, 40), ("B", "RED", 5, 1, 1, 40), ("C", "RED", 5, 1, 2, 40), ("D", "RED", 5, 1, 2, 28)],
        "material_pn string, risk_level string, gap_qty bigint, inventory_qty bigint, supplier_count bigint, min_lt bigint",
    )
    open_po = orders(spark, [("A", 1, 5, "2024-01-05"), ("C", 1, 5, "2023-12-31")])
    counts = spark.createDataFrame([("A", 3), ("B", 3)], "material_pn string, sku_count bigint")
    got = diagnose.root_cause(detail, open_po, counts, F.lit(day(T))).collect()
    assert {r.material_pn: r.category for r in got} == {
        "A": "single_source_supply", "B": "shared_demand_competition", "C": "long_leadtime_no_po", "D": "unknown",
    }


def test_explanations_name_every_reason(small):
    risk = small.risk_detail
    sentences = rk.explain(risk, rk.top_contributors(small.forecast, small.bom)).join(
        risk.select("material_pn", "risk_reasons"), "material_pn"
    ).collect()
    marks = {
        "GAP_BEFORE_LT": "too late to expedite", "GAP_IN_HORIZON": "still reachable",
        "LOW_DOI_SINGLE_SOURCE": "single source", "HIGH_CONCENTRATION": "under 1.5 lead times",
    }
    for row in sentences:
        for code, mark in marks.items():
            assert (mark in row.explanation) == (code in row.risk_reasons.split(";"))
