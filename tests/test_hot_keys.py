"""One key holds a third of the rows; results stay whole."""

from __future__ import annotations

import bisect

from pyspark.sql import functions as F

from shortfall.operators import evidence as ev
from shortfall.operators import intake as po
from shortfall.operators import shape

ROWS = 60_000


def test_hot_order_number_and_hot_empty_number(spark):
    n = F.col("id")
    number = F.when(n % 3 == 0, "PO-HOT").when(n % 3 == 1, "").otherwise(F.concat(F.lit("PO-"), n.cast("string")))
    upload = spark.range(ROWS).select(
        F.format_string("%09d", n).alias("row_ref"), number.alias("po_id"), F.lit("PN").alias("material_pn"),
        F.lit("S").alias("supplier_id"), F.lit("1").alias("qty"), F.lit("2024-01-01").alias("eta_date"),
    )
    flagged = po.flag_rows(
        upload, spark.createDataFrame([("PN",)], "material_pn string"),
        spark.createDataFrame([("S",)], "supplier_id string"), spark.createDataFrame([("x",)], "po_id string"),
    )
    codes = {r.code: r["count"] for r in po.error_rows(flagged).groupBy("code").count().collect()}
    assert codes == {"duplicate_in_file": ROWS // 3 - 1, "required": ROWS // 3}
    assert po.counts(flagged).first().valid_count == ROWS // 3 + 1


def test_hot_answer_in_band_matching(spark):
    n = F.col("id")
    key = F.when(n % 3 == 0, 0).otherwise(n)
    values = spark.range(ROWS).select(key.alias("k"), (n + 1).cast("double").alias("number"))
    wanted = values.select("k", (F.col("number") * 2).alias("value"))
    got = ev.band_matches(wanted, values, "k")
    # Only the hot key has cells near the doubled values: multiples of three plus one, up to ROWS.
    hot = sorted(range(1, ROWS + 1, 3))
    def near(v):
        i = bisect.bisect_left(hot, 200 * v / 201 - 1e-9)
        return any(199 * c <= 200 * v <= 201 * c for c in hot[max(0, i - 1) : i + 2])

    assert got.count() == sum(near(2 * c) for c in hot)


def test_hot_series_in_median_and_latest(spark):
    n = F.col("id")
    rows = spark.range(ROWS).select(F.when(n % 3 == 0, 0).otherwise(1 + n % 50).alias("k"), (n % 1001).alias("v"), n)
    got = {r.k: r.v for r in shape.exact_median(rows, ["k"], "v").collect()}
    hot = sorted(i % 1001 for i in range(0, ROWS, 3))
    middle = len(hot) // 2
    assert got[0] == (hot[middle - 1] + hot[middle] + 1) // 2
    assert shape.latest_per_key(rows, ["k"], "id").where("k = 0").first().id == ROWS - 3
