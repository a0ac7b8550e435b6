"""Queries that have to grow with their tables: the same rows as before, in plans and files that stay small."""

from __future__ import annotations

import datetime
import glob
import hashlib

import pytest
from conftest import day
from pyspark.sql import functions as F

from shortfall.operators import intake as po
from shortfall.plans import intake, scans
from shortfall.plans import tables as shapes
from shortfall.sources import derived, workspace
from shortfall.sources.tables import PlanningTables
from shortfall.streaming import intake as streaming

LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"


def planning(spark, folder, lines, last):
    """Planning tables over order lines and one order of the day T."""
    at = [(*r[:-1], datetime.datetime.combine(day(r[-1]), datetime.time())) if r[-1] else r for r in lines]
    spark.createDataFrame(at, LINE).write.parquet(f"{folder}/lineitem.parquet")
    orders = spark.createDataFrame([(1, datetime.datetime.combine(day(last), datetime.time()))], "o_orderkey bigint, o_orderdate timestamp")
    orders.write.parquet(f"{folder}/orders.parquet")
    return PlanningTables(spark, str(folder))


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_wide_days_are_filled_without_a_lookup_per_day(spark, tmp_path):
    lines = [
        (1, 20, 1, 1, 5.0, 1.0, "2024-01-03"), (2, 21, 1, 1, 2.0, 1.0, "2024-01-03"), (3, 20, 1, 1, 4.0, 1.0, "2024-01-05"),
        (4, 40, 1, 1, 9.0, 1.0, "2024-01-01"), (5, 40, 1, 2, 8.0, 1.0, "2024-01-06"), (6, 60, 1, 1, None, 1.0, "2024-01-02"),
        (7, 40, 1, 1, 7.0, 1.0, "2024-01-09"), (8, 20, 1, 1, 1.0, 1.0, None), (9, None, 1, 1, 3.0, 1.0, "2024-01-04"),
    ]
    p = planning(spark, tmp_path, lines, "2024-01-06")
    wide = shapes.wide_days(p)
    assert {r[0]: list(r[1:]) for r in wide.collect()} == {
        1: [0, 0, 7, 0, 4, 0], 2: [9, 0, 0, 0, 0, 8], 3: [0, 0, 0, 0, 0, 0], None: [0, 0, 0, 3, 0, 0],
    }
    assert "map_from_entries" not in plan_of(wide)  # a map is searched from its start for every day
    long = {(r.sku_id, r.date): r.units_sold for r in shapes.unpivot_days(p).collect()}
    assert len(long) == 4 * 6 and long[1, day("2024-01-03")] == 7 and long[2, day("2024-01-06")] == 8


# -- dropped files -----------------------------------------------------------------------

ODD = [
    (7, 20, 3, 2, 5.0, 12.5, "2024-01-03"), (7, 20, 3, 1, 5.0, 12.5, "2024-01-03"), (3, 21, 1, 1, 2.0, 7.0, "2024-02-01"),
    (10**12 + 7, 5, 1, 1, 1.0, 1.0, "2024-01-05"), (10**11 + 7, 5, 1, 1, 1.0, 1.0, "2024-01-05"), (7, None, 1, 1, 4.0, 1.0, "2024-01-05"),
    (7, 20, 3, None, 9.0, 8.0, "2024-01-06"), (7, 20, None, 12, 8.0, None, "2024-01-02"), (11, 40, 1, 1, None, 7.0, "2024-01-09"),
    (15, 10**13, 2, 1, 7.0, 1.0, "2024-01-09"), (7, 19, 3, 1, 5.0, 12.5, "2024-01-03"), (7, 20, 3, 1, 5.0, 12.25, "2024-01-03"),
]


def test_dropped_lines_are_sorted_as_their_references(spark, tmp_path):
    p = planning(spark, tmp_path, ODD, "2024-01-06")
    rows = derived.upload(p, derived.dropped_lines(p), "drop").withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r.row_ref for r in rows) == sorted(r.row_ref for r in derived.upload(p).collect())
    for drop in {r.drop for r in rows}:
        mine = [r for r in rows if r.drop == drop]
        assert len({r.part for r in mine}) == 1
        assert [r.row_ref for r in mine] == sorted(r.row_ref for r in mine)
    ranks = p.lines.select(derived.line_reference().alias("ref"), derived.reference_rank().alias("rank")).collect()
    assert [r.ref[: derived.RANKED] for r in sorted(ranks, key=lambda r: r["rank"])] == sorted(r.ref[: derived.RANKED] for r in ranks)
    # What is shuffled has no text.
    shuffled = derived.dropped_lines(p)._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    assert "concat_ws" in shuffled and "row_ref" not in shuffled


def written(spark, label):
    return glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/shortfall/{label}-*/**/*.csv*", recursive=True)


def test_uploads_are_dropped_compressed(spark, tmp_path):
    p = planning(spark, tmp_path, [r for r in ODD if None not in r], "2024-01-06")
    before = {*written(spark, "upload"), *written(spark, "drop")}
    found = scans.scan_upload(p).collect()
    assert sorted(r.source_ref for r in found) == sorted(r.row_ref for r in derived.upload(p).collect())
    streamed = intake.stream_file_drop(p).collect()
    assert sorted(r.row_ref for r in streamed) == sorted(r.source_ref for r in found)
    new = {*written(spark, "upload"), *written(spark, "drop")} - before
    assert new and all(name.endswith(".csv.gz") for name in new)


def shuffle_files(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [names.apply(i).getName() for i in range(names.size())]
    return {n for n in found if n.startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_stored(spark, tmp_path):
    p = planning(spark, tmp_path, ODD, "2024-01-06")
    setting = spark.conf.get(workspace.SHUFFLE_CLEANUP, "false")
    before = shuffle_files(spark)
    stored = p.stored(spark.range(50_000).repartition(3, "id"), "spread")
    assert not [n for n in shuffle_files(spark) - before if n.endswith(".data")]
    assert stored.count() == 50_000
    assert spark.conf.get(workspace.SHUFFLE_CLEANUP) == setting


# -- whole files as a stream -----------------------------------------------------------------


def test_whole_files_are_kept_once_in_pieces(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    long = b"".join(b"%06d,caf\xc3\xa9\r\n" % i for i in range(30_000))
    texts = {
        "a": long, "b": long, "mark": b"\xef\xbb\xbfx,1\ny,2\n", "open": b"x,1\n\n\ny,2", "both": b"\xef\xbb\xbfx,1\ny,2",
        "one": b"z", "end": b"\n", "plain": b"x,1\ny,2\n",
    }
    for name, text in texts.items():
        (inbox / f"{name}.csv").write_bytes(text)
    item = [F.lit(0).cast("bigint").alias("message_uid"), F.col("path").alias("item_id"), "sha256", "path"]
    keep = streaming.once_only(spark, str(tmp_path / "seen"))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")  # several splits of a file
    try:
        for attempt in range(2):  # the second stream adds nothing
            stream = streaming.text_drop(spark, str(inbox))
            whole = streaming.kept_files(lambda files: files.select(*item), keep)
            streaming.run_once(stream, str(tmp_path / f"cp{attempt}"), target, whole, f"s{attempt}")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    stored = spark.read.parquet(target).orderBy("path", "start", "at").collect()
    files = {}
    for r in stored:
        files.setdefault(r.path.split("/")[-1].removesuffix(".csv"), []).append(r)
    assert {n: b"".join(bytes(r.piece) for r in rs) for n, rs in files.items()} == {n: t for n, t in texts.items() if n != "b"}
    assert all(r.sha256 == hashlib.sha256(texts[n]).hexdigest() and r.copies == 1 + (n == "a") for n, rs in files.items() for r in rs)
    assert max(len(r.piece) for r in stored) < 2 * streaming.PIECE_BYTES and len(files["a"]) > 5


def test_a_packed_file_is_no_text(spark, tmp_path):
    import gzip

    (tmp_path / "x.csv.gz").write_bytes(gzip.compress(b"x,1\n" * 1000))
    whole = streaming.kept_files(lambda files: files, lambda items, batch: items)
    with pytest.raises(Exception, match="not plain lines"):
        streaming.run_once(streaming.text_drop(spark, str(tmp_path)), str(tmp_path / "cp"), str(tmp_path / "out"), whole)


# -- checks of the upload ------------------------------------------------------------------


def test_repair_stores_the_checked_rows_only(spark, tmp_path):
    lines = [(k, 20 + k % 3, k % 4, 1, 5.0, 12.5, "2024-01-03") for k in range(40)]
    p = planning(spark, tmp_path, lines, "2024-01-06")
    spark.createDataFrame([(20 + i,) for i in range(3)], "p_partkey bigint").selectExpr(
        "p_partkey", "'x' p_name", "'t' p_type", "1 p_size", "1.0D p_retailprice"
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, f"s{i}", 0) for i in range(4)], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    assert intake.intake_repair_diff(p).count() > 0
    assert set(p._stored) == {"flagged", "order-numbers"}
    assert p._stored["flagged"].columns == ["row_ref", *po.FIELDS, *[f"{f}_error" for f in po.FIELDS]]
    assert intake.intake_revalidated(p).count() > 0 and "upload" not in p._stored


def test_texts_that_were_looked_up_are_not_shuffled_on(spark):
    upload = spark.createDataFrame([("1", "PO-1", "PN", "S", "1", "2024-01-01")] * 2, "row_ref string, po_id string, material_pn string, supplier_id string, qty string, eta_date string")
    known = [spark.createDataFrame([(v,)], f"{c} string") for c, v in (("material_pn", "PN"), ("supplier_id", "S"), ("po_id", "x"))]
    plan = plan_of(po.error_rows(po.flag_rows(upload, *known)))
    top = plan.split("Join")[1]  # between the last two joins
    assert "material_pn_text" not in top and "qty_value" not in top and "supplier_id_text" not in top
