from __future__ import annotations

import glob

import pytest
from conftest import SMALL, day, rows
from pyspark.sql import functions as F

from shortfall.operators import intake as po
from shortfall.operators import quality
from shortfall.sources import readers, sinks, workspace
from shortfall.sources.schemas import KEYS, RELATIONS, SCHEMAS, schema_of
from shortfall.streaming import intake as streaming

RISK = "material_pn string, eval_date date, level string"


def test_schemas_cover_keys_and_relations(spark):
    for table, keys in KEYS.items():
        assert set(keys) <= set(schema_of(table).names)
    for child, column, parent, parent_column in RELATIONS:
        assert column in SCHEMAS[child] and parent_column in SCHEMAS[parent]


def test_typed_scan_fails_on_a_missing_column(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2).select(F.col("id").cast("string").alias("sku_id")).write.parquet(path)
    with pytest.raises(Exception):
        readers.read_table(spark, path, "products")


def test_wide_sales_scan(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text("item_id,dept_id,cat_id,store_id,d_1\na,FOODS_3,FOODS,CA_1,5\nb,FOODS_3,FOODS,TX_1,6\nc,FOODS_2,FOODS,CA_1,7\n")
    kept = readers.read_wide_sales(spark, str(path), "FOODS", "FOODS_3", "CA_")
    assert [(r.item_id, r.d_1) for r in kept.collect()] == [("a", "5")]
    (tmp_path / "bad.csv").write_text("item_id,d_1\na,1\n")
    with pytest.raises(ValueError, match="cat_id"):
        readers.read_wide_sales(spark, str(tmp_path / "bad.csv"), "FOODS", "FOODS_3", "CA_")


def test_json_lines_keep_bad_lines(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"id": "a", "n": 1}\n\n{"id": "b"\n{"id": "c", "n": 3}\n')
    good, bad = readers.read_json_lines(spark, str(path), "id STRING, n INT")
    assert rows(good) == [("a", 1), ("c", 3)]
    assert rows(bad) == [('{"id": "b"',)]


def test_upload_header_rules_and_row_cap(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    good = readers.read_upload(spark, write("a.csv", "﻿po_id,qty\nx,1\ny,2\n"))
    assert [(r.row_ref[-1], r.po_id, r.qty) for r in good.collect()] == [("2", "x", "1"), ("3", "y", "2")]
    for text in ("po_id,,qty\nx,1,2\n", "po_id,po_id\nx,1\n"):
        with pytest.raises(ValueError):
            readers.read_upload(spark, write("b.csv", text))
    many = write("c.csv", "po_id\n" + "\n".join(map(str, range(6))) + "\n")
    with pytest.raises(ValueError, match="more than 5 rows"):
        readers.read_upload(spark, many, limit=5)
    assert readers.read_upload(spark, many, limit=6).count() == 6


def test_rows_are_numbered_as_in_their_file(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    sizes = {"a.csv": 700, "b.csv": 1, "c.csv": 0, "d.csv": 350}
    for name, n in sizes.items():
        (folder / name).write_text("po_id,qty\n" + "".join(f"{name}-{i},{i}\n" for i in range(2, n + 2)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # several splits a file
    try:
        found = readers.read_upload(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted(r.po_id for r in found) == sorted(f"{name}-{i}" for name, n in sizes.items() for i in range(2, n + 2))
    assert all(r.row_number == int(r.qty) for r in found)
    assert len({r.row_ref for r in found}) == len(found)
    order = [(r.po_id.split("-")[0], r.row_number) for r in sorted(found, key=lambda r: r.row_ref)]
    assert order == sorted(order)


def test_a_file_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("po_id,qty\nx,1\n")
    (tmp_path / "b.csv").write_text("qty,po_id\n1,x\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_upload(spark, str(tmp_path)).collect()


def test_a_batch_reads_the_seen_keys_of_its_own_parts(spark, tmp_path):
    items = "message_uid bigint, item_id bigint, content binary"
    seen = str(tmp_path / "seen")
    keep = streaming.once_only(spark, seen, parts=8)
    first = spark.createDataFrame([(i, i, bytes([i])) for i in range(60)], items)
    assert keep(first, "s-0").count() == 60
    again = spark.createDataFrame([(7, 100, bytes([7])), (61, 101, b"new")], items)
    assert [r.item_id for r in keep(again, "s-1").collect()] == [101]
    assert keep(again, "s-1").count() == 1  # a repeated batch gives the same
    parts = {f.split("part=")[1].split("/")[0] for f in streaming.seen_keys(spark, seen).where("part = 3").inputFiles()}
    known = streaming.seen_keys(spark, seen).where("part = 3")
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan and known.count() < 60 and parts


def test_snapshot_replace_touches_only_its_dates(spark, tmp_path):
    path = str(tmp_path / "risk")
    old = spark.createDataFrame([("a", day("2024-01-01"), "RED"), ("a", day("2024-01-08"), "RED")], RISK)
    sinks.replace_snapshots(old, path)
    new = spark.createDataFrame([("b", day("2024-01-08"), "GREEN")], RISK)
    for _ in range(2):
        sinks.replace_snapshots(new, path)
    assert rows(spark.read.parquet(path).select("material_pn", "eval_date", "level")) == [
        ("a", day("2024-01-01"), "RED"), ("b", day("2024-01-08"), "GREEN"),
    ]


def test_append_and_remove_batch(spark, tmp_path):
    path = str(tmp_path / "po")
    for batch in ("b1", "b2", "b2"):
        sinks.append_batch(spark.createDataFrame([("PO-" + batch, batch)], "po_id string, batch_id string"), path)
    assert spark.read.parquet(path).count() == 2
    sinks.remove_batch(spark, path, str(tmp_path / "left"), "b2")
    assert [r.po_id for r in spark.read.parquet(str(tmp_path / "left")).collect()] == ["PO-b1"]


def test_sorted_and_csv_sinks(spark, tmp_path):
    frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    sinks.write_sorted(frame, str(tmp_path / "s"), ["k"])
    read = []
    for part in sorted(glob.glob(str(tmp_path / "s" / "part-*"))):
        read += [r.k for r in spark.read.parquet(part).collect()]
    assert read == list(range(1000))
    sinks.write_csv_bom(frame.limit(1), str(tmp_path / "c"))
    text = open(next(p for p in glob.glob(str(tmp_path / "c" / "part-*")) if open(p, "rb").read()), "rb").read()
    assert text.startswith(b"\xef\xbb\xbfk")


class FakeSession:
    """Stands for a session with given settings."""

    def __init__(self, settings, master):
        self.settings = settings
        self.conf = self
        self.sparkContext = self
        self.master = master
        self.applicationId = "fake"

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_workspace_prefers_the_configured_folder():
    shared = FakeSession({"spark.checkpoint.dir": "hdfs://c/x/"}, "yarn")
    assert workspace.scratch_path(shared, "t").startswith("hdfs://c/x/shortfall/t-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_folder(FakeSession({}, "yarn"))
    local = FakeSession({}, "local[2]")
    assert workspace.shared_folder(local) == workspace.shared_folder(local)


# -- quality -----------------------------------------------------------------------------


def test_split_totals(spark):
    shares = spark.createDataFrame([("a", 60.0), ("a", 40.0), ("b", 55.0), ("b", 35.0)], "material_pn string, split_pct double")
    assert rows(quality.split_totals(shares)) == [("b", 90.0)]


def test_keys_ranges_nulls_and_gaps(spark):
    frame = spark.createDataFrame([(1, day("2024-01-01"), -1), (1, day("2024-01-01"), 2), (2, day("2024-01-03"), None)], "k int, d date, v int")
    assert rows(quality.duplicate_keys(frame, ["k", "d"])) == [(1, day("2024-01-01"), 2)]
    found = quality.duplicate_and_negative({"t": (frame, ["k", "d"], "v")}).first()
    assert (found.duplicate_keys, found.negative_values) == (1, 1)
    assert rows(quality.null_counts(frame, ["k", "v"])) == [("k", 0), ("v", 1)]
    gaps = quality.date_gaps(frame, "d", F.lit(day("2024-01-01")), F.lit(day("2024-01-04")))
    assert rows(gaps) == [(day("2024-01-02"),), (day("2024-01-04"),)]
    ranges = quality.row_ranges({"t": frame}, {"t": (1, 2)}).first()
    assert (ranges.row_count, ranges.in_range) == (3, False)


def test_a_join_that_would_fan_out_ends_the_query(spark):
    many = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "k int, x string")
    one = spark.createDataFrame([(1, 10, "p"), (2, 20, None), (4, 40, "q"), (None, 50, "r")], "k int, v int, w string")
    assert rows(quality.checked_join(many, one, ["k"])) == [(1, "a", 10, "p"), (1, "b", 10, "p"), (2, "c", 20, None)]
    assert quality.checked_join(many, one, ["k"], "left").count() == 5
    twice = one.unionByName(one.where("k = 4"))
    for join in (quality.checked_join(many, twice, ["k"]).select("x"), quality.checked_join(many, twice, ["k"], "left")):
        with pytest.raises(Exception, match="several rows: 4"):
            join.collect()
    with pytest.raises(Exception, match="several rows: 2, c"):
        quality.checked_join(many, many.where("k = 2").union(many), ["k", "x"]).count()


def test_snapshots_are_computed_once_for_their_input(spark, monkeypatch):
    from shortfall.sources import snapshots
    from shortfall.sources.tables import PlanningTables

    monkeypatch.setattr(snapshots, "RULES", 99)  # a store of its own
    asked = []
    whole = PlanningTables.risk_at

    def counted(self, cutoffs, model="seasonal_naive"):
        asked.append(len(cutoffs))
        return whole(self, cutoffs, model)

    monkeypatch.setattr(PlanningTables, "risk_at", counted)
    first = PlanningTables(spark, SMALL)
    latest = first.snapshots_at(first.now)
    assert asked == [1] and rows(latest) == rows(first.material_risk.select(latest.columns))
    asked.clear()
    second = PlanningTables(spark, SMALL)
    history = rows(second.snapshots)
    assert asked == [8]  # today's is there already
    third = PlanningTables(spark, SMALL)
    assert rows(third.snapshots) == history == rows(whole(third, [*third.past_cutoffs, third.today]).select(latest.columns))
    assert asked == [8] and len(third.snapshot_store.missing([day("1990-01-01")])) == 1
    paths = {f.split("/")[-1] for f in third.snapshots_at(third.now).inputFiles()}
    assert paths  # only one date's folder is read
    plan = third.snapshots_at(third.now)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "eval_date" in plan


def test_changed_input_has_another_mark(spark, tmp_path):
    from shortfall.sources.snapshots import input_mark

    frame = spark.range(5)
    frame.write.parquet(str(tmp_path / "a.parquet"))
    mark = input_mark(spark, str(tmp_path), ("a",))
    assert mark == input_mark(spark, str(tmp_path), ("a",))
    frame.write.mode("append").parquet(str(tmp_path / "a.parquet"))
    assert mark != input_mark(spark, str(tmp_path), ("a",))


def test_published_forecasts_are_decimals(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1.25), ("b", 3.0)], "sku_id string, yhat double")
    sinks.replace_table(sinks.published(frame), str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    assert dict(stored.dtypes)["yhat"] == "decimal(10,2)" and [str(r[1]) for r in rows(stored)] == ["1.25", "3.00"]


def test_orphans_and_drift(spark):
    child = spark.createDataFrame([(1,), (1,), (9,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert rows(quality.orphans(child, "k", parent, "k")) == [(9,)]
    frozen = spark.createDataFrame([("a", 1.234), ("b", 2.0), ("c", 3.0)], "metric string, value double")
    now = spark.createDataFrame([("a", 1.2341), ("b", 2.5), ("d", 1.0)], "metric string, value double")
    assert {r.metric: r.status for r in quality.metric_drift(now, frozen, 3).collect()} == {
        "a": "ok", "b": "metric_drift", "c": "metric_missing",
    }


def test_truth_recall(spark):
    risk = spark.createDataFrame([("a", "RED", 5), ("b", "GREEN", 0), ("c", "RED", 5)], "material_pn string, risk_level string, gap_qty bigint")
    truth = spark.createDataFrame([("a",), ("b",)], "material_pn string")
    assert tuple(quality.truth_recall(risk, truth).first()) == (2, 1, 1)


# -- streaming ---------------------------------------------------------------------------

DROP = "row_ref string, po_id string, material_pn string, supplier_id string, qty string, eta_date string"


def test_file_drop_counts_files_once_and_reads_the_sender(spark, tmp_path):
    inbox, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    inbox.mkdir()
    header = DROP.replace(" string", "").replace(" ", "") + "\n"
    (inbox / "buyer@x__orders a.csv").write_text(header + "1,PO-1,PN,S,5,2024-01-01\n2,PO-1,PN,S,5,2024-01-01\n")
    (inbox / "plain.csv").write_text(header + "1,PO-1,PN,S,5,2024-01-01\n")

    def poll():
        streaming.run_once(streaming.file_drop(spark, str(inbox), DROP), checkpoint, target, lambda f, n: f)
        return {(r.sender, r.filename, r.row_ref) for r in spark.read.parquet(target).collect()}

    first = poll()
    assert first == {("buyer@x", "orders a.csv", "1"), ("buyer@x", "orders a.csv", "2"), ("local@demo", "plain.csv", "1")}
    assert poll() == first
    (inbox / "late.csv").write_text(header + "7,PO-9,PN,S,5,2024-01-01\n")
    assert poll() == first | {("local@demo", "late.csv", "7")}
    assert spark.read.parquet(target).count() == 4


def test_stream_validation_per_file(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    header = DROP.replace(" string", "").replace(" ", "") + "\n"
    for name, reference in (("a.csv", "1"), ("b.csv", "2")):
        (inbox / name).write_text(header + f"{reference},PO-1,PN,S,5,2024-01-01\n{reference}x,PO-1,PN,?,0,2024-13-01\n")
    materials = spark.createDataFrame([("PN",)], "material_pn string")
    suppliers = spark.createDataFrame([("S",)], "supplier_id string")
    open_po = spark.createDataFrame([("PO-7",)], "po_id string")
    check = streaming.validated(materials, suppliers, open_po)
    streaming.run_once(streaming.file_drop(spark, str(inbox), DROP), str(tmp_path / "cp"), target, check)
    got = {(r.row_ref, r.code) for r in spark.read.parquet(target).collect()}
    codes = ("duplicate_in_file", "unknown_supplier", "invalid_positive_integer", "invalid_date")
    assert got == {(f"{n}x", c) for n in "12" for c in codes}


def test_once_only_items_survive_a_replay(spark, tmp_path):
    """A second stream over the same files, as after a lost checkpoint, adds nothing."""
    inbox, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "item_id bigint, message_uid bigint, sender string, filename string, content binary"
    spark.createDataFrame([(1, 1, "a", "f", b"x"), (2, 1, "a", "f", b"x"), (3, 2, "a", "f", b"x")], schema).write.parquet(inbox)
    keep = streaming.once_only(spark, f"{target}-seen")
    for attempt in range(2):
        stream = spark.readStream.schema(schema).parquet(inbox)
        streaming.run_once(stream, str(tmp_path / f"cp{attempt}"), target, keep, attempt * 1000)
    assert sorted(r.item_id for r in spark.read.parquet(target).collect()) == [1, 3]


def test_binary_drop_hashes_whole_files(spark, tmp_path):
    inbox, target = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.bin").write_bytes(b"abc")
    streaming.run_once(streaming.binary_drop(spark, str(inbox)), str(tmp_path / "cp"), target, lambda f, n: f.select("sha256", "length"))
    assert [tuple(r) for r in spark.read.parquet(target).select("sha256", "length").collect()] == [
        ("ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", 3)
    ]


def test_routing_without_allowed_senders(spark):
    frame = spark.createDataFrame([(1, "a", "x.xlsx")], "item_id int, sender string, filename string")
    assert po.route_items(frame, []).first().status == "blocked"
