from __future__ import annotations

import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from shortfall.functions import numbers
from shortfall.operators import intake as po

UPLOAD = "row_ref string, po_id string, material_pn string, supplier_id string, qty string, eta_date string"


def upload(spark, data):
    """Rows numbered from 2, as in a sheet below its header."""
    return spark.createDataFrame([(f"{i:06d}", *r) for i, r in enumerate(data, start=2)], UPLOAD)


@pytest.fixture(scope="module")
def known(spark):
    materials = spark.createDataFrame([(f"PN-0000{i}",) for i in range(1, 7)], "material_pn string")
    suppliers = spark.createDataFrame([(f"SUP-00{i}",) for i in range(1, 5)], "supplier_id string")
    target = spark.createDataFrame([("PO-000001",), ("po-stored-lower",)], "po_id string")
    return materials, suppliers, target


def errors(flagged):
    return [(int(r.row_ref), r.field, r.code) for r in po.error_rows(flagged).orderBy("row_ref", "field").collect()]


def good(i, **changed):
    """A row without fault; single cells can be changed."""
    row = {
        "po_id": f"ORD-{i:04d}", "material_pn": f"PN-0000{1 + i * 5 % 6}", "supplier_id": f"SUP-00{1 + i * 3 % 4}",
        "qty": str(17 + 29 * i), "eta_date": f"2031-0{1 + i % 9}-1{i % 10}",
    }
    return tuple((row | changed).values())


def test_clean_rows_all_pass(spark, known):
    flagged = po.flag_rows(upload(spark, [good(i) for i in range(9)]), *known)
    assert tuple(po.counts(flagged).first()) == (9, 9, 0, 0)
    first = po.valid_rows(flagged).orderBy("row_ref").first()
    assert (first.qty, first.eta_date) == (17, day("2031-01-10"))


FAULTS = [
    ("eta_date", "soon", "invalid_date"), ("eta_date", "2031-13-01", "invalid_date"), ("qty", "0", "invalid_positive_integer"),
    ("qty", "4.5", "invalid_positive_integer"), ("qty", "a lot", "invalid_positive_integer"), ("supplier_id", "SUP-77", "unknown_supplier"),
    ("material_pn", "ZZ-1", "unknown_material"), ("po_id", "PO-000001", "already_exists"), ("po_id", "", "required"),
    ("po_id", None, "required"), ("po_id", good(0)[0], "duplicate_in_file"),
]


def test_every_rejection_class(spark, known):
    """One fault a row, between rows without fault."""
    data, expected = [good(0)], []
    for i, (field, value, code) in enumerate(FAULTS, 1):
        data += [good(2 * i, **{field: value}), good(2 * i + 1)]
        expected.append((2 * i + 1, field, code))
    flagged = po.flag_rows(upload(spark, data), *known)
    assert errors(flagged) == expected
    assert po.counts(flagged).first().valid_count == len(FAULTS) + 1


def repair(spark, known, data):
    first = po.flag_rows(upload(spark, data), *known)
    candidates = po.repair_candidates(first, *known)
    diff = [(int(r.row_ref), r.field, r.new_value, r.rule_name) for r in po.repair_diff(candidates).orderBy("row_ref", "field").collect()]
    again = po.flag_rows(po.repaired_upload(first, candidates), *known)
    # Checking only the rows that a repair touches finds the same errors.
    assert errors(po.flag_rows(po.touched_rows(first, candidates), *known)) == errors(again)
    return diff, again


REPAIRS = [
    ("qty", "3,407", "3407", "qty_format"), ("qty", "55.00", "55", "qty_format"),
    ("eta_date", "2031/11/5", "2031-11-05", "date_format"), ("eta_date", "2031.2.28", "2031-02-28", "date_format"),
    ("eta_date", "2031年12月9日", "2031-12-09", "date_format"), ("eta_date", "20310430", "2031-04-30", "date_format"),
    ("supplier_id", "sup-002", "SUP-002", "key_normalize"), ("material_pn", "Pn-00005", "PN-00005", "key_normalize"),
]
BEYOND = [("qty", "-8", "invalid_positive_integer"), ("eta_date", "2031/2/30", "invalid_date"), ("supplier_id", "sup-9", "unknown_supplier")]


def test_repair_gives_exact_cell_changes(spark, known):
    data = [good(i, **{field: value}) for i, (field, value, *_) in enumerate([*BEYOND, *REPAIRS])]
    data.append(good(40, qty="1,000", eta_date="2031/1/2"))  # two cells of one row
    diff, again = repair(spark, known, data)
    start = 2 + len(BEYOND)
    last = 2 + len(BEYOND) + len(REPAIRS)
    assert diff == [(start + i, field, new, rule) for i, (field, _, new, rule) in enumerate(REPAIRS)] + [
        (last, "eta_date", "2031-01-02", "date_format"), (last, "qty", "1000", "qty_format"),
    ]
    assert errors(again) == [(2 + i, field, code) for i, (field, _, code) in enumerate(BEYOND)]
    assert po.counts(again).first().valid_count == len(REPAIRS) + 1


def test_collision_made_by_a_repair_is_caught(spark, known):
    """A number that meets a stored one only until its case is mended, and then one of its own file."""
    diff, again = repair(spark, known, [good(1, po_id="po-stored-lower"), good(2, po_id="PO-STORED-LOWER"), good(3)])
    assert diff == [(2, "po_id", "PO-STORED-LOWER", "key_normalize")]
    assert errors(again) == [(3, "po_id", "duplicate_in_file")]


def test_recheck_sees_a_changed_target(spark, known):
    materials, suppliers, target = known
    data = upload(spark, [("PO-1", "PN-00001", "SUP-001", "1", "2026-01-01"), ("PO-2", "PN-00001", "SUP-001", "1", "2026-01-01")])
    grown = target.unionByName(spark.createDataFrame([("PO-2",)], "po_id string"))
    flagged = po.flag_rows(data, materials, suppliers, grown)
    assert errors(flagged) == [(3, "po_id", "already_exists")]


def test_duplicates_stay_inside_their_file(spark, known):
    data = upload(spark, [("PO-1", "PN-00001", "SUP-001", "1", "2026-01-01")] * 3)
    filed = data.withColumn("file", F.when(F.col("row_ref") == "000004", "b").otherwise("a"))
    flagged = po.flag_rows(filed, *known, file="file")
    assert errors(flagged) == [(3, "po_id", "duplicate_in_file")]
    assert [(r.file, r.row_ref) for r in po.error_rows(flagged, "file").collect()] == [("a", "000003")]


def test_value_repairs(spark):
    def values(texts, repaired):
        frame = spark.createDataFrame([(t,) for t in texts], "v string")
        return [r[0] for r in frame.select(repaired(F.col("v"))).collect()]

    assert values(["2030/3/4", "2030.10.9", "2030年5月6日", "20301231", "2030/4/31", "later"], numbers.repaired_date) == [
        day("2030-03-04"), day("2030-10-09"), day("2030-05-06"), day("2030-12-31"), None, None,
    ]
    assert values(["8,050", "７１", "19.0", "-3", "0.5", "0", "8,05", "88888888888"], numbers.repaired_quantity) == [
        8050, 71, 19, None, None, None, None, None,
    ]
    assert values(["2030-03-04", "2030-3-4", "2030-04-31", "02030-03-04"], numbers.strict_iso_date) == [day("2030-03-04"), None, None, None]
    frame = spark.createDataFrame([("ﬁ①",)], "v string")
    assert frame.select(numbers.nfkc("v")).first()[0] == "fi1"


def test_header_mapping():
    assert po.map_headers(["采购 单号", "料号", "供应商_编号", "数量", "ETA"]) == {
        "po_id": "采购 单号", "material_pn": "料号", "supplier_id": "供应商_编号", "qty": "数量", "eta_date": "ETA",
    }
    assert po.map_headers(["PO_ID", "other"])["po_id"] == "PO_ID"
    assert po.map_headers(["other"])["qty"] is None


def test_mapping_must_be_complete(spark):
    frame = upload(spark, [("a", "b", "c", "d", "e")])
    with pytest.raises(ValueError):
        po.apply_mapping(frame, {**po.map_headers(frame.columns), "qty": None})
    with pytest.raises(ValueError):
        po.apply_mapping(frame, {**po.map_headers(frame.columns), "qty": "po_id"})


def items(spark, data):
    return spark.createDataFrame(data, "item_id bigint, message_uid bigint, sender string, filename string, content binary")


def test_routing_and_dedup(spark):
    frame = items(spark, [
        (3, 1, " Buyer@X ", "a.XLSX", b"1"), (1, 1, "buyer@x", "a.xlsx", b"1"), (2, 1, "buyer@x", "a.xlsx", b"2"),
        (4, 2, "buyer@x", "a.txt", b"1"), (5, 3, "stranger", "a.xlsx", b"1"),
    ])
    routed = {r.item_id: (r.status, r.error_code) for r in po.route_items(frame, ["BUYER@x"]).collect()}
    assert routed == {
        1: ("pending_review", None), 2: ("pending_review", None), 3: ("pending_review", None),
        4: ("invalid_file", "unsupported_file_type"), 5: ("blocked", "sender_not_allowed"),
    }
    assert po.route_items(frame, []).where("status <> 'blocked'").count() == 0
    first = po.first_items(frame)
    assert sorted(r.item_id for r in first.collect()) == [1, 2, 4, 5]
    assert po.unseen_items(first, first).count() == 0


def test_undo_restores_the_target(spark, known):
    before = spark.createDataFrame([("PO-0", "x")], "po_id string, batch_id string")
    batch = spark.createDataFrame([("PO-1", "b1"), ("PO-2", "b1")], "po_id string, batch_id string")
    after = before.unionByName(batch)
    assert rows(po.undo_batch(after, batch, "b1")) == rows(before)
    assert po.undo_batch(after, batch, "unknown").count() == 3


def test_white_space_of_any_kind_is_no_part_of_a_cell(spark, known):
    data = [good(i, **{f: b + good(i)[n] + a}) for i, (n, f, b, a) in enumerate([
        (1, "material_pn", "", "\t"), (2, "supplier_id", "\u3000", ""), (3, "qty", "\u00a0", "\u2003"),
        (4, "eta_date", "\n", "\x1f"), (0, "po_id", "\u2028", "\r\n"),
    ])]
    flagged = po.flag_rows(upload(spark, data), *known)
    assert tuple(po.counts(flagged).first()) == (5, 5, 0, 0)
    assert [tuple(r)[1:4] for r in po.valid_rows(flagged).orderBy("row_ref").collect()] == [good(i)[:3] for i in range(5)]
    blank = po.flag_rows(upload(spark, [good(0, po_id="\u3000\t")]), *known)
    assert errors(blank) == [(2, "po_id", "required")]
    assert numbers.WHITE_SPACE.strip() == "" and len(numbers.WHITE_SPACE) == sum(map(str.isspace, map(chr, range(0x110000))))


def test_general_folding_repairs_keys_and_quantities(spark):
    materials = spark.createDataFrame([("FI-00001",), ("カ-2",), ("PN-00003",)], "material_pn string")
    suppliers = spark.createDataFrame([("SUP-001",)], "supplier_id string")
    target = spark.createDataFrame([], "po_id string")
    data = [
        ("ORD-①", "ﬁ-00001", "SUP-001", "①②", "2031-01-01"), ("ORD-2", "ｶ-²", "ＳＵＰ－００１", "５", "2031-01-01"),
        ("ORD-3", "pn-00003", "sup-001", "7.00", "2031-01-01"), ("ORD-4", "PN-00003é", "SUP-001", "½", "2031-01-01"),
    ]
    flagged = po.flag_rows(upload(spark, data), materials, suppliers, target)
    found = po.repair_diff(po.repair_candidates(flagged, materials, suppliers, target))
    assert sorted((int(r.row_ref), r.field, r.new_value) for r in found.collect()) == [
        (2, "material_pn", "FI-00001"), (2, "qty", "12"), (3, "material_pn", "カ-2"), (3, "supplier_id", "SUP-001"),
        (4, "material_pn", "PN-00003"), (4, "qty", "7"), (4, "supplier_id", "SUP-001"),
    ]


def test_only_odd_rows_are_folded_in_python(spark):
    frame = spark.createDataFrame([("abc",), ("ａｂｃ１",), ("ﬁ",), (None,)], "t string")
    assert [r[0] for r in frame.select(numbers.needs_nfkc(F.col("t"))).collect()] == [False, False, True, False]
