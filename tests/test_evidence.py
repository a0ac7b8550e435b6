from __future__ import annotations

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortfall.operators import evidence as ev
from shortfall.operators import grading, retrieval

ANSWERS = "id int, answer string, question string, exempt_text string, row_count bigint"
CELLS = "id int, number double, day string, literal string"


def check(spark, cases):
    """(claims to check, unmatched raw texts) per case of (answer, cells, question, exempt, rows)."""
    answers, cells = [], []
    for i, (answer, result, question, exempt, row_count) in enumerate(cases):
        answers.append((i, answer, question, exempt, row_count or max(1, len(result))))
        for cell in result:
            if isinstance(cell, date):
                cells.append((i, None, cell.isoformat(), None))
            elif isinstance(cell, str):
                cells.append((i, None, None, cell))
            else:
                cells.append((i, float(cell), None, None))
    table, texts = spark.createDataFrame(cells, CELLS), spark.createDataFrame(answers, ANSWERS)
    # In one row per answer, by joins, and each for some of the answers.
    ways = [counted(ev.check_answers(texts, table, "id", many), len(cases)) for many in (ev.MANY_CELLS, 0, 2)]
    assert ways[0] == ways[1] == ways[2]
    return ways[0]


def counted(matched, cases):
    found = {i: (0, []) for i in range(cases)}
    for r in matched.collect():
        n, unmatched = found[r.id]
        found[r.id] = (n + 1, sorted(unmatched if r.matched else [*unmatched, r.raw]))
    return [found[i] for i in range(cases)]


def plain(answer, *cells):
    return answer, list(cells), "what happened?", "", None


SUPPORTED = [
    plain("stock stands at 48,920 now", 48920), plain("cost 7,415.25 in all", 7415.25), plain("it fell by -2,604", -2604),
    plain("a swing of ±870", 870), plain("up 62.5% since", 62.5), plain("up 62.5% since", 0.625), plain("仓里有 ３１８ 箱货", 318),
    plain("due 2021-11-03", date(2021, 11, 3)), plain("到货 2021年11月3日", date(2021, 11, 3)), plain("到货 11月3日", date(2021, 11, 3)),
    plain("due on 11-03 then", date(2021, 11, 3)), plain("due on 11/3 then", date(2021, 11, 3)),
    plain("roughly 48,900 left", 48920), plain("about 1005 left", 1000), plain("about 995 left", 1000),
]
UNSUPPORTED = [
    (plain("stock stands at 49,520 now", 48920), ["49,520"]), (plain("it moved by -64", 64), ["-64"]),
    (plain("due 2021-11-04", date(2021, 11, 3)), ["2021-11-04"]), (plain("nothing left: 0 pieces", 12), ["0"]),
    (plain("about 1006 left", 1000), ["1006"]), (plain("一共 4个仓库", "east", "west"), ["4"]),
    (plain("the amount was 385 then", "Crate 385"), ["385"]), (plain("mostly Crate 3859 items", "Crate 385"), ["3859"]),
    (plain("half is 0 and 777 is new", "east"), ["0", "777"]), (plain("all of 2019 was calm", date(2021, 11, 3)), ["2019"]),
    (plain("仓里有 ５１２ 箱货", 318), ["512"]),
]
EXEMPT = [
    plain("part QX-204 comes from VND-7 for LINE_12_B", "late"), plain("late items: Crate 385 only", "Crate 385"),
    plain("3个：red、blue、green", "red", "blue", "green"), ("the top 6 are shown", ["late"], "show the top 6", "", None),
    plain("1. east\n2. west", "east", "west"), plain("第1名 east，第2名 west", "east", "west"), plain("缺口大于0 的都算", "late"),
    plain("vendor 7 is slow", "VND-007"), ("a horizon of 45 days", ["late"], "what?", "plans use 45 days", None),
    ("on 2021-11-03", ["late"], "what came on 2021-11-03?", "", None), ("在11月3日", ["late"], "what came on 2021-11-03?", "", None),
    ("还有 25个", ["late"], "what?", "", 60), plain("all of 2021 was calm", date(2021, 11, 3)),
]


def test_answers_are_checked_by_the_rules(spark):
    cases = SUPPORTED + [c for c, _ in UNSUPPORTED] + EXEMPT
    expected = [(1, [])] * len(SUPPORTED) + [(len(u), u) for _, u in UNSUPPORTED] + [(0, [])] * len(EXEMPT)
    got = check(spark, cases)
    wrong = [(c[0], g, e) for c, g, e in zip(cases, got, expected) if g != e]
    assert not wrong, wrong


def known_piece(pick):
    """A piece of text and the claims it was made from."""
    kind = pick.choice(["iso", "chinese", "month", "dash", "slash", "number", "grouped", "decimal", "signed", "percent", "wide", "name", "word"])
    d = date(2000 + pick.randrange(40), 1 + pick.randrange(12), 1 + pick.randrange(28))
    n = pick.randrange(1, 999)
    short = f"{d.month:02d}-{d.day:02d}"
    return {
        "iso": (d.isoformat(), [("date", d.isoformat())]),
        "chinese": (f"{d.year}年{d.month}月{d.day}日", [("date", d.isoformat())]),
        "month": (f"{d.month}月{d.day}日", [("month_day", short)]),
        "dash": (f"{d.month}-{d.day}", [("month_day", short)]),
        "slash": (f"{d.month}/{d.day}", [("month_day", short)]),
        "number": (str(n), [("number", repr(float(n)))]),
        "grouped": (f"{n},{n:03d}", [("number", repr(float(n * 1001)))]),
        "decimal": (f"{n}.25", [("number", repr(n + 0.25))]),
        "signed": (f"-{n}", [("number", repr(float(-n)))]),
        "percent": (f"{n}.5%", [("percentage", repr(n + 0.5))]),
        "wide": (str(n).translate(str.maketrans("0123456789", "０１２３４５６７８９")), [("number", repr(float(n)))]),
        "name": (f"KX-{n}_B{d.day}", []),
        "word": (f"box{n}a", []),
    }[kind]


def test_texts_give_the_claims_they_were_made_from(spark):
    pick = random.Random(29)
    texts, expected = [], []
    for _ in range(2500):
        made = [known_piece(pick) for _ in range(pick.randrange(0, 7))]
        between = [pick.choice([" and ", "；那么 ", " | ", "\nthen ", " ... "]) for _ in made]
        texts.append("start " + "".join(x + g for (x, _), g in zip(made, between)) + "end")
        expected.append(sorted(c for _, claims in made for c in claims))
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    got = {}
    for r in ev.extract_claims(frame, "id", "t").collect():
        got.setdefault(r.id, []).append((r.kind, r.day if r.day else repr(r.value)))
    wrong = [(t, sorted(got.get(i, [])), e) for i, (t, e) in enumerate(zip(texts, expected)) if sorted(got.get(i, [])) != e]
    assert not wrong, (len(wrong), wrong[:5])


def test_band_matching_against_all_pairs(spark):
    random.seed(5)
    numbers = [round(random.choice([-1, 1]) * 10 ** random.uniform(-3, 6), 2) for _ in range(400)] + [0.0, 200.0, 201.0, 199.0]
    near = [round(n * (1 + random.uniform(-0.011, 0.011)), 3) for n in numbers] + [0.0]
    wanted = spark.createDataFrame([(i % 3, v) for i, v in enumerate(near)], "k int, value double")
    cells = spark.createDataFrame([(i % 3, n) for i, n in enumerate(numbers)], "k int, number double")

    def fits(v, c):
        return 199 * abs(c) <= 200 * abs(v) <= 201 * abs(c) and (v > 0) == (c > 0) or v == c

    expected = {(i % 3, v) for i, v in enumerate(near) if any(j % 3 == i % 3 and fits(v, c) for j, c in enumerate(numbers))}
    got = {(r.k, r.value) for r in ev.band_matches(wanted, cells, "k").collect() if (r.k, r.value) in {(i % 3, v) for i, v in enumerate(near)}}
    assert got == expected
    as_cells = cells.withColumnRenamed("number", "value")
    covered = {(r.k, r.value) for r in ev.covered_cells(as_cells, wanted, "k").collect()}
    assert covered == {(j % 3, c) for j, c in enumerate(numbers) if any(i % 3 == j % 3 and fits(v, c) for i, v in enumerate(near))}


def test_set_grades(spark):
    gold = spark.createDataFrame([("a", 100.0), ("a", 200.0), ("b", 100.0), ("c", 100.0), ("d", 1.0)], "q string, value double")
    response = spark.createDataFrame([("a", 100.4), ("a", 200.0), ("b", 100.0), ("b", 7.0), ("c", 102.0), ("d", 1.0)], "q string, value double")
    questions = spark.createDataFrame([("a", "t", False), ("b", "t", False), ("c", "o", False), ("d", "x", True)], "q string, category string, refused boolean")
    graded = grading.grade_sets(questions, gold, response, "q")
    assert {r.q: (r.superset_ok, r.exact_ok) for r in graded.collect()} == {
        "a": (True, True), "b": (True, False), "c": (False, False), "d": (False, False),
    }
    first = graded.select("q", F.col("exact_ok").alias("passed"))
    second = graded.select("q", F.col("superset_ok").alias("passed"))
    assert [tuple(r) for r in grading.changed(first, second, "q").collect()] == [("b", "improved")]
    assert tuple(grading.paired(first, second, "q").first()) == (4, 1, 2, 1, 0)


def test_verdicts_include_answers_without_claims(spark):
    answers = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    matched = spark.createDataFrame([(1, True), (1, False), (2, True)], "id int, matched boolean")
    got = {r.id: (r.checked_count, r.unmatched_count, r.verdict) for r in ev.verdicts(matched, answers, "id").collect()}
    assert got == {1: (2, 1, "fail"), 2: (1, 0, "pass"), 3: (0, 0, "pass")}


VECTORS = "vec_id bigint, embedding array<float>"


def test_retrieval_order_leave_one_out_and_threshold(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.2]), (3, [0.0, 1.0])], VECTORS)
    query = spark.createDataFrame([(9, [1.0, 0.0])], VECTORS)
    assert [r.vec_id for r in retrieval.cosine_top_k(query, index, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r.vec_id for r in retrieval.cosine_top_k(query, index, 3, minimum=0.99).collect()] == [1]
    own = retrieval.cosine_top_k(index, index, 3, leave_one_out=True)
    assert own.where("query_id = vec_id").count() == 0 and own.count() == 6
    with pytest.raises(ValueError):
        retrieval.cosine_top_k(query, index, 0)


def test_retrieval_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(200, 8)).astype(np.float32)
    matrix[50] = matrix[20]  # an equal pair, ordered by id
    matrix[7] = 0  # no direction: similarity zero
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], VECTORS)
    got = {}
    for r in retrieval.cosine_top_k(frame, frame, 4, leave_one_out=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    wide = matrix.astype(np.float64)
    norms = np.linalg.norm(wide, axis=1)
    unit = np.divide(wide, norms[:, None], out=np.zeros_like(wide), where=norms[:, None] > 0)
    sims = np.round(unit @ unit.T, 9)
    for q in range(200):
        order = sorted((x for x in range(200) if x != q), key=lambda x: (-sims[q, x], x))[:4]
        assert got[q] == order


def test_mixed_dimensions_are_refused(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0])], VECTORS)
    with pytest.raises(Exception, match="different dimensions"):
        retrieval.cosine_top_k(index.limit(1), index, 1).collect()


def test_dimension_check(spark):
    same = spark.createDataFrame([(1, [1.0]), (2, [2.0])], VECTORS)
    mixed = spark.createDataFrame([(1, [1.0]), (2, [2.0, 3.0])], VECTORS)
    empty = spark.createDataFrame([(1, []), (2, [])], VECTORS)
    assert [retrieval.dimension_check(f).first().consistent for f in (same, mixed, empty)] == [True, False, False]


def test_retrieval_on_a_grid_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    monkeypatch.setattr(retrieval, "CELL_ROWS", 40)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5))
    index = np.concatenate([centres[rng.integers(0, 6, 180)] + 0.01 * rng.normal(size=(180, 5)), np.repeat(centres[:1], 25, axis=0)])
    asked = np.concatenate([index[::9], np.zeros((1, 5)), rng.normal(size=(10, 5))])
    frames = [
        spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(side.astype(np.float32))], VECTORS) for side in (asked, index)
    ]
    units = []
    for side in (asked, index):
        wide = side.astype(np.float32).astype(np.float64)
        norms = np.linalg.norm(wide, axis=1)
        units.append(np.divide(wide, norms[:, None], out=np.zeros_like(wide), where=norms[:, None] > 0))
    sims = np.round(units[0] @ units[1].T, 9)
    for k, minimum in ((3, None), (30, None), (4, 0.999)):
        got = {}
        for r in retrieval.cosine_top_k(*frames, k, minimum=minimum).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, round(r.similarity, 9)))
        for q in range(len(asked)):
            ranked = sorted((-sims[q, x], x) for x in range(len(index)) if minimum is None or sims[q, x] >= minimum)[:k]
            # Products of blocks may differ from the whole product in the last digit, so near ties may swap.
            assert [s for _, s in got.get(q, [])] == pytest.approx([-s for s, _ in ranked], abs=2e-9)
    plan = retrieval.cosine_top_k(*frames, 3)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_blocks_are_skipped_by_centre_and_radius():
    centres, radii = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), np.array([0.1, 0.1, 0.1])
    order, bounds = retrieval.nearest_blocks(centres, radii, np.array([1.0, 0.0]), 0.0)
    assert order.tolist() == [0, 1, 2] and bounds[0] == 1.0 and bounds[1] < 0.2 and bounds[2] < -0.7


def test_literals_are_blanked_longest_first(spark):
    cases = [
        ("Bay 12 and Bay 1, not Bay 123", ["Bay 1", "Bay 12"], "  and  , not Bay 123"), (r"a\E b.c x", [r"a\E", "b.c"], "    x"),
        ("b-c bXc", ["b.c"], "b-c bXc"), ("same same", ["same"], "   "), ("none", [], "none"), ("xBay 1", ["Bay 1"], "xBay 1"),
    ]
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "id int, t string")
    literals = spark.createDataFrame([(i, l) for i, (_, ls, _) in enumerate(cases) for l in ls], "id int, literal string")
    masked = ev.mask_literals(texts, "id", "t", literals)
    assert [r.t for r in masked.orderBy("id").collect()] == [e for _, _, e in cases]
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_columns_are_graded_by_their_check(spark):
    def cells(data, column):
        out = []
        for q, rows_ in data.items():
            for n, row in enumerate(rows_):
                for c, value in enumerate(row):
                    number = float(value) if not isinstance(value, str) else None
                    out.append((q, c, n, number, None if number is not None else value))
        return spark.createDataFrame(out, f"q string, {column} int, row int, number double, text string")

    gold = {
        "ids": [("P1", "bolt"), ("P2", "nut")], "names": [("P1", "bolt"), ("P2", "nut")], "more": [("P1", 5.0)], "exact": [(5.0, "a"), (6.0, "b")],
        "given": [("P1", 40.0)], "lacks": [("P1", 40.0, 7.0)], "refused": [("x",)],
    }
    response = {
        "ids": [(1.0, "P2"), (2.0, "P1")], "names": [("nut", 3.0), ("bolt", 1.0), ("screw", 2.0)], "more": [("P1", 9.0), ("P3", 9.0)],
        "exact": [("c", 5.0), ("d", 6.01), ("e", 7.0)], "given": [("zz", 40.1)], "lacks": [("P1", 40.0)], "refused": [("x",)],
    }
    questions = spark.createDataFrame(
        [("ids", "exact_set", False, ""), ("names", "superset", False, ""), ("more", "exact_set", False, ""), ("exact", "exact_set", False, ""),
         ("given", "contains_values", False, "stock of P1"), ("lacks", "contains_values", False, ""), ("refused", "superset", True, ""),
         ("nothing", "superset", False, "")],
        "q string, check string, refused boolean, question string",
    )
    graded = grading.grade_columns(questions, cells(gold, "gold_column"), cells(response, "response_column").drop("row"), "q")
    assert {r.q: r.passed for r in graded.collect()} == {
        "ids": True, "names": True, "more": False, "exact": False, "given": True, "lacks": False, "refused": False, "nothing": False,
    }
