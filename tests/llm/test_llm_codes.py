from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import SMALL, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from shortfall.llm import grid_codes, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


def plain(data, parts=8, entries=16, rounds=6, scale=4096):
    """All distances of all parts, in whole numbers of Python."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in data if usable(v)]
    width = len(kept[0][1]) // parts
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    ids = sorted((i for i in first if i is not None))[:entries]
    ids += [None] if len(ids) < entries and None in first else []
    cut = [(i, [v[p * width : (p + 1) * width] for p in range(parts)], label) for i, v, label in kept]
    books = [[first[i][p * width : (p + 1) * width] for i in ids] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in cut:
                groups.setdefault(nearest(p, v[p])[1], []).append(v[p])
            for k, members in groups.items():
                books[p][k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = []
    for i, v, label in cut:
        best = [nearest(p, v[p]) for p in range(parts)]
        found.append((i, label, [k for _, k in best], sum(d for d, _ in best)))
    by_label = {}
    for _, label, _, error in found:
        by_label[label] = by_label.get(label, 0) + error
    return sorted(((*f, by_label[f[1]]) for f in found), key=str), books


def check(spark, data, **settings_):
    frame = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS v", "2 AS codes", "3 AS error", "4 AS of")
    found = grid_codes.compress(frame.repartition(3), **settings_)
    expected, books = plain(data, **settings_)
    assert found.codebooks.tolist() == books
    assert rows(found.frame.select("vec_id", "label", "codes", "error", "label_error")) == expected


def test_given_vectors(spark):
    table = queries.table(spark, SMALL, "embeddings")
    data = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    expected, books = plain(data)
    found = rows(queries.op13_grid_codes(spark, SMALL).select("vec_id", "code", "error", "label_error"))
    assert found == sorted(
        ((i, "".join(f"{k:02x}" for k in codes), error, total) for i, _, codes, error, total in expected), key=str
    )


def test_odd_vectors(spark):
    data = [
        (5, [0.0, 1.0, -1.0, 0.5], 1), (3, [0.0, 1.0, -1.0, 0.5], 1), (3, [0.5, 0.5, 0.5, 0.5], None),
        (9, None, 1), (8, [], 2), (7, [0.0, None, 0.0, 0.0], 2), (6, [float("nan"), 0.0, 0.0, 0.0], 2),
        (2, [float("inf"), 0.0, 0.0, 0.0], 3), (None, [-0.00001, 0.00001, 0.3, 0.7], None), (1, [30000.0, -30000.0, 1.0, 2.0], 4),
        *[(100 + i, [0.25, 0.25, 0.25, 0.25], 7) for i in range(60)],
    ]
    check(spark, data, parts=2, entries=4, rounds=3)
    check(spark, data, parts=4, entries=100, rounds=2)
    check(spark, data[:3], parts=2, entries=16, rounds=6)


def test_two_empty_entries_keep_their_place(spark):
    data = [(i, [1.0, 1.0], 0) for i in range(6)] + [(9, [2.0, 2.0], 0)]
    check(spark, data, parts=1, entries=4, rounds=2)


def test_vectors_of_different_lengths_are_refused(spark):
    frame = spark.createDataFrame([(1, [0.0] * 8, 0), (2, [0.0] * 16, 0)], SCHEMA)
    with pytest.raises(ValueError, match="8 to 16 components"):
        grid_codes.compress(frame)


def test_empty_table(spark):
    for data in ([], [(1, None, 0)]):
        found = grid_codes.compress(spark.createDataFrame(data, SCHEMA))
        assert rows(found.frame) == [] and found.codebooks.size == 0
        assert found.frame.columns == ["vec_id", "label", "codes", "error", "label_error"]


@given(st.integers(1, 20), st.integers(1, 5), st.sampled_from([1, 40, 5000, 10**8]), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_cells_keep_the_nearest_entry(entries, width, spread, seed):
    rng = np.random.default_rng(seed)
    grid = grid_codes.Grid(rng.integers(-spread, spread + 1, (entries, width)))
    parts = rng.integers(-2 * spread, 2 * spread + 1, (60, width))
    parts = np.concatenate([parts, grid.entries, parts[:5]])
    distances = ((parts[:, None] - grid.entries) ** 2).sum(axis=2)
    for _ in range(2):  # the second time from the memo
        index, distance = grid.nearest(parts)
        assert (index == distances.argmin(axis=1)).all() and (distance == distances.min(axis=1)).all()


def test_outer_cells_and_a_full_memo():
    grid = grid_codes.Grid(np.array([[0, 0], [8, 8]]))
    parts = np.array([[-(10**8), 5], [10**8, -(10**8)], [4, 4], [4, 5]])
    assert grid.nearest(parts)[0].tolist() == [0, 0, 0, 1]
    kept, grid_codes.MEMO_CELLS = grid_codes.MEMO_CELLS, 2
    try:
        for _ in range(3):
            assert grid.nearest(parts)[0].tolist() == [0, 0, 0, 1]
        assert len(grid.memo) <= 4
    finally:
        grid_codes.MEMO_CELLS = kept
