from __future__ import annotations

from collections import defaultdict

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents, empty, odd_documents, with_clashing, words

from shortfall.llm import packing

LENGTHS = (8, 16, 32)


def plain(sizes, lengths, cost):
    """Best fit by looking at every open bin."""
    bins, capacity, places = [], [], []
    for i, size in enumerate(sizes):
        left = sum(sizes[i + 1 :])
        fits = [(capacity[b] - sum(bins[b]), b) for b in range(len(bins)) if capacity[b] - sum(bins[b]) >= size]
        fits = [x for x in fits if x[0] > 0]
        if fits:
            room = min(fits)[0]
            places.append(room)
            b = next(b for r, b in reversed(fits) if r == room)
        else:
            length = min((n for n in lengths if n >= size), key=lambda n: (cost(n) / (size + min(n - size, left)), n))
            b = len(bins)
            bins.append([])
            capacity.append(length)
            places.append(length)
        bins[b].append(size)
    return places, [min(n for n in lengths if n >= sum(b)) for b in bins]


@given(st.lists(st.integers(1, 32), max_size=60), st.sampled_from([lambda n: n, lambda n: 4 + n, lambda n: n + n * n / 20]))
@settings(max_examples=80, deadline=None)
def test_best_fit_rules(sizes, cost):
    sizes = sorted(sizes, reverse=True)
    bins, positions, capacities = packing.best_fit(sizes, LENGTHS, cost)
    filled = defaultdict(int)
    for size, b, position in zip(sizes, bins, positions, strict=True):
        assert position == filled[b]  # no gap, no overlap
        filled[b] += size
    assert all(capacities[b] == min(n for n in LENGTHS if n >= used) for b, used in filled.items())
    # Which of two bins with equal room is taken does not change the lengths of the bins.
    assert sorted(capacities) == sorted(plain(sizes, LENGTHS, cost)[1])


def test_least_cost_length_is_opened():
    assert packing.best_fit([8, 8, 8, 8], LENGTHS, lambda n: 10 + n)[2] == [32]
    assert packing.best_fit([8, 8, 8, 8], LENGTHS, lambda n: n * n)[2] == [8, 8, 8, 8]
    assert packing.best_fit([20, 3], LENGTHS, lambda n: n)[2] == [32]
    assert packing.best_fit([5], LENGTHS, lambda n: 10 + n)[2] == [8]  # shrunk to its contents


def check(docs, found, largest):
    expected = sorted((str(r["doc_id"]), len(words(r["text"]))) for r in docs.collect())
    by_row, by_bin = defaultdict(int), defaultdict(list)
    for r in found:
        if r["piece"] == 0:
            by_row[str(r["doc_id"])] += 1
        assert r["start"] == r["piece"] * largest
        if r["bin_id"] is None:
            assert r["n_words"] == 0 and r["capacity"] is None and r["position"] is None
        else:
            by_bin[r["bin_id"]].append(r)
    assert sum(by_row.values()) == len(expected)
    assert sum(r["n_words"] for r in found) == sum(n for _, n in expected)
    for members in by_bin.values():
        end = 0
        for r in sorted(members, key=lambda r: r["position"]):
            assert r["position"] == end
            end += r["n_words"]
        assert end <= members[0]["capacity"] and len({r["capacity"] for r in members}) == 1


def test_documents(spark):
    docs = odd_documents(spark)
    check(docs, packing.pack_documents(with_clashing(docs)).collect(), max(packing.LENGTHS))
    check(docs, packing.pack_documents(docs, lengths=LENGTHS, group_rows=50).collect(), 32)


def test_little_waste_over_many_groups(spark):
    docs = documents(spark, [" ".join(["w"] * (1 + i * i % 300)) for i in range(3000)])
    found = packing.pack_documents(docs, group_rows=500).collect()
    check(docs, found, max(packing.LENGTHS))
    capacity = {r["bin_id"]: r["capacity"] for r in found if r["bin_id"] is not None}
    assert sum(capacity.values()) < 1.05 * sum(r["n_words"] for r in found)
    assert len({b >> packing.GROUP_BITS for b in capacity}) > 3


def test_empty_table(spark):
    assert rows(packing.pack_documents(empty(spark))) == []
