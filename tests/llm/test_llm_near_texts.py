from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL, rows
from llm_cases import Sets, documents, empty, odd_documents, with_clashing, words

from shortfall.llm import near_texts


def shingles(text):
    tokens = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_groups(docs, least=0.8):
    """doc_id -> least doc_id of its group, by all pairs."""
    found = [(r["doc_id"], shingles(r["text"])) for r in docs.collect() if r["doc_id"] is not None]
    sets = Sets([d for d, _ in found])
    for i, (a, x) in enumerate(found):
        for b, y in found[:i]:
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and similarity(x, y) >= least:
                sets.join(a, b)
    return {d: sets.find(d) for d, _ in found}


def kept_ids(frame):
    return sorted(r["doc_id"] for r in frame.collect())


def copies(seed=5, count=60, length=300):
    """Texts with copies in which one to three words are others, and pairs that share half their words."""
    pick = random.Random(seed)
    texts = []
    for i in range(count):
        base = [f"w{pick.randrange(5000)}" for _ in range(length)]
        texts.append(" ".join(base))
        for k in range(i % 4):
            copy = list(base)
            for _ in range(k + 1):
                copy[pick.randrange(length)] = f"x{pick.randrange(5000)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(base[: length // 2] + [f"y{pick.randrange(5000)}" for _ in range(length // 2)]))
    return texts


def test_near_copies_go_and_others_stay(spark):
    docs = documents(spark, copies())
    groups = plain_groups(docs)
    assert len(set(groups.values())) == 120  # copies meet, halves stay
    assert kept_ids(near_texts.keep_one(docs)) == sorted(set(groups.values()))


def test_full_shards_are_cut(spark):
    docs = documents(spark, copies(seed=6, count=4) + copies(seed=6, count=1, length=300) * 2)
    pick = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    group = []
    for _ in range(40):
        copy = list(base)
        copy[pick.randrange(300)] = f"z{pick.randrange(9999)}"
        group.append(" ".join(copy))
    docs = documents(spark, [r["text"] for r in docs.collect()] + group)
    assert kept_ids(near_texts.keep_one(docs, tree_nodes=4)) == sorted(set(plain_groups(docs).values()))


def test_small_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert kept_ids(near_texts.keep_one(docs)) == sorted(set(plain_groups(docs).values()))


def test_odd_rows(spark):
    docs = with_clashing(odd_documents(spark))
    kept = near_texts.keep_one(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert sum(r["doc_id"] is None for r in left) == docs.where("doc_id is null").count()
    got = {(r["doc_id"], r["text"]) for r in left if r["doc_id"] is not None}
    # Of each set of equal shingles the least id stays; the second row with id 3 has a text of its own.
    sets = {}
    for r in docs.where("doc_id is not null").collect():
        sets.setdefault(frozenset(shingles(r["text"])), []).append(r["doc_id"])
    assert sorted(d for d, _ in got) == sorted(min(ids) for ids in sets.values())


def two_groups(seed, size=6):
    """Two groups of near copies that meet in one pair at exactly 0.8, among many just under it."""
    pick = random.Random(seed)
    first = [f"w{pick.randrange(9**6)}" for _ in range(400)]
    second = [*first[:50], *(f"y{pick.randrange(9**6)}" for _ in range(40)), *first[90:]]
    ends = [[], *([f"z{i}"] for i in range(1, size))]
    return [" ".join([*base, *(f"{k}{x}" for x in end)]) for k, base in enumerate((first, second)) for end in ends]


@pytest.mark.parametrize("pairs", [1, 4096])
def test_one_link_among_nearer_pairs_that_fail(spark, monkeypatch, pairs):
    monkeypatch.setattr(near_texts, "HELD_PAIRS", pairs)
    monkeypatch.setattr(near_texts, "CHECKED_PAIRS", pairs)
    docs = documents(spark, two_groups(16))
    assert set(plain_groups(docs).values()) == {0}
    assert kept_ids(near_texts.keep_one(docs)) == [0]


def test_same_id_other_text(spark):
    texts = copies(seed=8, count=4)
    docs = documents(spark, [texts[1], texts[0], texts[2]], ids=[7, 7, 1])
    assert near_texts.keep_one(docs).count() == len(plain_groups(documents(spark, [texts[1], texts[0], texts[2]])))


def test_empty_table(spark):
    assert rows(near_texts.keep_one(empty(spark))) == []


@pytest.mark.parametrize("reach", [0, 40, 110, 300])
def test_tree_finds_what_is_within_reach(reach):
    pick = np.random.default_rng(3)
    base = pick.integers(0, 1 << 63, (40, 8), dtype=np.uint64)
    near = base.repeat(5, axis=0)
    for row in near:
        for bit in pick.integers(0, 512, 30):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    values = np.unique(np.concatenate([base, near]), axis=0)
    asked = np.concatenate([values[::3], pick.integers(0, 1 << 63, (9, 8), dtype=np.uint64)])
    found = {(int(q), int(n)): int(d) for part in near_texts.Tree(values).search(asked, reach) for q, n, d in zip(*part, strict=True)}
    far = np.bitwise_count(asked[:, None] ^ values[None]).sum(axis=2)
    assert found == {(q, n): int(far[q, n]) for q, n in zip(*np.nonzero(far <= reach), strict=True)}


def test_forest_is_least():
    pick = random.Random(4)
    links = sorted({(pick.randrange(30), pick.randrange(30)) for _ in range(90)})
    a, b = np.array(links).T
    far = np.array([pick.randrange(9) for _ in links])
    got = near_texts.forest(30, a, b, far)
    sets, weight = Sets(range(30)), 0
    for w, x, y in sorted(zip(far, a, b, strict=True)):
        if sets.find(x) != sets.find(y):
            sets.join(x, y)
            weight += w
    joined = Sets(range(30))
    for i in got:
        assert joined.find(a[i]) != joined.find(b[i])
        joined.join(a[i], b[i])
    assert far[got].sum() == weight
    assert all((sets.find(i) == sets.find(j)) == (joined.find(i) == joined.find(j)) for i in range(30) for j in range(i))


def cell_frame(texts, prefix=b""):
    by_word = near_texts.constants(near_texts.BITS // 64, near_texts.SEED)
    sets = [near_texts.shingle_hashes(t, 5, near_texts.SEED) for t in texts]
    return pd.DataFrame({
        "print": [near_texts.wide_print(h, by_word) for h in sets], "hashes": [h.tobytes() for h in sets],
        "in_tree": True, "asks": True,
    })


def linked_sets(frame, links):
    names = frame["print"].tolist()
    found = Sets(range(len(names)))
    for a, b in zip(*links, strict=True):
        assert found.find(names.index(a)) != found.find(names.index(b))  # a forest
        found.join(names.index(a), names.index(b))
    return [found.find(i) for i in range(len(names))]


@pytest.mark.parametrize("length", [8, 9])
def test_short_pairs_at_the_least_similarity_are_linked(length):
    """4 of 5 shingles; the fingerprints of one pair in twenty lie beyond the reach."""
    pick = random.Random(length)
    lost = 0
    for _ in range(750):
        base = [f"w{pick.randrange(9**6)}" for _ in range(length)]
        pair = [" ".join(base), " ".join([*base, "more"])] if length == 8 else [" ".join(base), " ".join(base[:-1])]
        a, b = (shingles(t) for t in pair)
        assert similarity(a, b) == 0.8
        frame = cell_frame(pair)
        lost += len(set(linked_sets(frame, near_texts.cell_links(frame, near_texts.reach_of(0.8), 0.8)))) > 1
    assert lost == 0


def test_a_large_group_under_the_least_similarity_stays_apart():
    """Templates with own words: all pairs lie a little under 0.8, one pair above."""
    pick = random.Random(1)
    shared = [f"w{pick.randrange(9**6)}" for _ in range(160)]
    texts = [" ".join([*shared, *(f"o{i}x{k}" for k in range(21))]) for i in range(400)]
    texts.append(texts[0] + " again")
    sets = [shingles(t) for t in texts]
    assert 0.7 < similarity(sets[0], sets[1]) < 0.8 < similarity(sets[0], sets[-1])
    frame = cell_frame(texts)
    links = near_texts.cell_links(frame, near_texts.reach_of(0.8), 0.8)
    assert linked_sets(frame, links) == [*range(400), 0] and len(links[0]) == 1


def test_cell_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(near_texts, "MANY_ROWS", 20)
    monkeypatch.setattr(near_texts, "LEADERS", 3)
    texts = [*dict.fromkeys([*copies(seed=3, count=25, length=60), "", "a", "a b c d e f", "a b c d e f g h i", "a b c d e f g h"])]
    frame = cell_frame(texts)
    frame = frame[~frame["print"].duplicated()].reset_index(drop=True)
    sets = [shingles(t) for t in texts]
    expected = Sets(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and similarity(x, y) >= 0.8:
                expected.join(i, j)
    assert len(frame) == len(texts)
    found = linked_sets(frame, near_texts.cell_links(frame, near_texts.reach_of(0.8), 0.8))
    assert found == [expected.find(i) for i in range(len(texts))]


def test_columns_named_like_the_keys(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, copies(seed=2, count=5))
    wide = docs.select("*", *(F.lit(f"extra {c}").alias(c) for c in ("gone_id", "gone_key", "text_key", "whole", "print", "cells", "shingles")))
    kept = near_texts.keep_one(wide)
    assert kept.columns == wide.columns and kept_ids(kept) == kept_ids(near_texts.keep_one(docs))
