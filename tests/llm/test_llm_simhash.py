from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import SMALL, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import Sets, documents, empty, odd_documents, with_clashing, words
from xxhash import xxh64_intdigest

from shortfall.llm import simhash
from shortfall.llm.components import components


def plain_print(text, width=3):
    tokens = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + width]) for i in range(max(1, len(tokens) - width + 1))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(docs):
    found = [(r["doc_id"], plain_print(r["text"])) for r in docs.collect()]
    prints = sorted({p for _, p in found})
    sets = Sets(prints)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                sets.join(a, b)
    least = {}
    for doc_id, p in found:
        root = sets.find(p)
        ids = [x for x in (least.get(root), doc_id) if x is not None]
        least[root] = min(ids) if ids else None
    return sorted(((d, p, least[sets.find(p)]) for d, p in found), key=str)


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def near_copies(seed=7, count=160):
    pick = random.Random(seed)
    texts = []
    for i in range(count):
        base = [f"w{pick.randrange(5000)}" for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(i % 4):
            copy = list(base)
            copy[pick.randrange(400)] = "changed"
            texts.append(" ".join(copy))
    return texts


@given(st.text(alphabet="abC dé\n\t", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.simhash(text) == plain_print(text)


def test_fingerprint_of_long_texts():
    text = " ".join(f"word{i % 977}" for i in range(70_000))  # more than one block of shingles
    assert simhash.simhash(text) == plain_print(text)


def test_bk_search_equals_brute_force():
    pick = random.Random(3)
    base = [pick.getrandbits(64) for _ in range(300)]
    near = [b ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for b in base[:150]]
    values = np.array(sorted({*base, *near}), np.uint64)
    child = simhash.bk_tree(values)
    for radius in (0, 1, 2, 5):
        got = {(int(q), int(n)) for qs, ns in simhash.bk_search(values, child, values, radius) for q, n in zip(qs, ns, strict=True)}
        ints = [int(v) for v in values]
        assert got == {(i, j) for i, a in enumerate(ints) for j, b in enumerate(ints) if (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("tree_nodes", [4096, 64, 5])
def test_links_join_what_all_pairs_join(spark, tree_nodes):
    """Also with small shards, and with shards that are cut into parts."""
    pick = random.Random(5)
    hub = 0x0123456789ABCDEF
    prints = {pick.getrandbits(64) for _ in range(250)} | {hub ^ (1 << i) for i in range(64)} | {hub}
    prints |= {p ^ 3 for p in list(prints)[:60]}
    prints |= {(hub & ~0xFFFFF) | pick.getrandbits(20) for _ in range(60)}  # a hot block
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    sets = Sets(sorted(prints))
    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 2:
                sets.join(a, b)
    found = Sets(ordered)
    links = simhash.near_links(frame, tree_nodes=tree_nodes).collect()
    for r in links:
        a, b = (x % (1 << 64) for x in r)
        assert sets.find(a) == sets.find(b)
        found.join(a, b)
    assert all(found.find(p) == sets.find(p) for p in ordered)


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    pick = random.Random(11)
    links = {
        "random": [(pick.randrange(300), pick.randrange(300)) for _ in range(220)],
        "chain": [(i, i + 1) for i in range(150)],
        "star": [(700, i) for i in range(300)],
    }[kind]
    sets = Sets(sorted({n for link in links for n in link}))
    for a, b in links:
        sets.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "x bigint, y bigint"), "x", "y").collect()}
    assert got == {n: sets.find(n) for n in sets.parent if sets.find(n) != n}


def test_groups_equal_brute_force(spark):
    odd = odd_documents(spark)
    for docs in (with_clashing(odd), documents(spark, near_copies())):
        got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect()]
        assert sorted(got, key=str) == plain_groups(docs)


def test_groups_of_the_small_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect()]
    assert sorted(got, key=str) == plain_groups(docs)


def test_empty_table(spark):
    assert rows(simhash.near_groups(empty(spark))) == []
