from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from conftest import rows
from llm_cases import documents, empty, odd_documents, with_clashing, words

from shortfall.llm import mixing


def key48(doc_id):
    return int(hashlib.md5(("null" if doc_id is None else str(doc_id)).encode()).hexdigest()[:12], 16)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Reshares what is over, round by round, until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, open_names = share * sum(sizes.values()), {}, set(names)
    while open_names:
        total = sum(weight[s] for s in open_names)
        full = {s for s in open_names if budget * weight[s] / total > most * sizes[s]}
        if not full:
            target |= {s: budget * weight[s] / total for s in open_names}
            break
        for s in full:
            target[s] = float(most * sizes[s])
            budget -= target[s]
        open_names -= full
    return target


def brute(docs):
    sized = [(r["doc_id"], r["source"], len(words(r["text"]))) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, source, size in sized:
        sizes[source] += size
    targets = brute_targets(sizes)
    out = []
    for source, size in sizes.items():
        members = sorted((key48(d), d, n) for d, s, n in sized if s == source)
        rounds = int(targets[source] // size) if size else 0
        rest = targets[source] - rounds * size
        taken_keys, done = set(), 0
        for h in sorted({m[0] for m in members}):
            here = sum(n for k, _, n in members if k == h)
            if done + here > rest:
                if done + here - rest < rest - done:
                    taken_keys.add(h)
                break
            taken_keys.add(h)
            done += here
        out += [(d, n, source, size, n * (rounds + (k in taken_keys))) for k, d, n in members]
    return Counter(out), targets


@pytest.mark.parametrize("kind", ["odd", "hot", "even"])
def test_mix_equals_brute_force(spark, kind):
    if kind == "odd":
        docs = odd_documents(spark)
    else:
        texts = [" ".join(["w"] * (1 + i * 7 % 40)) for i in range(600)]
        sources = [("hot" if i % 3 or kind == "hot" and i % 30 else f"s{i % 7}") for i in range(600)]
        docs = documents(spark, texts, sources)
    expected, targets = brute(docs)
    found = mixing.mix(with_clashing(docs)).collect()
    assert Counter((r["doc_id"], r["size"], r["source"], r["source_size"], r["taken"]) for r in found) == expected
    for r in found:
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] <= 2 * r["size"]


def test_targets_are_met(spark):
    docs = documents(spark, [" ".join(["w"] * (1 + i % 9)) for i in range(3000)], [f"s{i % 6}" for i in range(3000)])
    taken, target = defaultdict(int), {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 9 for s in target)


def test_rows_as_often_as_taken(spark):
    docs = with_clashing(odd_documents(spark))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    total = Counter()
    for r in mixing.mix(docs).collect():
        total[r["source"]] += r["taken"]
    got = Counter()
    for r in mixed.collect():
        got[r["source"]] += len(words(r["text"]))
    assert +got == +total


def test_empty_tables(spark):
    assert rows(mixing.mix(empty(spark))) == []
    assert rows(mixing.mixed_rows(empty(spark))) == []
    blank = documents(spark, ["", None, " "])
    assert {(r["size"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0, 0)}
