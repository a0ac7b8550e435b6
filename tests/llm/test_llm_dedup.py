from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from conftest import rows
from llm_cases import documents, empty, odd_documents, squeezed, with_clashing

from shortfall.llm import dedup


def order(row):
    return -len(row["text"] or ""), row["doc_id"] is None, row["doc_id"] or 0


def brute(docs):
    groups = defaultdict(list)
    for row in docs.collect():
        groups[squeezed(row["text"])].append(row)
    return groups


def test_refine_equals_brute_force(spark):
    docs = odd_documents(spark)
    got = defaultdict(list)
    for row in dedup.refine(with_clashing(docs)).collect():
        got[row["text_sha256"]].append(row)
    groups = brute(docs)
    assert {hashlib.sha256(k.encode()).hexdigest() for k in groups} == set(got)
    for text, members in groups.items():
        found = got[hashlib.sha256(text.encode()).hexdigest()]
        best = min(members, key=order)
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(m["doc_id"]) for m in members)
        assert {r["keep_id"] for r in found} == {best["doc_id"]}
        assert {r["group_size"] for r in found} == {len(members)}
        assert [r["doc_id"] for r in found if r["kept"]] == [best["doc_id"]]


def test_digests_only_where_needed(spark):
    docs = documents(spark, ["abc", "abd", "abc", "longer text", "x" * 64 + "a", "x" * 64 + "b"])
    found = {r["doc_id"]: r["text_sha256"] for r in dedup.refine(docs, all_hashes=False).collect()}
    assert found[3] is None and found[1] is None  # settled by length and prefix
    assert found[0] == found[2] is not None
    assert found[4] != found[5]  # same length and prefix, told apart by the full hash


def test_prefixes_only_where_a_length_is_shared(spark):
    docs = documents(spark, ["abc", "a b d", "longer text", "other  texts", None, "", "four", "seventeen letters"])
    lengths = dedup.shared_lengths(docs, "text")
    assert sorted(r[0] for r in lengths.collect()) == [0, 3, 10]
    found = dedup.with_prefix(docs, "text", lengths).collect()
    assert {r["doc_id"] for r in found if r["prefix"] is not None} == {0, 1, 2, 3, 4, 5}
    assert [(r["length"], r["n"]) for r in dedup.open_pairs(docs, "text", lengths).collect()] == [(0, 2)]  # the empty texts


def test_settled_texts_are_not_shuffled(spark):
    docs = documents(spark, ["abc", "a b c", *(f"text {i}" + "x" * i for i in range(40))])
    plan = dedup.keep_one(docs)._jdf.queryExecution().optimizedPlan().toString()
    settled, joined = plan.index("Union"), plan.index("LeftOuter", plan.index("Union"))
    assert settled < joined and dedup.keep_one(docs).count() == 41


def test_sets_of_hashes(spark):
    from pyspark.sql import functions as F

    from shortfall.llm.common import hash_bits, with_mark

    keys = spark.range(5000).select(F.col("id").alias("a"), F.lit("x").alias("b"))
    bits = hash_bits(keys, "a", "b")
    asked = spark.range(20000).select(F.col("id").alias("a"), F.lit("x").alias("b"))
    found = with_mark(asked, bits, "a", "b")
    assert found.where("marked and a < 5000").count() == 5000 and found.where("marked and a >= 5000").count() < 20
    assert with_mark(asked.withColumn("b", F.lit(None).cast("string")), bits, "a", "b").where("marked").count() == 0
    few = hash_bits(keys, "a", "b", buckets=64)
    assert few.count() == 1 and with_mark(asked, few, "a", "b", buckets=64).where("marked").count() == 20000


def test_open_pairs_in_every_bit_of_a_word(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKETS", 128)  # most bits are set, and settled rows may be hashed too
    docs = documents(spark, [f"t{i // 2} {'x' * (i // 2 % 40)}" for i in range(600)] + [f"single {i}" for i in range(50)])
    found = dedup.refine(docs, all_hashes=False)
    assert found.where("kept").count() == 350 and found.where("group_size = 2").count() == 600
    assert dedup.keep_one(docs).count() == 350


def test_keep_one_keeps_columns_and_one_of_each(spark):
    docs = with_clashing(odd_documents(spark))
    kept = dedup.keep_one(docs)
    assert kept.columns == docs.columns
    groups = brute(docs)
    assert sorted(map(str, (min(m, key=order)["doc_id"] for m in groups.values()))) == sorted(
        str(r["doc_id"]) for r in kept.collect()
    )
    assert kept.count() == len(groups)


def test_hot_group(spark):
    docs = documents(spark, ["same text"] * 400 + [f"other {i}" for i in range(800)])
    found = dedup.refine(docs)
    assert found.where("kept").count() == 801
    assert found.where("group_size = 400").count() == 400


@pytest.mark.parametrize("apply", [dedup.refine, dedup.keep_one])
def test_empty_table(spark, apply):
    assert rows(apply(empty(spark))) == []
