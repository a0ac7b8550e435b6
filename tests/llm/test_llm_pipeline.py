from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from conftest import SMALL
from llm_cases import empty, squeezed, words
from test_llm_mixing import brute as brute_mix
from test_llm_packing import check as check_packing
from test_llm_near_texts import plain_groups

from shortfall.llm import lang_filters, packing
from shortfall.llm.common import stored
from shortfall.llm.queries import language_filters


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SMALL), "stage")
        found[name] = docs, after
        docs = after
    return found


def test_columns(stages):
    names = list(stages)
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(stages, spark):
    before, after = stages["language"]
    model = language_filters(before)
    letters = lang_filters.letter_table()
    expected = set()
    for r in before.collect():
        lang, _, share = model.predict(r["text"], letters)
        if lang != "und" and share >= lang_filters.MIN_COVERAGE:
            expected.add(r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == expected
    assert len(expected) > 0.97 * before.count()  # clean documents stay


def test_exact(stages):
    before, after = stages["exact dedup"]
    groups = defaultdict(list)
    for r in before.collect():
        groups[squeezed(r["text"])].append((-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(min(g)[1] for g in groups.values())


def test_near(stages):
    before, after = stages["near dedup"]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(plain_groups(before).values()))


def test_mix(stages):
    before, after = stages["mix"]
    times = Counter(r["doc_id"] for r in after.collect())
    for (doc_id, size, *_, taken), _ in brute_mix(before)[0].items():
        assert times[doc_id] * size == taken


def test_pack(stages):
    before, after = stages["pack"]
    check_packing(before, after.collect(), max(packing.LENGTHS))


def test_run_returns_what_the_stages_do(stages, spark):
    got = corpus_pipeline.run(spark, SMALL)
    before, after = stages["pack"]
    assert Counter((r["doc_id"], r["piece"], r["n_words"]) for r in got.collect()) == Counter(
        (r["doc_id"], r["piece"], r["n_words"]) for r in after.collect()
    )
    assert sum(r["n_words"] for r in got.collect()) == sum(len(words(r["text"])) for r in before.collect())


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SMALL).count() == 0
