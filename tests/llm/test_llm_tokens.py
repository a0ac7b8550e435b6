from __future__ import annotations

from collections import Counter

import pytest
from conftest import rows
from llm_cases import documents, empty, odd_documents, with_clashing
from public_tokenizers import path

from shortfall.llm import token_cache

MODEL = path("piece_bpe_32k.model")
TEXTS = ["<s> and </s> in a text", "  two  blanks ", "\t\n", "日本語 🙂 ﬁ", "same", "same", None, ""]


def library(texts):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=MODEL)
    return [len(x) for x in model.encode([t or "" for t in texts])]


def test_counts_are_the_library_s(spark, tmp_path):
    docs = odd_documents(spark).unionByName(documents(spark, TEXTS, ids=range(100, 108)))
    found = token_cache.count_tokens(with_clashing(docs), MODEL, str(tmp_path / "cache"), limit=20).collect()
    given = docs.collect()
    counts = library([r["text"] for r in given])
    expected = Counter(
        (r["doc_id"], len((r["text"] or "").encode()), n, n > 20) for r, n in zip(given, counts, strict=True)
    )
    assert Counter(map(tuple, found)) == expected


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_json_vocabularies(spark, tmp_path, name):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path(name))
    docs = documents(spark, TEXTS)
    found = token_cache.count_tokens(docs, path(name), str(tmp_path / "cache")).collect()
    for r in found:
        assert r["n_tokens"] == len(model.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids)


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = documents(spark, ["a b", "a b", "c"])
    token_cache.count_tokens(first, MODEL, cache).count()
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    # Counts that are in the cache are taken from it, not made anew.
    marked = str(tmp_path / "marked")
    stored.selectExpr("digest", "n_tokens + 1000 as n_tokens", "tokenizer").write.partitionBy("tokenizer").parquet(marked)
    again = token_cache.count_tokens(documents(spark, ["c", "a b", "new text", "new text"]), MODEL, marked)
    counts = {r["doc_id"]: r["n_tokens"] for r in again.collect()}
    assert counts[0] > 1000 and counts[1] > 1000 and counts[2] == counts[3] < 1000
    assert spark.read.parquet(marked).count() == 3
    # Another vocabulary has a version of its own.
    other = token_cache.count_tokens(first, path("byte_bpe_50k.json"), marked)
    assert all(r["n_tokens"] < 1000 for r in other.collect())


def test_empty_table(spark, tmp_path):
    assert rows(token_cache.count_tokens(empty(spark), MODEL, str(tmp_path / "cache"))) == []


def test_a_repeated_row_is_encoded_once(spark, tmp_path):
    docs = documents(spark, ["one text here", "another"], ids=[4, 4])
    docs = docs.unionByName(docs).unionByName(docs.limit(1))
    cache = str(tmp_path / "cache")
    found = token_cache.count_tokens(docs, path("piece_bpe_32k.model"), cache)
    assert found.count() == 5 and spark.read.parquet(cache).count() == 2
