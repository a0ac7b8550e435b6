from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents, empty, odd_documents, with_clashing

from shortfall.llm import queries, windows

MODEL = queries.vocabulary("word_bpe_49k.json")
SOME = ["a b", "", " \n", "<|endoftext|>", "A<|ENDOFTEXT|>B", "B<|endoftext|>C", "don't'S", "x<|startoftext|>y z", "ÉTÉ ΣΑΣ ΟΔΟΣ", "é ́e", "a b",
        "a\x1cb", "a b\x85c", "İI ﬁ ①", "日本語 テキスト", "1234 56", "\x00", "--- ...!?", "a​b", "🙂🙂 ok"]


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(MODEL).encode(text or "", add_special_tokens=False).ids, windows.END_ID]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


@given(st.lists(st.one_of(st.sampled_from(SOME), st.text(max_size=12)), max_size=6), st.sampled_from([" ", "\n", "  ", "\t", ""]))
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_the_text(whole, texts, between):
    text = between.join(texts)
    words = test_words_give_the_ids_of_the_text.__dict__.setdefault("kept", windows.WordIds(MODEL, most=3000))
    assert words.encode([text.encode()])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_texts_share_new_words(whole):
    found = windows.WordIds(MODEL).encode([t.encode() for t in [*SOME, *SOME]])
    assert [f.tolist() for f in found] == [whole.encode(t, add_special_tokens=False).ids for t in [*SOME, *SOME]]


def test_memo_forgets(whole):
    words = windows.WordIds(MODEL, most=10_000)
    text = " ".join(f"word{i}" for i in range(50)) + " " + "x" * 500
    for _ in range(3):
        assert words.encode([text.encode()])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
    memo = words.memo
    assert b"x" * 500 not in memo.young and len(memo.young) == 50
    assert words.encode([b"one word1"])[0].tolist() == whole.encode("one word1", add_special_tokens=False).ids
    assert set(memo.young) == {b"one", b"word1"} and len(memo.old) == 50  # met again, it moves
    assert words.encode([b"two"])[0].tolist() and len(memo.old) == 50


@given(st.lists(st.integers(1, 50), max_size=120), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_rules_of_windows(sizes, most):
    held = windows.Windows(16, most)
    emitted = {}
    for n, size in enumerate(sizes):
        before = {number: sum(p[2] for p in pieces) for number, pieces in held.contents.items()}
        out = list(held.add(n, np.arange(size, dtype="<u4")))
        assert len(held.rooms) == len(held.contents) <= most
        for number, pieces in out:
            assert number not in emitted and sum(p[2] for p in pieces) == 16
            emitted[number] = pieces
        rest = size % 16
        fitting = [16 - used for used in before.values() if 16 - used >= rest]
        if rest and fitting:  # best fit
            number = next(k for k, ps in (emitted | held.contents).items() if any(p[0] == n and p[1] == size - rest for p in ps))
            assert 16 - before[number] == min(fitting)
        elif rest and len(before) == most:  # the fullest was filled
            assert max(before, key=before.get) in emitted or max(before.values()) in [
                sum(p[2] for p in ps if p[0] != n) for ps in emitted.values()
            ]
    where = defaultdict(list)
    for pieces in [*emitted.values(), *held.contents.values()]:
        for n, start, length, ids, total in pieces:
            assert total == sizes[n] and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + length))
            where[n].append((start, length))
    for n, size in enumerate(sizes):
        ends = 0
        for start, length in sorted(where[n]):
            assert start == ends
            ends += length
        assert ends == size


def test_line_lengths():
    assert windows.line_lengths(40, 16) == [16, 16, 8]
    assert windows.line_lengths(13, 16) == [8, 4, 1]
    assert windows.line_lengths(32, 16) == [16, 16] and windows.line_lengths(0, 16) == []


def check(docs, found, length):
    """Whole ids, gapless sequences, no padding."""
    expected = sorted((str(r["doc_id"]), tuple(plain_ids(r["text"]))) for r in docs.collect())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[str(r["doc_id"])].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for members in by_sequence.values():
        end = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end == length or (end < length and end & (end - 1) == 0)
    spelled = defaultdict(int)
    for doc, ids in expected:
        spelled[doc] += len(ids)
    assert {d: sum(r["length"] for r in rs) for d, rs in by_doc.items()} == spelled
    for doc, ids in expected:  # each row's ids can be read from pieces that follow each other
        at = 0
        while at < len(ids):
            n = next(
                r["length"] for r in by_doc[doc]
                if r["start"] == at and r["doc_tokens"] == len(ids)
                and struct.unpack(f"<{r['length']}I", r["ids"]) == ids[at : at + r["length"]]
            )
            at += n


def test_documents(spark):
    docs = odd_documents(spark)
    wide = with_clashing(docs).selectExpr("*", "1 AS ids", "2 AS left", "3 AS start").repartition(9)
    check(docs, windows.pack_windows(wide, MODEL).collect(), windows.LENGTH)
    check(docs, windows.pack_windows(docs, MODEL, length=64, most=2, merge=2).collect(), 64)


def test_leftovers_of_many_partitions(spark):
    docs = documents(spark, ["word " * (i % 90) for i in range(400)]).repartition(13)
    check(docs, windows.pack_windows(docs, MODEL, length=128, most=3, merge=4).collect(), 128)


def test_query(spark):
    docs = queries.table(spark, SMALL, "documents")
    ids = {r["doc_id"]: plain_ids(r["text"]) for r in docs.collect()}
    found = queries.op12_pack_online(spark, SMALL).collect()
    assert sum(r["length"] for r in found) == sum(map(len, ids.values()))
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert r["doc_tokens"] == len(ids[r["doc_id"]])


def test_empty_table(spark):
    assert rows(windows.pack_windows(empty(spark), MODEL)) == []
