from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from conftest import SMALL, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents, empty, odd_documents, with_clashing

from shortfall.llm import alignment, queries

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
ODD = ["<|endoftext|> and <s> </s> <unk>", "日本語テキスト と émigré 🙂", "a▁b", "tab\tand\r\nline  two  spaces ", " lead", "\x00",
       "<0x41>", "ﬁ ① é", "don't 12345 -- !!", " x y", "naïve " * 300]


def plain_cuts(a, b):
    places_a, places_b = {e: i + 1 for i, e in enumerate(a)}, {e: j + 1 for j, e in enumerate(b)}
    return [(0, 0), *((places_a[e], places_b[e]) for e in sorted(places_a.keys() & places_b.keys()))]


@given(st.lists(st.tuples(st.integers(1, 4), st.booleans(), st.booleans()), min_size=1, max_size=80))
@settings(max_examples=400, deadline=None)
def test_cuts(steps):
    offsets = list(accumulate(n for n, _, _ in steps))
    a = [e for e, (_, x, _) in zip(offsets, steps, strict=True) if x or e == offsets[-1]]
    b = [e for e, (_, _, y) in zip(offsets, steps, strict=True) if y or e == offsets[-1]]
    found = alignment.segments(np.array(a), np.array(b))
    at_a, at_b = alignment.last_tokens(found)
    assert list(zip(at_a + 1, at_b + 1, strict=True)) == plain_cuts(a, b)[1:]
    for turn, (i0, i1, j0, j1) in enumerate(found):
        if turn % 2:
            assert a[i1 - 1] == b[j1 - 1] and (i1 - i0 > 1 or j1 - j0 > 1)
        else:
            assert a[i0:i1] == b[j0:j1]


def test_long_runs_are_jumped():
    class Watched(bytes):
        looks = 0

        def __getitem__(self, at):
            Watched.looks += 1
            return super().__getitem__(at)

    class Ends:
        def __init__(self, values):
            self.values = np.array(values)

        def tobytes(self):
            return Watched(self.values.tobytes())

        def tolist(self):
            return self.values.tolist()

    ends = [*range(1, 50_001), *range(50_003, 100_001)]
    assert alignment.segments(Ends(ends), Ends(range(1, 100_001))) == [
        (0, 50_000, 0, 50_000), (50_000, 50_001, 50_000, 50_003), (50_001, 99_998, 50_003, 100_000)
    ]
    assert Watched.looks < 150


def test_no_tokens():
    assert alignment.segments(np.array([], np.int64), np.array([], np.int64)) == []
    assert [len(x) for x in alignment.last_tokens([])] == [0, 0]


def test_spelled():
    speller = alignment.Speller(9, 6)
    ids = np.array([1, 2, 3, 8]), np.array([1, 2, 0, 5])
    assert speller(*ids, np.array([1, 2, 3]), np.array([0, 1, 3])) == "1,2|1;3|2;8|0,5"
    assert speller(*(i[:0] for i in ids), np.array([], int), np.array([], int)) == ""


@pytest.fixture(scope="module")
def sides():
    found = alignment.Sides(A, B)
    found.memo.most = 3000
    return found


@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=10)), max_size=6), st.sampled_from([" ", "\n", "  ", " \u00a0", "\x1c "]))
@settings(max_examples=300, deadline=None)
def test_parts_give_the_tokens_of_the_text(sides, texts, between):
    text = between.join(texts)
    a, b, of_a, of_b = plain_tokens(text)
    whole = (" " + text).encode()
    [tokens] = sides.tokens([text])
    if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
        assert tokens is None
    else:
        ends = [list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b)))]
        assert [t.tolist() for t in tokens] == [a, b, *ends]


@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=10)), max_size=6), st.sampled_from([" ", "\n", "  ", " \u00a0", "\x1c "]))
@settings(max_examples=300, deadline=None)
def test_parts_give_the_groups_of_the_text(sides, texts, between):
    text = between.join(texts)
    [found] = sides.links([text])
    [(_, n_a, n_b, n_groups, *_, sha)] = plain([(1, text)])
    if not n_groups:
        assert found is None
        return
    groups, pairs, *counts = found
    assert counts == [n_a, n_b] and hashlib.sha256(groups[:-1].encode()).hexdigest() == sha
    last = [[side.split(",")[-1] for side in group.split("|")] for group in groups[:-1].split(";")]
    assert np.frombuffer(pairs, np.int64).tolist() == [(int(a) << alignment.SIDE_BITS) + int(b) for a, b in last]


def test_a_repeated_part_is_aligned_once(monkeypatch):
    sides, seen, real = alignment.Sides(A, B), [], alignment.segments
    monkeypatch.setattr(alignment, "segments", lambda a, b: seen.append(len(a) + len(b)) or real(a, b))
    text = " ".join(["naïve", "tokenizers", "agree", "rarely,", "don't", "they?"] * 2000)
    first, again = sides.links([text, text])
    assert first == again and first[2] + first[3] > 24_000
    assert sum(seen) < 100


def plain_tokens(text):
    """Ids and bytes of both sides, by the libraries alone."""
    import tiktoken  # noqa: F401  (the same vocabulary as ranks gives the bytes of A)
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(plain_tokens, "kept"):
        import base64

        with open(queries.vocabulary("byte_bpe_50k.tiktoken"), "rb") as file:
            ranks = {int(n): base64.b64decode(t) for t, n in map(bytes.split, file)}
        fast = Tokenizer.from_file(A)
        fast.encode_special_tokens = True
        plain_tokens.kept = fast, ranks, SentencePieceProcessor(model_file=B)
    fast, ranks, pieces = plain_tokens.kept
    a = fast.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    of_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else
            pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, [ranks[i] for i in a], of_b


def plain(data):
    told, links, count = [], [], Counter()
    for doc, text in data:
        text = text or ""
        a, b, of_a, of_b = plain_tokens(text)
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            told.append((doc, 0, 0, 0, ""))
            links.append([])
            continue
        at = plain_cuts(list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b))))
        groups = [",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])) for (i, j), (k, m) in zip(at, at[1:], strict=False)]
        told.append((doc, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append([(a[k - 1], b[m - 1]) for k, m in at[1:]])
        count.update(links[-1])
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return sorted(
        ((doc, n_a, n_b, n, len(own), sum(count[p] == highest[p[1]] for p in own), sum(count[p] for p in own), sha)
         for (doc, n_a, n_b, n, sha), own in zip(told, links, strict=True)), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(spark):
    data = [tuple(r) for r in queries.table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert rows(queries.op11_align_tokens(spark, SMALL).select(COLUMNS)) == plain(data)


def test_odd_documents(spark):
    docs = odd_documents(spark).unionByName(documents(spark, ODD, ids=range(100, 100 + len(ODD))))
    expected = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert any(r[1] == 0 for r in expected if r[0] and r[0] >= 100)  # texts that B does not spell
    wide = with_clashing(docs).selectExpr("*", "1 AS pair", "2 AS pairs", "3 AS groups", "4 AS best").repartition(3)
    found = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in rows(alignment.link_report(wide, A, B))]
    assert sorted(found, key=str) == expected


def test_empty_table(spark):
    assert rows(alignment.link_report(empty(spark), A, B)) == []


def test_the_pair_join_may_shuffle(spark):
    docs = odd_documents(spark)
    expected = rows(alignment.link_report(docs, A, B))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(alignment.link_report(docs, A, B)) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
