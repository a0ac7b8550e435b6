"""Alignment of two tokenizers' tokens over the same bytes, and how often which ids are linked.

A text is encoded by a byte-level vocabulary (A) and by one with byte fallback (B). Byte offsets at which
tokens of both end cut the two sequences into groups; the tokens on both sides of a cut are linked.

Diagonal run skipping finds the cuts: at a cut, the end offsets of both sides are compared at the current
index shift, in stretches that double while they agree and halve after they do not, so that one-to-one
stretches are jumped. An irregular group is resolved on the spot, by moving on the side that lags until
both end together; the shift is then what the indexes say. It runs over lines of text parts that a worker has
not met lately; a text's groups are put together from those of its parts.

Counts of linked id pairs are sums over all texts: one row per text and distinct pair, combined before
the shuffle. The table of pairs meets the texts' rows in a join that Spark chooses from its size; a pair
that is in a third of all texts has one row on its side of that join, so a hot side can be split.

Defined results: a text that is null or empty, or whose tokens do not spell a space and the text byte by
byte, has no tokens and no groups; texts that hold special tokens' names are ordinary texts. Tokens are
not empty, so at each cut exactly one token of each side ends and links are as many as groups. Repeated
rows are returned each and count each; null doc_ids are kept; an empty table gives an empty result;
further columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortfall.llm.common import by_value, light_slices, stored, text_or_empty
from shortfall.llm.memo import Memo, fast_tokenizer, file_digest, of_worker

by_value(__name__)

MARK = "\u2581"  # stands for a space in pieces
PARTING = re.compile(r"(?<=\S) (?=\S)")
WIDE = re.compile(r" (?:(?<!\S )|(?!\S))")  # a space beside white space or an end of the text
LINE_PARTS = 100
LINKED_BYTES = 150  # of a part's entry in memory, besides its groups and pairs
FIRST_STEP = 4  # ends compared at once when a run begins
SIDE_BITS = 32  # a pair is A's id and, in the lower bits, B's
Linked = tuple[str, bytes, int, int]
ALIGNED = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs array<bigint>, times array<bigint>"


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: its own where that prints, else from 256 up."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def lengths(token: dict[int, bytes]) -> np.ndarray:
    """Bytes of each id's token."""
    found = np.zeros(max(token) + 1, np.int64)
    found[list(token)] = list(map(len, token.values()))
    return found


class ByteLevel:
    """Ids and token bytes of a byte-level vocabulary."""

    def __init__(self, model: str):
        self.fast = fast_tokenizer(model)
        self.fast.encode_special_tokens = True
        byte = byte_of_letter()
        self.token = {i: bytes(map(byte.__getitem__, t)) for t, i in self.fast.get_vocab(False).items()}
        self.length = lengths(self.token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.fast.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Ids and token bytes of a vocabulary with byte fallback."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.token = {
            i: bytes([int(p[1:-1], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        }
        self.length = lengths(self.token)
        # Merges stop at a space if no piece goes on behind one.
        self.parted = not any(MARK in p.lstrip(MARK) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.library.encode(t) for t in texts]  # a list would start a pool of threads on each call


class Sides:
    """Both sides' tokens of texts, and the groups that they make.

    A single space between other characters parts a text for both vocabularies, and tokens of both end before it.
    A text's groups are therefore those of its parts, which are aligned in lines of many and remembered. Texts of
    which a part is not spelled byte by byte are aligned whole.

    What is linked is told as group texts with a `;` after each, pairs as bytes, and how many tokens A and B have.
    """

    def __init__(self, a_model: str, b_model: str):
        self.left, self.right = ByteLevel(a_model), Pieces(b_model)
        self.spelled = Speller(len(self.left.token), len(self.right.token))
        self.memo = Memo(self.link_parts, lambda found: LINKED_BYTES + len(found[0]) + len(found[1]) if found else 0)

    def tokens(self, texts: list[str]) -> list[list[np.ndarray] | None]:
        """Ids of A, ids of B, end offsets of A and of B for each text that both sides spell."""
        found: list[list[np.ndarray] | None] = []
        for text, *ids in zip(texts, self.left.encode(texts), self.right.encode(texts), strict=True):
            whole = (" " + text).encode()
            sides = list(zip(ids, (self.left, self.right), strict=True))
            if not text or any(b"".join(map(side.token.__getitem__, of)) != whole for of, side in sides):
                found.append(None)
            else:
                ends = [np.cumsum(side.length[of]) for of, side in sides]
                found.append([*(np.array(of, np.int64) for of in ids), *ends])
        return found

    def linked(self, tokens: list[np.ndarray], cuts: np.ndarray) -> list[Linked]:
        """What is linked between one cut and the next; the cuts are offsets at which tokens of both sides end."""
        a, b, ends_a, ends_b = tokens
        at_a, at_b = last_tokens(segments(ends_a, ends_b))
        entries = self.spelled.entries(a, b, at_a, at_b)
        flat = ((a[at_a] << SIDE_BITS) + b[at_b]).tobytes()
        before = [np.searchsorted(ends, cuts, side="right") for ends in (ends_a[at_a], ends_a, ends_b)]
        return [
            ("".join(entries[i_a + i_b : k_a + k_b]), flat[8 * i : 8 * k], k_a - i_a, k_b - i_b)
            for (i, i_a, i_b), (k, k_a, k_b) in pairwise(zip(*(n.tolist() for n in before), strict=True))
        ]

    def link_whole(self, text: str) -> Linked | None:
        [tokens] = self.tokens([text])
        return None if tokens is None else self.linked(tokens, np.array([0, tokens[2][-1]]))[0]

    def link_parts(self, parts: list[str]) -> list[Linked | None]:
        """`link_whole` of each, by way of lines of parts that a single space can join."""
        joined = [p for p in parts if p and p == p.strip()]
        lines = self.link_lines([joined[k : k + LINE_PARTS] for k in range(0, len(joined), LINE_PARTS)])
        found = dict(zip(joined, lines, strict=True))
        return [found[p] if p in found else self.link_whole(p) for p in parts]

    def link_lines(self, lines: list[list[str]]) -> list[Linked | None]:
        found: list[Linked | None] = []
        for parts, tokens in zip(lines, self.tokens([" ".join(parts) for parts in lines]), strict=True):
            if tokens is not None:
                found += self.linked(tokens, np.cumsum([0, *(len(p.encode()) + 1 for p in parts)]))
            elif len(parts) == 1:
                found.append(None)
            else:
                middle = len(parts) // 2
                found += self.link_lines([parts[:middle], parts[middle:]])
        return found

    def links(self, texts: list[str]) -> Iterator[Linked | None]:
        """What is linked in each text that both sides spell."""
        if not self.right.parted:
            yield from map(self.link_whole, texts)
            return
        parted = [PARTING.split(t) if WIDE.search(t) else t.split(" ") for t in texts]
        parts = list(set().union(*parted))
        known = dict(zip(parts, *self.memo([parts]), strict=True))
        unspelled = {p for p, found in known.items() if found is None}
        for text, own in zip(texts, parted, strict=True):
            if not unspelled.isdisjoint(own):
                yield self.link_whole(text)
            else:
                groups, pairs, n_a, n_b = zip(*map(known.__getitem__, own), strict=True)
                yield "".join(groups), b"".join(pairs), sum(n_a), sum(n_b)


class Speller:
    """Group texts like `a1,a2|b1;a3|b2,b3` from tables of ids with what follows them."""

    def __init__(self, n_a: int, n_b: int):
        self.bounds = np.cumsum([0, n_a, n_a, n_b])
        self.table = [f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]

    def __call__(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        return "".join(self.entries(a, b, at_a, at_b))[:-1]

    def entries(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> list[str]:
        """Each token with what follows it; `at_a` and `at_b` are the indexes of the tokens that end at each cut."""
        if not len(at_a):
            return []
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        before = np.concatenate([[0], at_b[:-1] + 1])  # tokens of B before each group
        place_a = np.arange(len(a)) + before[np.cumsum(last_a) - last_a]
        place_b = np.arange(len(b)) + (at_a + 1)[np.cumsum(last_b) - last_b]
        entry = np.empty(len(a) + len(b), np.int64)
        entry[place_a] = a + self.bounds[last_a]
        entry[place_b] = b + self.bounds[2 + last_b]
        return list(map(self.table.__getitem__, entry.tolist()))


def segments(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first of a, its end, first of b, its end): a run of one-to-one groups, one irregular group, and so on.

    `a` and `b` are rising 64-bit numbers and end at the same offset. Runs may be empty.
    """
    # Stretches are compared as memory, single ends as numbers.
    flat_a, flat_b, a, b = a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    last, most, i, j, found = len(flat_a), len(flat_b), 0, 0, []
    while i < last:
        i0, j0, step = i, j, 8 * FIRST_STEP
        while i < last and flat_a[i : i + step] == flat_b[j : j + step]:
            i, j, step = min(i + step, last), min(j + step, most), 2 * step
        while step > 8 and i < last:
            step >>= 1
            if flat_a[i : i + step] == flat_b[j : j + step]:
                i, j = i + step, j + step
        found.append((i0 >> 3, i >> 3, j0 >> 3, j >> 3))
        if i == last:
            break
        k, m = k0, m0 = i >> 3, j >> 3
        x, y = a[k], b[m]
        while x != y:
            if x < y:
                k += 1
                x = a[k]
            else:
                m += 1
                y = b[m]
        found.append((k0, k + 1, m0, m + 1))
        i, j = (k + 1) << 3, (m + 1) << 3
    return found


def last_tokens(found: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens that end at each cut."""
    table = np.fromiter(chain.from_iterable(found), np.int64, 4 * len(found)).reshape(-1, 4)
    groups = np.where(np.arange(len(table)) % 2, 1, table[:, 1] - table[:, 0])
    back = np.repeat(np.cumsum(groups), groups) - np.arange(groups.sum())  # groups from here to the segment's end
    return np.repeat(table[:, 1], groups) - back, np.repeat(table[:, 3], groups) - back


def align(docs: DataFrame, a_model: str, b_model: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, and the distinct linked pairs with how often the text has them.

    `row` tells rows apart once the result is stored. The models are paths that each worker has.
    """
    sides_key = ("sides", file_digest(a_model), file_digest(b_model))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = of_worker(sides_key, lambda: Sides(a_model, b_model))
        for part in light_slices(batches, "body", most=1 << 20):
            rows = []
            for found in sides.links(part.column("body").to_pylist()):
                if found is None:
                    rows.append((0, 0, 0, "", [], []))
                    continue
                groups, flat, n_a, n_b = found
                pairs, times = np.unique(np.frombuffer(flat, np.int64), return_counts=True)
                rows.append((n_a, n_b, len(flat) >> 3, groups[:-1], pairs, times))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *columns], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [column.split()[0] for column in ALIGNED.split(", ")]
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc).cast("bigint").alias("doc_id"),
        text_or_empty(text).alias("body"),
    ).mapInArrow(link, ALIGNED)


def pair_rows(aligned: DataFrame) -> DataFrame:
    """row, pair, n: one row for each text and distinct pair."""
    return aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n")
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, count, best: links of all texts, and whether no pair with this B id has more."""
    counted = stored(pair_rows(aligned).groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND((1 << SIDE_BITS) - 1)
    highest = counted.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return counted.withColumn("b", b).join(highest, "b").select(
        "pair",
        F.shiftright("pair", SIDE_BITS).alias("a"),
        "b",
        "count",
        (F.col("count") == F.col("highest")).alias("best"),
    )


def link_report(
    docs: DataFrame,
    a_model: str,
    b_model: str,
    doc: str = "doc_id",
    text: str = "text",
    groups: Column | None = None,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups of every row.

    `groups` may derive something shorter from the column `groups` before it is stored.
    """
    shown = F.col("groups") if groups is None else groups
    aligned = stored(align(docs, a_model, b_model, doc, text).withColumn("groups", shown), "aligned")
    known = stored(pair_counts(aligned).select("pair", "count", "best"), "pair-table")
    sums = (
        pair_rows(aligned)
        .join(known, "pair")
        .groupBy("row")
        .agg(
            F.sum("n").alias("n_links"),
            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return (
        aligned.drop("pairs", "times")
        .join(sums, "row", "left")
        .select(
            "doc_id",
            "n_a",
            "n_b",
            "n_groups",
            *(F.coalesce(c, zero).alias(c) for c in ("n_links", "n_best", "count_sum")),
            "groups",
        )
    )
