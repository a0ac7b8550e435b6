"""Bounded-space online packing of token sequences into windows of one length.

Each partition of the documents is packed as it is read, with a fixed number of open windows and nothing
else in memory. A document's ids are cut into full windows and a rest. The rest goes into the open window
with the least room that holds it. When none fits, a new window is opened; when all are in use, the
fullest one takes as much of the rest as it has room for and is emitted, so that emitted windows are full.

What is still open at the end of a partition are leftovers: at most `OPEN` windows a partition, whatever
its size. The leftovers of `MERGED` neighbouring partitions go to one task, which lines them up and cuts
them anew at full windows. The last, shorter line is cut at powers of two, the largest first, so that no
sequence has to be padded.

Ids come from a word memo: the vocabulary's pre-tokenizer drops white space and never joins what it
parts, so a text's ids are those of its words one after the other. A word is encoded once per memo by the
tokenizer library itself; the memo has a bounded size.

Defined results: null is the empty text, whose only id is the end id; repeated rows are packed each for
themselves; null doc_ids are kept; an empty table gives an empty result; further columns do not matter.
Which window a piece comes to depends on how files are dealt to partitions. A partition's windows come
from one task's output, so a repeated task replaces them as a whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.llm.common import by_value, light_slices, stored, text_or_empty
from shortfall.llm.memo import MEMO_BYTES, Memo, fast_tokenizer, file_digest, of_worker

by_value(__name__)

LENGTH = 2048
OPEN = 32
MERGED = 4
END_ID = 1
NUMBER_BITS = 32
MERGED_BIT = 62  # sequence numbers of merged leftovers have it
BATCH_ROWS = 4096
SIGN = "\x1f"
LINE_WORDS = 100
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds:
    """Ids of UTF-8 texts, by way of their words."""

    def __init__(self, model: str, most: int = MEMO_BYTES):
        self.fast = fast_tokenizer(model)
        self.sign = self.fast.encode(SIGN, add_special_tokens=False).ids
        self.memo = Memo(self.encode_words, len, most)
        # A vocabulary without capital letters knows fewer words; names of special tokens keep their case.
        upper, lower = (self.fast.encode(letters).ids for letters in (ascii_uppercase, ascii_lowercase))
        self.folds = upper == lower
        self.special = [t.content.lower().encode() for t in self.fast.get_added_tokens_decoder().values()]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Many words make a line, with a sign between them that is one token and in none of
        them; words that hold the sign are lines of their own."""
        texts = [w.decode(errors="replace") for w in words]
        alone = [i for i, t in enumerate(texts) if SIGN in t or len(self.sign) != 1]
        found: list[bytes] = [b""] * len(words)
        for i, e in zip(alone, self.encode_lines([texts[i] for i in alone]), strict=True):
            found[i] = e.tobytes()
        joined = sorted(set(range(len(words))).difference(alone)) if alone else range(len(words))
        starts = range(0, len(joined), LINE_WORDS)
        lines = [f" {SIGN} ".join([*(texts[i] for i in joined[k : k + LINE_WORDS]), ""]) for k in starts]
        if lines:
            ids = np.concatenate(self.encode_lines(lines))
            ends = 4 * np.flatnonzero(ids == self.sign[0])
            flat, begins = ids.tobytes(), [0, *(ends[:-1] + 4).tolist()]
            for i, begin, end in zip(joined, begins, ends.tolist(), strict=True):
                found[i] = flat[begin:end]
        return found

    def encode_lines(self, lines: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.fast.encode_batch_fast(lines, add_special_tokens=False)]

    def folded(self, text: bytes) -> bytes:
        low = text.lower() if self.folds else text
        return text if any(name in low for name in self.special) else low

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        parted = self.memo([self.folded(text).split() for text in texts])  # at [\x20\x09-\x0D], which no token spans
        return [np.frombuffer(b"".join(words), "<u4") for words in parted]


class Windows:
    """Open windows of one partition. A piece is (doc_id, start, length, ids as bytes, doc_tokens)."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most = length, most
        self.rooms: list[tuple[int, int]] = []  # (room, number) of open windows, ascending
        self.contents: dict[int, list[tuple]] = {}
        self.next = 0

    def put(self, at: int | None, piece: tuple) -> Iterator[tuple[int, list[tuple]]]:
        """Adds a piece to the window at a place of `rooms`, or to a new one; emits the window if it is full."""
        if at is None:
            room, number = self.length, self.next
            self.next += 1
            self.contents[number] = []
        else:
            room, number = self.rooms.pop(at)
        self.contents[number].append(piece)
        room -= piece[2]
        if room:
            insort(self.rooms, (room, number))
        else:
            yield number, self.contents.pop(number)

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
        """Places a document; gives the windows that it fills, with their pieces."""
        start, size = 0, len(ids)
        while start < size:
            rest = size - start
            if rest >= self.length:
                at, rest = None, self.length
            else:
                at = bisect_left(self.rooms, (rest, -1))
                if at == len(self.rooms):  # none fits
                    if at < self.most:
                        at = None
                    else:
                        at, rest = 0, self.rooms[0][0]  # the fullest takes what it has room for
            yield from self.put(at, (doc_id, start, rest, ids[start : start + rest].tobytes(), size))
            start += rest


def line_lengths(size: int, length: int) -> list[int]:
    """Full windows, then powers of two."""
    rest = size % length
    return [length] * (size // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def merged(group: pd.DataFrame, length: int, first: int) -> pd.DataFrame:
    """Pieces of leftover windows, lined up and cut anew; sequence numbers start at `first`."""
    out = []
    sizes = iter(line_lengths(int(group["length"].sum()), length))
    number, offset, room = first - 1, 0, 0
    for r in group.sort_values(["sequence_id", "offset"]).itertuples(index=False):
        done = 0
        while done < r.length:
            if not room:
                room, offset, number = next(sizes), 0, number + 1
            n = min(room, r.length - done)
            out.append((r.doc_id, r.start + done, n, r.ids[4 * done : 4 * (done + n)], r.doc_tokens, number, offset))
            done, offset, room = done + n, offset + n, room - n
    return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def pack_windows(
    docs: DataFrame,
    model: str,
    doc: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    most: int = OPEN,
    end_id: int = END_ID,
    merge: int = MERGED,
) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32-bit numbers), doc_tokens, sequence_id, offset of every
    piece. `model` is a path that each worker has."""

    words_key = ("window words", file_digest(model))

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = of_worker(words_key, lambda: WordIds(model)), Windows(length, most)
        base = TaskContext.get().partitionId() << NUMBER_BITS
        rows: list[tuple] = []

        def take(number: int, pieces: list[tuple], left: bool) -> None:
            offset = 0
            for piece in pieces:
                rows.append((*piece, base + number, offset, left))
                offset += piece[2]

        def flush() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            arrays = [pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for part in light_slices(batches, "body"):
            found = words.encode(part.column("body").cast(pa.binary()).to_pylist())
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), found, strict=True):
                ids = np.append(ids, np.array([end_id], "<u4"))
                for number, pieces in windows.add(doc_id, ids):
                    take(number, pieces, False)
                if len(rows) >= BATCH_ROWS:
                    yield flush()
        for number, pieces in windows.contents.items():
            take(number, pieces, True)
        yield flush()

    schema = pa.schema(
        [(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in PIECES.split(", "))]
        + [("left", pa.bool_())]
    )
    texts = docs.select(F.col(doc).cast("bigint").alias("doc_id"), text_or_empty(text).alias("body"))
    packed = stored(texts.mapInArrow(pack_partition, f"{PIECES}, left boolean"), "packed-windows")
    group = F.expr(f"shiftright(sequence_id, {NUMBER_BITS}) div {merge}")

    def merge_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return merged(rows, length, (1 << MERGED_BIT) + (int(key[0]) << NUMBER_BITS))

    leftovers = packed.where("left").drop("left").groupBy(group.alias("group")).applyInPandas(merge_group, PIECES)
    return packed.where("not left").drop("left").unionByName(leftovers)
