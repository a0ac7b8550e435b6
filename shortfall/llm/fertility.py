"""Quality rules from tokenizer fertility.

Two public vocabularies measure how well a text is covered: code points per token of a byte-level one and of
one with byte fallback, the share of the latter's tokens that are fallback bytes (without white space, which
it has no pieces for), and the entropy of the former's tokens, divided by the largest that the text's length
allows. The texts of a script and a length class (power of two of tokens) have a band for each measure around
their median in the corpus; a text outside a band is rejected. Bands come from exact quartiles of all rows'
measures to three decimals, so reruns agree; texts are measured whole. Their tokens are those of their parts where
neither vocabulary joins what a single space parts, so that a repeated part is encoded once.

Each text of enough words is judged. A script and length class of fewer than MIN_TEXTS such texts takes the
band of the nearest fuller class of its script (of two as near the shorter), else that of all texts of the
script if they are MIN_TEXTS, else that of all texts. The share of the largest entropy falls with length, at
most as if its bits stayed the same; a band from another class is widened by so much on that side.

Defined results: null is the empty text; texts that fail the base rule make no bands; null keys and repeated
rows are scored like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.llm.alignment import LINE_PARTS, PARTING, WIDE, Pieces, lengths
from shortfall.llm.common import by_value, light_slices, stored
from shortfall.llm.memo import Memo, file_digest, of_worker

by_value(__name__)

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_TEXTS = 100
# Half widths of the bands: spreads (scaled median deviations), and at least so much.
SPREADS = 4.0
LEAST_WIDTH = {"chars_per_token": 0.5, "chars_per_piece": 0.5, "fallback_share": 0.02, "token_entropy": 0.1}
MEASURES = tuple(LEAST_WIDTH)
# Under this pattern a token begins at each single space between other characters.
PARTED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CODES_BYTES = 40  # of a part's codes in memory, besides the codes
FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, for sums of hashes
# Unicode blocks of scripts, first and last code point.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "hangul": ((0xAC00, 0xD7AF),),
}


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    # Equal windows have equal sums of hashes. Where all sums differ, no window occurs twice.
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = hashes[:n]
    for k in range(1, window):
        sums = sums * FACTOR + hashes[k : k + n]
    sums = np.sort(sums)
    if not (sums[1:] == sums[:-1]).any():
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    # Exact names of windows of 1, 2, 4, 8 words: two halves' names make a pair, and pairs are numbered.
    name, size = ids, 1
    while size < window:
        pair = name[:-size] * (len(words) + 1) + name[size:]
        name, size = np.unique(pair, return_inverse=True)[1], size * 2
    often = np.bincount(name)[name] > 1
    inside = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + window, -1)
    return int((np.cumsum(inside) > 0).sum())


def script_table() -> np.ndarray:
    """Number of each code point's script in the basic plane, 0 for none."""
    table = np.zeros(1 << 16, np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            table[first : last + 1] = number
    return table


def script_of(text: str, table: np.ndarray) -> str:
    """Script of most letters; the first in the list of equals."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    seen = np.bincount(table[units], minlength=len(SCRIPTS) + 1)[1:]
    return list(SCRIPTS)[int(seen.argmax())] if seen.any() else "none"


def ends_in_line(parts: list[str], line: str) -> np.ndarray:
    """Byte at which each part ends in the line that single spaces join them to, behind a space."""
    sizes = map(len, parts if line.isascii() else map(str.encode, parts))
    return np.cumsum(np.fromiter(sizes, np.int64, len(parts)) + 1)


class Vocabulary:
    """A byte-level vocabulary given as ranks."""

    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        with open(ranks_file, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = len(ranks)
        self.length = lengths({i: b for b, i in ranks.items()})
        self.parted = pattern == PARTED_PATTERN

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def cut_line(self, parts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of parts that a single space can join, each behind a space, and where those of each part end."""
        line = " ".join(parts)
        ids = self.encode(" " + line)
        return ids, np.searchsorted(np.cumsum(self.length[ids]), ends_in_line(parts, line), side="right").tolist()

    def measure(self, text: str) -> tuple[float, float, int]:
        """Code points per token, entropy, number of tokens."""
        return self.spread(np.unique(self.encode(text), return_counts=True)[1], len(text))

    def spread(self, times: np.ndarray, length: int) -> tuple[float, float, int]:
        """`measure` by how often each distinct token occurs, in order of ids."""
        n = int(times.sum())
        if not n:
            return 0.0, 0.0, 0
        share = times / n
        entropy = float(-(share * np.log2(share)).sum())
        most = np.log2(min(n, self.size))
        return length / n, float(entropy / max(1.0, most)), n


class Fallback:
    """A vocabulary with byte fallback."""

    def __init__(self, model: str):
        self.pieces = Pieces(model)
        library = self.pieces.library
        # Line ends and tabs are bytes too in vocabularies that have no pieces for them.
        self.fallback = {i for i, b in self.pieces.token.items() if library.is_byte(i) and not b.isspace()}
        self.fell = np.isin(np.arange(len(self.pieces.length)), list(self.fallback))
        self.parted = self.pieces.parted

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Tokens and fallback bytes of each text."""
        return [(len(ids), sum(i in self.fallback for i in ids)) for ids in self.pieces.encode(texts)]

    def count_line(self, parts: list[str]) -> list[tuple[int, int]]:
        """`count` of each of the parts that a single space can join."""
        line = " ".join(parts)
        [ids] = self.pieces.encode([line])
        if b"".join(map(self.pieces.token.__getitem__, ids)) == b" " + line.encode():
            at = np.array(ids)
            cuts = np.searchsorted(np.cumsum(self.pieces.length[at]), ends_in_line(parts, line), side="right")
            fell = np.cumsum(self.fell[at])[cuts - 1]
            return list(zip(np.diff(cuts, prepend=0).tolist(), np.diff(fell, prepend=0).tolist(), strict=True))
        if len(parts) == 1:
            return self.count(parts)
        middle = len(parts) // 2
        return self.count_line(parts[:middle]) + self.count_line(parts[middle:])

    def measure(self, texts: list[str]) -> list[tuple[float, float]]:
        """Code points per token and share of fallback bytes of each text."""
        return [self.shares(len(t), n, fell) for t, (n, fell) in zip(texts, self.count(texts), strict=True)]

    def shares(self, length: int, n: int, fell: int) -> tuple[float, float]:
        return (length / n, fell / n) if n else (0.0, 0.0)


class Coverage:
    """What both vocabularies measure of texts, by parts that are remembered.

    A part's codes are the first vocabulary's ids, then one code for each piece and another for each fallback byte.
    Of a text only the first part may stand without a space before it; it is encoded each time.
    """

    def __init__(self, vocabulary: Vocabulary, fallback: Fallback):
        self.vocabulary, self.fallback = vocabulary, fallback
        self.parted = vocabulary.parted and fallback.parted
        self.piece = len(vocabulary.length)
        self.type = np.min_scalar_type(self.piece + 1)
        self.marks = [np.array([self.piece + k], self.type).tobytes() for k in (0, 1)]
        self.memo = Memo(self.encode, lambda codes: CODES_BYTES + len(codes))

    def codes(self, ids: np.ndarray, ends: list[int], counts: list[tuple[int, int]]) -> list[bytes]:
        """Codes of each part from the ids of all, where those of each part end, and the counts of pieces."""
        data, width, (piece, byte) = ids.astype(self.type).tobytes(), self.type.itemsize, self.marks
        return [
            data[width * start : width * end] + piece * (n - fell) + byte * fell
            for start, end, (n, fell) in zip([0, *ends[:-1]], ends, counts, strict=True)
        ]

    def encode_alone(self, part: str, lead: str = " ") -> bytes:
        ids = self.vocabulary.encode(lead + part)
        return self.codes(ids, [len(ids)], self.fallback.count([part]))[0]

    def encode(self, parts: list[str]) -> list[bytes]:
        """Codes of each part behind a space, by way of lines of parts that a single space can join."""
        joined = [p for p in parts if p and p == p.strip()]
        found = {}
        for k in range(0, len(joined), LINE_PARTS):
            line = joined[k : k + LINE_PARTS]
            found.update(zip(line, self.codes(*self.vocabulary.cut_line(line), self.fallback.count_line(line)), strict=True))
        return [found[p] if p in found else self.encode_alone(p) for p in parts]

    def measure(self, texts: list[str]) -> list[tuple[float, float, float, float, int]]:
        """Code points per token and per piece, share of fallback bytes, entropy and number of tokens of each text."""
        if not self.parted:
            pairs = zip(map(self.vocabulary.measure, texts), self.fallback.measure(texts), strict=True)
            return [(per_token, *pieces, entropy, n) for (per_token, entropy, n), pieces in pairs]
        parted = [PARTING.split(t) if WIDE.search(t) else t.split(" ") for t in texts]
        leads = [self.encode_alone(parts.pop(0), "") for parts in parted]
        found = []
        for text, lead, codes in zip(texts, leads, self.memo(parted), strict=True):
            seen, times = np.unique(np.frombuffer(lead + b"".join(codes), self.type), return_counts=True)
            ids = int(np.searchsorted(seen, self.piece))
            per_token, entropy, n = self.vocabulary.spread(times[:ids], len(text))
            fell = int(times[-1]) if len(seen) and seen[-1] > self.piece else 0
            found.append((per_token, *self.fallback.shares(len(text), int(times[ids:].sum()), fell), entropy, n))
        return found


def measured(docs: DataFrame, ranks_file: str, pattern: str, pieces_model: str) -> DataFrame:
    """Base counts, script and measures of every text."""
    key = ("coverage", file_digest(ranks_file), pattern, file_digest(pieces_model))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scripts = script_table()
        coverage = of_worker(key, lambda: Coverage(Vocabulary(ranks_file, pattern), Fallback(pieces_model)))
        for part in light_slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            rows = [
                (*base_counts(t), script_of(t, scripts), *found)
                for t, found in zip(texts, coverage.measure(texts), strict=True)
            ]
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if columns:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    names = [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", *MEASURES, "n_tokens",
    ]
    types = ["bigint"] * 6 + ["string"] + ["double"] * len(MEASURES) + ["bigint"]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(measure, schema)


def bands(rows: DataFrame) -> DataFrame:
    """script, length_class, low and high of each measure. One row per script and power of two that rows have."""
    # Of three decimals there are few distinct values, which is what an exact percentile holds.
    quartiles = [F.percentile(F.round(m, 3), [0.25, 0.5, 0.75]).alias(m) for m in MEASURES]
    levels = rows.groupingSets([["script", "length_class"], ["script"], []], "script", "length_class").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("texts"), *quartiles
    )
    levels = stored(levels, "fertility-levels")  # at most scripts x 64 rows, a row a script and one of all
    classes = levels.where("level = 0").select(F.col("script").alias("for_script"), F.col("length_class").alias("for_class"))
    usable = (F.col("texts") >= MIN_TEXTS) | (F.col("level") == 3)
    fits = (F.col("level") == 3) | (F.col("script") == F.col("for_script"))
    # Each class takes the first of: classes of its script by distance, its script, all.
    nearest = F.struct("level", F.abs(F.col("length_class") - F.col("for_class")).alias("away"), "length_class")
    picked = F.struct(*MEASURES)
    found = (
        classes.join(F.broadcast(levels.where(usable)), fits)
        .groupBy("for_script", "for_class")
        .agg(F.min_by(picked, nearest).alias("band"), F.coalesce(F.min_by("length_class", nearest), "for_class").alias("of_class"))
        .select(F.col("for_script").alias("script"), F.col("for_class").alias("length_class"), "of_class", "band.*")
    )
    limits = []
    for m in MEASURES:
        # Half the distance of the quartiles, scaled, is the spread; no band is tighter than its least width.
        half = F.greatest(F.lit(SPREADS * 0.741) * (F.col(m)[2] - F.col(m)[0]), F.lit(LEAST_WIDTH[m]))
        low, high = F.col(m)[1] - half, F.col(m)[1] + half
        if m == "token_entropy":
            longer = F.col("of_class") / F.greatest(F.col("length_class"), F.lit(1))
            low, high = low * F.least(longer, F.lit(1.0)), high * F.greatest(longer, F.lit(1.0))
        limits += [low.alias(f"{m}_low"), high.alias(f"{m}_high")]
    return found.select("script", "length_class", *limits)


def quality_rules(docs: DataFrame, ranks_file: str, pattern: str, pieces_model: str) -> DataFrame:
    """Base counts, base_failed, kept, script and measures of every row."""
    rows = stored(
        measured(docs, ranks_file, pattern, pieces_model).withColumn(
            "length_class", F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")
        ),
        "fertility-rows",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    limits = stored(bands(rows.where(~failed)), "fertility-bands")  # at most scripts x 64 rows
    joined = rows.join(F.broadcast(limits), ["script", "length_class"], "left")
    outside = F.lit(False)
    for m in MEASURES:
        outside = outside | ~F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    rejected = F.coalesce(outside, F.lit(False))  # null only where the base rule fails
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), "script", *MEASURES, "n_tokens",
    )
