"""Language ID with language-bitmask n-gram filters.

Each language has a Bloom filter of its letter trigrams. The filters are stored bit-sliced: one row per
slot, one bit per language, so the rows of a trigram's slots, and-ed, name all languages that may have
it. A text's hits are counted per language, corrected for the filter's false positives, and the language
with the largest corrected share of the text's trigrams wins.

Fitting takes at most about PER_LANGUAGE documents of each language, chosen by hash (the documented
bound of the sample, whole texts); prediction takes every row. Trigrams that fewer than MIN_SHARE of a
language's sampled documents have are left out as noise.

A text is accepted if the winner knows enough of it: at least `OF_LOW` of the share that all but the lowest
`LOW` of the winner's own labelled sample reach, less `SPREADS` binomial spread for the text's length. A
sampled text's trigrams that no other one has do not count for it, so a small sample does not raise the bar.

Defined results: texts that are null or have no letter are `und` with score 0; letters that no filter
knows give the most frequent learned language with score 0; without a learned language all rows are
`und`; equal shares go to the first language by name; null keys and repeated rows are predicted like any
other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortfall.llm.common import by_value, fraction, slices, stored

by_value(__name__)

PER_LANGUAGE = 4000
MIN_SHARE = 0.005
HASHES = 3
SLOTS_PER_GRAM = 8
CHUNK = 1 << 20
MIN_COVERAGE = 0.1  # where a language has too few texts for a bar of its own
LOW, OF_LOW, SPREADS = 0.01, 0.75, 1.0
# Odd multipliers of the slot hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def letter_table() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


def letters_of(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-case code points; each run of others is one blank, with blanks at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    known = letters[np.minimum(codes, 0xFFFF)]
    for code in np.unique(codes[codes > 0xFFFF]):
        known = np.where(codes == code, chr(code).isalpha(), known)
    keep = known.copy()
    keep[1:] |= known[:-1]  # the first blank after a letter
    keep[0] = True
    return np.where(known, codes, 32)[keep].astype(np.int64)


def trigrams(codes: np.ndarray) -> np.ndarray:
    """Every three code points around a letter as one number."""
    grams = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return grams[codes[1:-1] != 32]


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    table: np.ndarray  # slots x words of 64 languages
    false_hits: np.ndarray  # by language
    common: int  # most frequent language
    least: np.ndarray | None = None  # by language: share of a long text that is enough

    def slots(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        bits = np.uint64(64 - (len(self.table) - 1).bit_length())
        for multiplier in MULTIPLIERS[:HASHES]:
            yield ((grams.view(np.uint64) * np.uint64(multiplier)) >> bits).astype(np.int64)

    def shares(self, codes: np.ndarray) -> np.ndarray:
        """Corrected share of a text's trigrams that each language has."""
        hits = np.zeros(len(self.languages), np.int64)
        total = 0
        for start in range(0, max(1, len(codes) - 2), CHUNK):
            grams = trigrams(codes[start : start + CHUNK + 2])
            mask = None
            for slot in self.slots(grams):
                rows = self.table[slot]
                mask = rows if mask is None else mask & rows
            total += len(grams)
            for i in range(len(hits)):
                hits[i] += np.count_nonzero(mask[:, i // 64] & np.uint64(1 << i % 64))
        if not total:
            return hits.astype(float)
        return np.maximum(0.0, (hits - total * self.false_hits) / (1 - self.false_hits)) / total

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float, float]:
        """Language, score, and the language's share of the text."""
        return self.judge(letters_of(text or "", letters))

    def judge(self, codes: np.ndarray) -> tuple[str, float, float]:
        if len(codes) < 3 or not self.languages:
            return "und", 0.0, 0.0
        shares = self.shares(codes)
        best = int(shares.argmax())
        if shares[best] <= 0:
            return self.languages[self.common], 0.0, 0.0
        return self.languages[best], float(shares[best] / shares.sum()), float(shares[best])

    def accepts(self, text: str | None, letters: np.ndarray, floor: float) -> bool:
        """Whether the winner knows enough of the text."""
        codes = letters_of(text or "", letters)
        lang, _, share = self.judge(codes)
        if lang == "und":
            return False
        bar = 0.0 if self.least is None else float(self.least[self.languages.index(lang)])
        spread = (bar * (1 - bar) / np.count_nonzero(codes != 32)) ** 0.5
        return bool(share >= max(floor, bar - SPREADS * spread))


def make_filters(grams: dict[str, np.ndarray], common: str | None) -> Filters:
    """Filters of the languages' distinct trigrams."""
    languages = tuple(sorted(grams))
    entries = max([1, *(len(x) for x in grams.values())])
    table = np.zeros((1 << max(10, (entries * SLOTS_PER_GRAM - 1).bit_length()), max(1, -(-len(languages) // 64))), np.uint64)
    made = Filters(languages, table, np.zeros(len(languages)), languages.index(common) if common in languages else 0)
    for i, language in enumerate(languages):
        for slot in made.slots(grams[language].astype(np.int64)):
            np.bitwise_or.at(table[:, i // 64], slot, np.uint64(1 << i % 64))
        filled = np.count_nonzero(table[:, i // 64] & np.uint64(1 << i % 64)) / len(table)
        made.false_hits[i] = filled**HASHES
    return made


def fit(
    labelled: DataFrame, per_language: int = PER_LANGUAGE, min_share: float = MIN_SHARE, bars: bool = True
) -> Filters:
    """Filters from doc_id, text, lang; with bars, also the least shares of accepted texts."""
    labelled = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes, "lang-sizes")  # a row per language
    rates = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")).alias("rate"))
    sample = labelled.join(F.broadcast(rates), "lang").where(fraction(F.col("doc_id")) < F.col("rate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for part in slices(batches):
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                codes = letters_of(text, letters)
                if len(codes) > 2:
                    chunks = (trigrams(codes[i : i + CHUNK + 2]) for i in range(0, len(codes) - 2, CHUNK))
                    found.setdefault(lang, []).append(np.unique(np.concatenate([np.unique(c) for c in chunks])))
            for lang, grams in found.items():
                gram, docs = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram)), pa.array(gram), pa.array(docs)], ["lang", "gram", "docs"]
                )

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram bigint, docs bigint")
    least = F.greatest(F.lit(2.0), F.least(F.col("n"), F.lit(per_language)) * min_share)
    kept = (
        counts.groupBy("lang", "gram")
        .agg(F.sum("docs").alias("docs"))
        .join(F.broadcast(sizes), "lang")
        .where((F.col("docs") >= least) | (F.col("n") < 2 / min_share))
        .select("lang", "gram", "docs")
        .toPandas()  # what a bounded sample has
    )
    frequent = sizes.orderBy(F.desc("n"), "lang").first()
    common = frequent and frequent["lang"]
    made = make_filters({lang: x.to_numpy(np.int64) for lang, x in kept.groupby("lang")["gram"]}, common)
    if not bars or not made.languages:
        return made
    shared_grams = kept[kept["docs"] > 1].groupby("lang")["gram"]
    others = make_filters({lang: x.to_numpy(np.int64) for lang, x in shared_grams}, common)
    return replace(made, least=least_shares(sample.select("lang", "text"), made.languages, others))


def least_shares(sample: DataFrame, languages: tuple[str, ...], filters: Filters) -> np.ndarray:
    """By language, the bar for long texts from the shares of its own sampled ones."""
    shared = sample.sparkSession.sparkContext.broadcast(astuple(filters))  # bounded by the sample

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        model = Filters(*shared.value)
        for part in slices(batches):
            langs, shares = [], []
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                codes = letters_of(text, letters)
                if len(codes) > 2:
                    langs.append(lang)
                    shares.append(float(model.shares(codes)[model.languages.index(lang)]) if lang in model.languages else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(shares, pa.float64())], ["lang", "share"])

    low = sample.mapInArrow(own, "lang string, share double").groupBy("lang").agg(F.percentile_approx("share", LOW, 10_000).alias("low"))
    found = {r["lang"]: r["low"] for r in low.collect()}  # a row per language
    return np.array([OF_LOW * found.get(lang, 0.0) for lang in languages])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score, coverage of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(filters))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        model = Filters(*shared.value)
        for part in slices(batches):
            found = [model.predict(t, letters) for t in part.column("text").to_pylist()]
            langs, scores, coverage = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(coverage, pa.float64())],
                ["doc_id", "lang_pred", "score", "coverage"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, coverage double"
    )


def accepts(spark: SparkSession, text: Column, filters: Filters, min_coverage: float = MIN_COVERAGE) -> Column:
    """Whether a text is in one of the languages: it has letters, and the winner knows enough of it."""
    shared = spark.sparkContext.broadcast(astuple(filters))
    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        letters = letter_table()
        model = Filters(*shared.value)
        return pd.Series([model.accepts(t, letters, min_coverage) for t in texts], dtype=bool)

    return test(text)
