"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into bins at the quantiles of the training rows. Boosting goes round the features; at
each turn a shallow tree over one feature's bins is fitted to the residuals and added to the feature's
lookup table. The pairs of features with the largest remaining gain are boosted in the same way with
trees over two features. A text's score is the sum of its bins' entries, added column by column.

Labels are fitted on at most TRAIN_ROWS documents, the first by hash of their key (the documented bound
of the sample); scoring takes every row and whole texts.

Defined results: null is the empty text, and is scored; rows without a label are not learned from, a
document labelled more than once counts with its mean label; without any label all scores are 0.5; null
keys and repeated rows are scored like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.llm.common import by_value, fraction, slices

by_value(__name__)

TRAIN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 8
RATE = 0.1
SHRINK = 1.0
THRESHOLD = 0.3
FEATURES = (
    "words", "word_bytes", "longest", "upper", "symbols", "shouts", "bars", "digits", "stops", "non_ascii", "blanks",
    "entropy", "distinct", "top_word", "distinct_pairs", "repeated_lines", "line_words",
)


def byte_classes() -> np.ndarray:
    """Bytes by class: upper, lower, symbols, shouts, bars, digits, stops, not ASCII, blanks."""
    groups = (
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#*$%&<>@^~=_{}[]\\", b"!?", b"|", b"0123456789",
        b".,;:", bytes(range(128, 256)), b" \t\n\x0b\x0c\r",
    )
    table = np.zeros((256, len(groups)))
    for i, group in enumerate(groups):
        table[np.frombuffer(group, np.uint8), i] = 1
    return table


def text_features(text: str | None, classes: np.ndarray) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, symbols, shouts, bars, digits, stops, non_ascii, blanks = seen @ classes / len(raw)
    share = seen[seen > 0] / len(raw)
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    n = len(words)
    return [
        np.log1p(n),
        (len(raw) * (1 - blanks)) / n,
        np.log1p(max(map(len, counts))),
        upper / max(upper + lower, 1e-9),
        symbols, shouts, bars, digits, stops, non_ascii, blanks,
        float(-(share * np.log2(share)).sum()),
        len(counts) / n,
        max(counts.values()) / n,
        len(set(zip(words, words[1:], strict=False))) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
    ]


# -- shallow trees over bins -------------------------------------------------------------


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 cuts nothing."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK) - all_g**2 / (all_h + SHRINK)
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 0 else (0.0, 0)


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Steps of the bins from a tree of the given depth."""
    place = _cut(g, h)[1] if depth else 0
    if not place:
        return np.full(len(g), RATE * g.sum() / (h.sum() + SHRINK))
    return np.concatenate([_leaves(g[:place], h[:place], depth - 1), _leaves(g[place:], h[place:], depth - 1)])


def _pair_leaves(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of a tree that cuts one feature, then the other on both sides."""
    best = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for place in range(1, len(a)):
            gain, steps = 0.0, np.zeros(a.shape)
            for side in (slice(0, place), slice(place, None)):
                rows_g, rows_h = a[side].sum(axis=0), b[side].sum(axis=0)
                steps[side] = _leaves(rows_g, rows_h, 1)
                cut, at = _cut(rows_g, rows_h)
                gain += cut + rows_g.sum() ** 2 / (rows_h.sum() + SHRINK)
            gain -= g.sum() ** 2 / (h.sum() + SHRINK)
            if gain > best[0]:
                best = gain, steps.T if turned else steps
    return best


@dataclass
class Additive:
    """Lookup tables of features and of pairs of features."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, features: np.ndarray) -> np.ndarray:
        total = np.full(len(features), self.start)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[i], features[:, i], side="right")]
        coarse = {
            i: np.searchsorted(self.pair_edges[i], features[:, i], side="right") for i in {i for pair in self.pairs for i in pair}
        }
        for (i, j), table in self.pairs.items():
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def boost(features: np.ndarray, labels: np.ndarray) -> Additive:
    """Fits the tables; labels from 0 to 1."""
    if not len(labels):
        return Additive()
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model = Additive(start=float(np.log(share / (1 - share))))
    for column in features.T:
        quantiles = [np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1])) for n in (BINS, PAIR_BINS)]
        model.edges.append(quantiles[0])
        model.pair_edges.append(quantiles[1])
        model.tables.append(np.zeros(len(quantiles[0]) + 1))
    fine = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, features.T, strict=True)]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, features.T, strict=True)]
    total = np.full(len(labels), model.start)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, table in enumerate(model.tables):
            g, h = residuals()
            steps = _leaves(np.bincount(fine[i], g, len(table)), np.bincount(fine[i], h, len(table)), 2)
            table += steps
            total += steps[fine[i]]

    def summed(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = residuals()
    gains = {
        pair: _pair_leaves(summed(*pair, g), summed(*pair, h))[0] for pair in combinations(range(features.shape[1]), 2)
    }
    for i, j in sorted(gains, key=lambda pair: (-gains[pair], pair))[:PAIRS]:
        model.pairs[i, j] = np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            g, h = residuals()
            steps = _pair_leaves(summed(i, j, g), summed(i, j, h))[1]
            table += steps
            total += steps[coarse[i], coarse[j]]
    return model


# -- DataFrames --------------------------------------------------------------------------


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, features (array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes()
        for part in slices(batches):
            rows = [text_features(t, classes) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"]
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, features array<double>"
    )


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Additive:
    """Model from doc_id, text and doc_id, label. At most `train_rows` labels are used, and of rows that share a
    doc_id those with the least features, so the side that is broadcast and the rows that reach the driver are
    bounded."""
    chosen = (
        labels.where("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.avg(F.col("label").cast("double")).alias("label"))
        .orderBy(fraction(F.col("doc_id")), "doc_id")
        .limit(train_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = featured(sample).groupBy("doc_id").agg(F.min("features").alias("features"))
    rows = once.join(F.broadcast(chosen), "doc_id").toPandas().sort_values("doc_id")
    if not len(rows):
        return Additive()
    return boost(np.array(rows["features"].tolist()), rows["label"].to_numpy(float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes()
        for part in slices(batches):
            rows = [text_features(t, classes) for t in part.column("text").to_pylist()]
            found = model.score(np.array(rows)) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
