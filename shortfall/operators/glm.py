"""Weighted Tweedie regressions with a log link, one for each cutoff, fitted together.

The models of all cutoffs learn from one stored panel: a row counts for the cutoffs in whose training
window its day lies. An iteration of the weighted least squares is one pass over the panel. A task adds up
one matrix per cutoff (outer products of the features and of the working response), Spark adds up the
tasks' matrices, and the driver solves one small system per cutoff. What moves is bounded by the number of
tasks, cutoffs and features, not by the rows.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.sources.workspace import ship_by_value

ship_by_value(__name__)

POWER = 1.2
RIDGE = 1e-3
ITERATIONS = 15
TOLERANCE = 1e-6
WIDEST = 20.0  # logarithms of predictions stay inside
EPOCH = datetime.date(1970, 1, 1)

PANEL = "sku_id, date, label, weight, features array<double>, own array<double>"


def day_numbers(cutoffs: Sequence[datetime.date]) -> list[int]:
    return [(c - EPOCH).days for c in cutoffs]


class Block:
    """Rows of an Arrow batch: day numbers, labels, weights, shared features and one own feature a cutoff."""

    def __init__(self, batch: pa.RecordBatch):
        self.day = batch.column("date").cast(pa.int32()).to_numpy(zero_copy_only=False)
        self.shared = self.table(batch.column("features"), batch.num_rows)
        self.own = self.table(batch.column("own"), batch.num_rows)
        self.batch = batch

    @staticmethod
    def table(column: pa.Array, rows: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)

    def rows(self, k: int, after: int, upto: int) -> np.ndarray:
        """Rows of a cutoff with a day in (after, upto]; a series without an own value is not known to it."""
        return np.flatnonzero((self.day > after) & (self.day <= upto) & ~np.isnan(self.own[:, k]))

    def design(self, rows: np.ndarray, k: int) -> np.ndarray:
        return np.column_stack([np.ones(len(rows)), self.shared[rows], self.own[rows, k]])

    def numbers(self, name: str) -> np.ndarray:
        return self.batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def working(design: np.ndarray, label: np.ndarray, weight: np.ndarray, model: np.ndarray | None, power: float) -> np.ndarray:
    """Sum over rows of weighted outer products of the features, with the working response as last column."""
    if model is None:
        mean = label + 0.5
        line = np.log(mean)
    else:
        line = np.clip(design @ model, -WIDEST, WIDEST)
        mean = np.exp(line)
    scaled = design * (weight * mean ** (2 - power))[:, None]
    response = line + (label - mean) / mean
    return np.column_stack([scaled.T @ design, scaled.T @ response])


def solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients from the summed matrix; all but the intercept are held back by the ridge."""
    gram, response = sums[:, :-1], sums[:, -1]
    hold = ridge * gram[0, 0] * np.eye(len(gram))
    hold[0, 0] = 0.0
    return np.linalg.solve(gram + hold, response)


def fit(
    panel: DataFrame, cutoffs: Sequence[datetime.date], window: int, power: float = POWER, ridge: float = RIDGE
) -> dict[int, np.ndarray]:
    """Coefficients by position of the cutoff; a cutoff without training rows has none.

    `panel` has the columns of PANEL and is read once in each iteration: it should be a stored table.
    """
    days = day_numbers(cutoffs)
    models: dict[int, np.ndarray] = {}
    for _ in range(ITERATIONS):
        known = dict(models)

        def sums(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                block = Block(batch)
                label, weight = block.numbers("label"), block.numbers("weight")
                for k, day in enumerate(days):
                    rows = block.rows(k, day - window, day)
                    if len(rows):
                        part = working(block.design(rows, k), label[rows], weight[rows], known.get(k), power)
                        totals[k] = totals[k] + part if k in totals else part
            arrays = [pa.array(list(totals), pa.int32()), pa.array([t.ravel() for t in totals.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "total"])

        learned = panel.where(F.col("label").isNotNull())
        found = (
            learned.mapInArrow(sums, "k int, total array<double>")
            .select("k", F.posexplode("total").alias("at", "value"))
            .groupBy("k", "at")
            .agg(F.sum("value").alias("value"))
            .groupBy("k")
            .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("total"))
            .collect()
        )
        moved = 0.0
        for r in found:
            values = np.array([x["value"] for x in r["total"]])
            size = int(np.sqrt(len(values)))  # size * (size + 1) numbers
            models[r["k"]] = solved(values.reshape(size, size + 1), ridge)
            moved = max(moved, np.abs(models[r["k"]] - known.get(r["k"], np.inf)).max())
        if moved < TOLERANCE:
            break
    return models


def predict(panel: DataFrame, models: dict[int, np.ndarray], cutoffs: Sequence[datetime.date], ahead: int) -> DataFrame:
    """eval_date, sku_id, date, yhat of the rows in (cutoff, cutoff + ahead] of each cutoff."""
    days = day_numbers(cutoffs)

    def forecast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = Block(batch)
            for k, model in models.items():
                rows = block.rows(k, days[k], days[k] + ahead)
                if len(rows):
                    yhat = np.exp(np.clip(block.design(rows, k) @ model, -WIDEST, WIDEST))
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), days[k]), pa.int32()).cast(pa.date32()),
                            taken.column("sku_id"),
                            taken.column("date"),
                            pa.array(yhat),
                        ],
                        ["eval_date", "sku_id", "date", "yhat"],
                    )

    key = panel.schema["sku_id"].dataType.simpleString()
    return panel.mapInArrow(forecast, f"eval_date date, sku_id {key}, date date, yhat double")
