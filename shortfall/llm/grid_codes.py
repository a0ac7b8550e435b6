"""Product codes of vectors, with a memo of grid cells in front of the exact distances.

Vectors become whole numbers and are cut into equal parts. Each part position has a codebook, improved
by a few rounds of nearest entries and means. To find a part's nearest entry, the part is first dealt to
a coarse grid cell. For a cell, the entries that no other entry dominates across the cell's box (least
distance to the box at most the smallest greatest distance of any entry) are found once and kept under
the cell's hash; only these are then evaluated exactly, in whole numbers. The grid decides the work, never
the result.

Each round is one pass over the stored whole numbers: a task sends one row per entry with a count and
sums, Spark adds them up, and the driver holds the codebooks alone (parts x entries x width numbers).

Defined results: vectors that are null, empty or hold a null or non-finite component are left out; other
vectors must have one length, a multiple of the number of parts, and components under 32,768 in size (so
that distances are exact in 64 bits), or the run ends with an error. Repeated rows are coded each; an id
that comes more than once counts once among the first entries, with its smallest vector; null ids come
after all others, null labels are one group. With fewer ids than entries the codebooks are shorter. An
empty table gives an empty result. Further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from shortfall.llm.common import by_value, stored

by_value(__name__)

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 1 << 15  # components of the given vectors
LEVELS = 8  # grid cells across the widest range of a codebook: a third of the entries is left to evaluate
EDGE = 120  # the outermost cells, which have no outer wall
MEMO_CELLS = 1 << 16
FAR = np.iinfo(np.int64).max


@dataclass
class Codes:
    frame: DataFrame  # vec_id, label, codes, error, label_error
    codebooks: np.ndarray  # part, entry, component


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, v array<int> of the vectors that can be coded."""
    def finite(x: Column) -> Column:  # NaN is greater than all numbers
        return F.abs(x.cast("double")) < float("inf")

    def whole(x: Column) -> Column:
        inside = F.abs(x) < LARGEST
        fail = F.raise_error(F.lit(f"vector component of {LARGEST} or more"))
        return F.when(inside, F.floor(x.cast("double") * scale).cast("int")).otherwise(fail.cast("int"))

    usable = F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))
    return vectors.where(usable).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.transform(vector, whole).alias("v")
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


class Grid:
    """Nearest entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.origin = entries.min(axis=0)
        spread = int((entries.max(axis=0) - self.origin).max())
        self.side = max(1, -(-spread // LEVELS))
        self.memo: dict[bytes, np.ndarray] = {}

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """cell, entry -> whether the entry can be nearest somewhere in the cell."""
        low = (self.origin + cells * self.side)[:, None, :]
        high = low + self.side - 1
        open_low, open_high = (cells == -EDGE)[:, None, :], (cells == EDGE)[:, None, :]
        below = np.where(open_low, 0, np.maximum(low - self.entries, 0))
        above = np.where(open_high, 0, np.maximum(self.entries - high, 0))
        least = (np.maximum(below, above) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(low - self.entries), np.abs(high - self.entries)) ** 2).sum(axis=2)
        most[(open_low | open_high).any(axis=(1, 2))] = FAR
        return least <= most.min(axis=1, keepdims=True)

    def allowed(self, parts: np.ndarray) -> np.ndarray:
        """row, entry -> whether the entry has to be evaluated."""
        cells = np.clip((parts - self.origin) // self.side, -EDGE, EDGE).astype(np.int8)
        keys = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.shape[1]))).ravel()
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        names = [keys[i].tobytes() for i in first]
        if len(self.memo) + len(names) > MEMO_CELLS:
            self.memo.clear()
        new = [k for k, name in enumerate(names) if name not in self.memo]
        if new:
            found = self.undominated(cells[first[new]].astype(np.int64))
            self.memo.update((names[k], row) for k, row in zip(new, found, strict=True))
        return np.array([self.memo[name] for name in names])[inverse.ravel()]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower one of equals) and its squared distance."""
        rows, entries = np.nonzero(self.allowed(parts))
        distances = np.full((len(parts), len(self.entries)), FAR)
        distances[rows, entries] = ((parts[rows] - self.entries[entries]) ** 2).sum(axis=1)
        index = distances.argmin(axis=1)
        return index, distances[np.arange(len(parts)), index]


def first_entries(rows: DataFrame, entries: int, parts: int) -> np.ndarray:
    """Codebooks cut from the vectors with the smallest ids."""
    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        names = None
        for batch in batches:
            names = batch.schema
            ids = batch.column("vec_id").to_pylist()
            last = sorted(set(ids) | set(best), key=lambda x: (x is None, x or 0))[:entries][-1] if ids else None
            near = [i for i, x in enumerate(ids) if last is None or (x is not None and x <= last)]
            for row in batch.take(pa.array(near, pa.int64())).to_pylist():
                best[row["vec_id"]] = min(best.get(row["vec_id"], row["v"]), row["v"])
            kept = sorted(best, key=lambda x: (x is None, x or 0))[:entries]
            best = {x: best[x] for x in kept}
        if best:
            yield pa.RecordBatch.from_pylist([{"vec_id": x, "v": v} for x, v in best.items()], schema=names)

    narrow = rows.select("vec_id", "v")
    found = (
        narrow.mapInArrow(smallest, narrow.schema)
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .orderBy(F.col("vec_id").asc_nulls_last())
        .limit(entries)
        .collect()
    )
    table = np.array([r["v"] for r in found], dtype=np.int64)
    return table.reshape(len(found), parts, -1).transpose(1, 0, 2)


def improved(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry becomes the floor of the mean of its parts."""
    parts, entries, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(c) for c in codebooks]
        counts = np.zeros((parts, entries), np.int64)
        totals = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            table = matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
            for p, grid in enumerate(grids):
                index, _ = grid.nearest(table[:, p])
                counts[p] += np.bincount(index, minlength=entries)
                np.add.at(totals[p], index, table[:, p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                pa.array(entry, pa.int32()),
                pa.array(counts[part, entry], pa.int64()),
                pa.array(list(totals[part, entry]), pa.list_(pa.int64())),
            ],
            ["part", "entry", "n", "total"],
        )

    added = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    found = (
        rows.select("v")
        .mapInArrow(sums, "part int, entry int, n bigint, total array<bigint>")
        .groupBy("part", "entry")
        .agg(F.sum("n").alias("n"), *added)
        .collect()
    )
    better = codebooks.copy()
    for r in found:
        better[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return better


def coded(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, codes, error."""
    parts, _, width = codebooks.shape
    plain = rows.select("vec_id", "label")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(c) for c in codebooks]
        for batch in batches:
            table = matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
            found = [grid.nearest(table[:, p]) for p, grid in enumerate(grids)]
            codes = np.stack([index for index, _ in found], axis=1)
            offsets = np.arange(0, codes.size + 1, parts, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel(), pa.int64())),
                    pa.array(sum(distance for _, distance in found), pa.int64()),
                ],
                ["vec_id", "label", "codes", "error"],
            )

    schema = StructType(
        [*plain.schema.fields, StructField("codes", ArrayType(LongType())), StructField("error", LongType())]
    )
    return rows.mapInArrow(assign, schema)


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codes:
    """Codes of all usable vectors, their errors, and the codebooks."""
    rows = stored(whole_numbers(vectors, vec_id, vector, label, scale), "code-vectors")
    size = F.size("v")
    least, most = rows.agg(F.min(size), F.max(size)).first()
    if least != most or (most or 0) % parts:
        raise ValueError(f"vectors of {least} to {most} components; one multiple of {parts} is needed")
    if most is None:
        codebooks = np.zeros((parts, 0, 0), np.int64)
        nothing = rows.select(
            "vec_id", "label", F.col("v").cast("array<bigint>").alias("codes"), F.lit(0).cast("bigint").alias("error")
        )
        return Codes(nothing.withColumn("label_error", F.lit(0).cast("bigint")), codebooks)
    codebooks = first_entries(rows, entries, parts)
    for _ in range(rounds):
        codebooks = improved(rows, codebooks)
    done = stored(coded(rows, codebooks), "codes")
    by_label = done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    frame = done.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    return Codes(frame, codebooks)
