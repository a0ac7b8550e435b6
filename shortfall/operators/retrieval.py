"""Exact cosine retrieval over a vector table."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortfall.sources.workspace import ship_by_value

ship_by_value(__name__)

BLOCK_ROWS = 512
CELL_ROWS = 16384  # queries, and index vectors, of a cell
LEAST_CELLS = 64
PLANES = 6
RANK_DIGITS = 9


def dimension_check(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Number of vectors, distinct dimensions, and whether there is one non-zero dimension."""
    size = F.size(column)
    return vectors.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_distinct(size).alias("dimensions"),
        F.min(size).alias("min_dimension"),
        F.max(size).alias("max_dimension"),
    ).withColumn("consistent", (F.col("dimensions") == 1) & (F.col("min_dimension") > 0))


def unit_rows(vectors: DataFrame, id_column: str, column: str = "embedding") -> DataFrame:
    """id, code, v: vectors of length one as 64-bit floats, and the side of a few fixed planes they lie on.

    A zero vector stays zero and so gets similarity zero. Near vectors mostly share their code.
    """
    planes = PLANES

    def scale(batches):
        for batch in batches:
            sizes = set(pc.list_value_length(batch.column("v")).to_pylist())
            if not sizes:
                continue
            if len(sizes) != 1:
                raise ValueError(f"vectors of different dimensions: {sorted(sizes, key=str)}")
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            matrix = flat.reshape(batch.num_rows, -1)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
            normals = np.random.Generator(np.random.PCG64(1)).standard_normal((matrix.shape[1], planes))
            code = ((unit @ normals) > 0) @ (1 << np.arange(planes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(code, pa.int32()), pa.array([row.tobytes() for row in unit], pa.binary())],
                ["id", "code", "v"],
            )

    narrow = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).alias("v"))
    return narrow.mapInArrow(scale, "id bigint, code int, v binary")


def nearest_blocks(centres: np.ndarray, radii: np.ndarray, centre: np.ndarray, radius: float):
    """Blocks by the greatest similarity that a pair with the given block can have, greatest first."""
    gap = np.maximum(np.linalg.norm(centres - centre, axis=1) - radii - radius, 0.0)
    bound = 1.0 - gap * gap / 2
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def cell_top_k(k: int, leave_one_out: bool, minimum: float | None):
    """Arrow function: best k of a cell's index rows for each of its queries."""
    digits, block_rows = RANK_DIGITS, BLOCK_ROWS
    slack = 10.0**-digits

    def sides(cell):
        """Queries, then index rows: blocks of one code as (ids, matrix, centre, radius)."""
        for side in (0, 1):
            rows = cell[cell["side"] == side].sort_values(["code", "id"])
            sizes = set(map(len, rows["v"]))
            found = []
            for _, members in rows.groupby("code", sort=False):
                for start in range(0, len(members), block_rows):
                    part = members.iloc[start : start + block_rows]
                    if len(sizes) != 1:
                        raise ValueError(f"vectors of different dimensions: {sorted(n // 8 for n in sizes)}")
                    matrix = np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), -1)
                    centre = matrix.mean(axis=0)
                    radius = np.linalg.norm(matrix - centre, axis=1).max()
                    found.append((part["id"].to_numpy(), matrix, centre, radius))
            yield found

    def best(key, cell):
        queries, index = sides(cell)
        taken = []
        if queries and index and queries[0][1].shape[1] != index[0][1].shape[1]:
            raise ValueError(f"vectors of different dimensions: {[queries[0][1].shape[1], index[0][1].shape[1]]}")
        for ids, matrix, centre, radius in queries if index else ():
            rows = np.zeros(0, np.int64)
            hits, values = np.zeros(0, np.int64), np.zeros(0)
            least = np.full(len(ids), -np.inf)  # k-th best similarity of each query so far
            order, bounds = nearest_blocks(np.array([x[2] for x in index]), np.array([x[3] for x in index]), centre, radius)
            for at, bound in zip(order, bounds, strict=True):
                if bound + slack < least.min():
                    break  # no pair of this block or the ones behind it can enter
                other_ids, other = index[at][:2]
                scores = np.round(matrix @ other.T, digits)
                if leave_one_out:
                    scores[ids[:, None] == other_ids[None, :]] = -np.inf
                if minimum is not None:
                    scores[scores < minimum] = -np.inf
                if scores.shape[1] > k:
                    enough = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
                    scores[scores < enough[:, None]] = -np.inf
                new, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                rows = np.concatenate([rows, new])
                hits, values = np.concatenate([hits, other_ids[column]]), np.concatenate([values, scores[new, column]])
                sort = np.lexsort((hits, -values, rows))
                rows, hits, values = rows[sort], hits[sort], values[sort]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, hits, values, rank = (c[rank < k] for c in (rows, hits, values, rank))
                full = rank == k - 1
                least[rows[full]] = values[full]
            taken.append(pd.DataFrame({"query_id": ids[rows], "vec_id": hits, "similarity": values}))
        columns = {"query_id": "int64", "vec_id": "int64", "similarity": "float64"}
        return pd.concat(taken) if taken else pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()})

    return best


def cosine_top_k(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    leave_one_out: bool = False,
    minimum: float | None = None,
    id_column: str = "vec_id",
) -> DataFrame:
    """The k most similar index vectors of every query; equal similarities go by id.

    Queries are dealt to the rows of a grid and index vectors to its columns, so each vector is copied to one
    row or column of cells, and one grouping brings a cell's vectors together. Only k rows per query leave a
    cell. Inside it, vectors are searched in blocks, nearest first by centre and radius, until no block can
    hold a better hit. The result is exact.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    one = F.lit(1).cast("bigint")
    counts = [side.agg(F.count(F.lit(1))).scalar() for side in (queries, index)]
    # Cells of many rows copy less; a small input still makes a few dozen cells.
    wished = F.ceil(F.sqrt(counts[0].cast("double") * counts[1] / LEAST_CELLS))
    cell_rows = F.least(F.greatest(wished, F.lit(BLOCK_ROWS)), F.lit(CELL_ROWS))
    bands = [F.greatest(one, F.ceil(n / cell_rows).cast("bigint")) for n in counts]

    def dealt(side: int, vectors: DataFrame) -> DataFrame:
        band = F.pmod(F.xxhash64("id"), bands[side])
        across = F.explode(F.sequence(F.lit(0).cast("bigint"), bands[1 - side] - 1)).alias("across")
        rows = unit_rows(vectors, id_column).select("id", "code", "v", band.alias("band"), across)
        row, column = ("band", "across") if side == 0 else ("across", "band")
        return rows.select(
            F.lit(side).alias("side"), "id", "code", "v", F.col(row).alias("cell_row"), F.col(column).alias("cell_column")
        )

    local = (
        dealt(0, queries)
        .unionByName(dealt(1, index))
        .groupBy("cell_row", "cell_column")
        .applyInPandas(cell_top_k(k, leave_one_out, minimum), "query_id bigint, vec_id bigint, similarity double")
    )
    # The rank limit is applied in every task before the shuffle, so a query's candidates from many
    # cells shrink to k rows per task.
    nearest = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "similarity")
    )


def retrieval_quality(top: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of queries whose best hit, or any hit, has the query's own category."""
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    hit = labels.select("vec_id", F.col("label").alias("found"))
    same = F.col("own") == F.col("found")
    per_query = (
        own.join(top.join(hit, "vec_id"), "query_id", "left")
        .groupBy("query_id")
        .agg(
            F.coalesce(F.bool_or(same & (F.col("rank") == 1)), F.lit(False)).alias("top1"),
            F.coalesce(F.bool_or(same), F.lit(False)).alias("topk"),
            F.sum("similarity").alias("sim_sum"),
            F.count("similarity").alias("sim_count"),
            F.min("similarity").alias("sim_min"),
        )
    )
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        (F.count_if("top1") / F.count(F.lit(1))).alias("top1_same_rate"),
        (F.count_if("topk") / F.count(F.lit(1))).alias("topk_same_rate"),
        (F.sum("sim_sum") / F.sum("sim_count")).alias("similarity_mean"),
        F.min("sim_min").alias("similarity_min"),
    )
