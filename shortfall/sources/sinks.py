"""Writes: ordered parquet, CSV with byte-order mark, full replace, snapshot replace, append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(frame: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet in key order: ranges across files, sorted inside each file."""
    (
        frame.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .parquet(path)
    )


def write_csv_bom(frame: DataFrame, path: str) -> None:
    """CSV with header; the first header name carries the UTF-8 byte-order mark."""
    first, *rest = frame.columns
    marked = frame.select(F.col(first).alias("﻿" + first), *rest)
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


PUBLISHED = "decimal(10,2)"


def published(forecast: DataFrame, column: str = "yhat") -> DataFrame:
    """Daily forecasts as they are published, with two decimal places."""
    return forecast.withColumn(column, F.col(column).cast(PUBLISHED))


def replace_table(frame: DataFrame, path: str) -> None:
    """All old rows go, the new ones come."""
    frame.write.mode("overwrite").parquet(path)


def replace_snapshots(frame: DataFrame, path: str, column: str = "eval_date") -> None:
    """Only the dates that occur in the frame are replaced; other snapshots stay."""
    (
        frame.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )


def append_batch(frame: DataFrame, path: str) -> None:
    """Append rows of one or more batches; each batch has its own folder, so writing a batch again
    replaces it instead of doubling it."""
    (
        frame.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def remove_batch(spark: SparkSession, path: str, target: str, batch_id: str) -> None:
    """The stored rows without one batch, written to a new path."""
    stored = spark.read.parquet(path)
    stored.where(F.col("batch_id") != batch_id).write.mode("overwrite").partitionBy(
        "batch_id"
    ).parquet(target)
