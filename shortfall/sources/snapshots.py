"""Risk snapshots kept by date, for later queries over the same input files.

A store is a folder in the shared one, with a partition per date. Its name is made from the input files
(path, length, time of change), so changed input gets a store of its own. Dates are read from the
partitions; only the snapshots that are missing are computed, and each date is replaced as a whole.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortfall.sources.sinks import replace_snapshots
from shortfall.sources.workspace import shared_folder

RULES = 1  # raised when the grading rules change, so that older stores are not read


def input_mark(spark: SparkSession, folder: str, tables: Sequence[str]) -> str:
    """Digest of the input files' names, lengths and times; their content is not read."""
    files = [
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/{t}.parquet")
        for t in tables
    ]
    marks = [
        f.where("path LIKE '%.parquet'")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38, 0)")).alias("h"))
        .first()
        for f in files
    ]
    return hashlib.sha256(repr((RULES, tables, [tuple(m) for m in marks])).encode()).hexdigest()[:32]


class SnapshotStore:
    def __init__(self, spark: SparkSession, name: str, schema: str, column: str = "eval_date"):
        self.spark, self.schema, self.column = spark, schema, column
        self.path = f"{shared_folder(spark)}/shortfall/snapshots-{name}"

    def read(self) -> DataFrame:
        """All stored rows; a filter on the date prunes the other folders."""
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def missing(self, dates: Sequence[datetime.date]) -> list[datetime.date]:
        wanted = self.spark.createDataFrame([(d,) for d in dates], f"{self.column} date")
        known = self.read().select(self.column).distinct()
        return sorted(r[0] for r in wanted.join(known, self.column, "left_anti").collect())

    def at(self, dates: Sequence[datetime.date], compute: Callable[[list[Column]], DataFrame]) -> DataFrame:
        """The snapshots at these dates; `compute` gives the rows of those that are not stored yet."""
        lacking = self.missing(dates)
        if lacking:
            replace_snapshots(compute([F.lit(d) for d in lacking]), self.path, self.column)
        return self.read().where(F.col(self.column).isin(list(dates)))
