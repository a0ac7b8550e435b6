"""Where jobs keep checkpoints and intermediate tables, and how their functions reach the workers."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_private: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a private one only for local sessions without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _private:
        _private[application] = tempfile.mkdtemp(prefix="shortfall-")
    return _private[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/shortfall/{label}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end, so that those of several writes do not
    add up on disk. Nothing reads them again: what a later query needs is written out."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def ship_by_value(module: str) -> None:
    """Ship the functions of a module with each task, so that workers need not import the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
