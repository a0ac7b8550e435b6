from __future__ import annotations

import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("shortfall-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    from shortfall.sources.tables import PlanningTables

    return PlanningTables(spark, SMALL)


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def days(first: str, count: int) -> list[datetime.date]:
    return [day(first) + datetime.timedelta(days=i) for i in range(count)]


def rows(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=str)
