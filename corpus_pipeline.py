"""A corpus from documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is written as Parquet
before the next one reads it. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortfall.llm import dedup, lang_filters, mixing, near_texts, packing
from shortfall.llm.common import stored
from shortfall.llm.queries import language_filters, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from their own labels; the rest goes."""
    return docs.where(lang_filters.accepts(spark, F.col("text"), language_filters(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share four fifths of their five-word shingles."""
    return near_texts.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by the sources' target weights; a row may come twice."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document lies in the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mix", mix),
    ("pack", pack),
]

# Trained filters, hashes of shingles and packing have no SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
