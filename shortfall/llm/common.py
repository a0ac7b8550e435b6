"""Helpers shared by the corpus operators.

Texts of all operators: null counts as the empty text. Words are runs of characters outside
`[\\x20\\x09-\\x0D]`; in Python `bytes.split()` splits at exactly these bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortfall.sources.workspace import scratch_path

SPACE = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"


def by_value(module: str) -> None:
    """Ship the functions of a module with each task, so that workers need not import the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, safe from lost executors."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words. Each word and the blanks after it become one character."""
    started = F.ltrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.length(F.regexp_replace(started, f"[^{SPACE}]++[{SPACE}]*+", "x")).cast("bigint")


def fraction(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) * F.lit(2.0**-53)


WORD_BITS = 6
BUCKETS = 1 << 26  # bits of a set of hashes; a 64th of it in rows


def bucket(columns: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets))


def hash_bits(keys: DataFrame, *columns: str, buckets: int = BUCKETS) -> DataFrame:
    """A set of keys as bits in words of 64 (word, bits): at most a million rows, however many keys there are.
    With so many that most bits are set, more keys than these seem to be in it."""
    bit = F.expr(f"shiftleft(1L, cast(bucket & {(1 << WORD_BITS) - 1} as int))")
    words = (
        keys.select(bucket(columns, buckets).alias("bucket"))
        .groupBy(F.shiftright("bucket", WORD_BITS).alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
    )
    return stored(words, "hash-bits")


def with_mark(rows: DataFrame, bits: DataFrame, *columns: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds `marked`: false where the row's key is certainly not in the set, or has a null."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    found = F.expr(f"getbit(bits, cast(bucket & {(1 << WORD_BITS) - 1} as int)) = 1")
    return (
        rows.withColumn("bucket", F.when(known, bucket(columns, buckets)))
        .withColumn("word", F.shiftright("bucket", WORD_BITS))
        .join(F.broadcast(bits), "word", "left")
        .withColumn("marked", F.coalesce(found, F.lit(False)))
        .drop("bucket", "word", "bits")
    )


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in small slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def light_slices(batches: Iterator, text: str, rows: int = 256, most: int = 8 << 20) -> Iterator:
    """Arrow batches in slices of few rows and few bytes of a text column; a longer text comes alone."""
    for batch in batches:
        start = size = 0
        for at, length in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
            length = length or 0
            if at > start and (at - start == rows or size + length > most):
                yield batch.slice(start, at - start)
                start, size = at, 0
            size += length
        if batch.num_rows > start:
            yield batch.slice(start)


by_value(__name__)
