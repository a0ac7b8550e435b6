"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after all blanks are deleted. Lengths are counted first; the
prefix hash is taken only of rows that share their length, the full hash only of rows that share length and
prefix hash too. What the first steps leave open is handed to the last scan as a set of bits, which is broadcast
whatever the size of the corpus (`hash_bits`), so no text is shuffled for it. With so many shared pairs that
most bits are set, more rows than need be are hashed.

Defined results: null, empty and blank texts are equal. Of equal texts the row with the most code
points stays, then the smallest doc_id (null last); of rows that agree in both, exactly one. An empty
table gives an empty result; further columns are ignored by `refine` and kept by `keep_one`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortfall.llm.common import BUCKETS, SPACE, hash_bits, stored, text_or_empty, with_mark

PREFIX = 64


def squeezed(text: str) -> Column:
    return F.regexp_replace(text_or_empty(text), f"[{SPACE}]++", "")


def with_lengths(docs: DataFrame, text: str) -> DataFrame:
    """Adds `squeezed` and its `length`."""
    return docs.withColumn("squeezed", squeezed(text)).withColumn("length", F.length("squeezed"))


def shared_lengths(docs: DataFrame, text: str) -> DataFrame:
    """Lengths that several rows have, as `shared`."""
    lengths = docs.select(text).transform(with_lengths, text).groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    return stored(lengths.where("n > 1").select(F.col("length").alias("shared")), "dedup-lengths")


def with_prefix(docs: DataFrame, text: str, lengths: DataFrame) -> DataFrame:
    """Adds `squeezed`, `length` and the hash of the prefix, null where nothing shares the length."""
    prefix = F.xxhash64(F.substring("squeezed", 1, PREFIX))
    return (
        with_lengths(docs, text)
        .join(lengths, F.col("length") == F.col("shared"), "left")
        .withColumn("prefix", F.when(F.col("shared").isNotNull(), prefix))
        .drop("shared")
    )


def open_pairs(docs: DataFrame, text: str, lengths: DataFrame) -> DataFrame:
    """The (length, prefix hash) pairs that several rows share."""
    pairs = with_prefix(docs.select(text), text, lengths).where("prefix is not null").groupBy("length", "prefix")
    return pairs.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_full_hash(docs: DataFrame, text: str, all_rows: bool) -> DataFrame:
    """Adds `open` (not settled by length and prefix) and `full_hash` (null where settled, unless
    `all_rows` asks for it everywhere)."""
    lengths = shared_lengths(docs, text)
    bits = hash_bits(open_pairs(docs, text, lengths), "length", "prefix", buckets=BUCKETS)
    flagged = with_mark(with_prefix(docs, text, lengths), bits, "length", "prefix", buckets=BUCKETS)
    digest = F.sha2("squeezed", 256)
    return (
        flagged.withColumnRenamed("marked", "open")
        .withColumn("full_hash", digest if all_rows else F.when(F.col("open"), digest))
        .drop("squeezed", "length", "prefix")
    )


def _best(doc: str, chars: str, row: str | None = None) -> Column:
    """Orders rows of a group: most code points, smallest id with null last, first row."""
    parts = [F.col(chars).alias("c"), F.bitwise_not(F.col(doc)).alias("d")]
    return F.struct(*parts, *([F.bitwise_not(F.col(row)).alias("r")] if row else []))


def refine(docs: DataFrame, doc: str = "doc_id", text: str = "text", all_hashes: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    With `all_hashes` the digest is given for settled rows too, else only for the open ones.
    """
    narrow = with_full_hash(
        docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), "text", all_hashes
    ).select(
        "doc_id",
        F.length(text_or_empty("text")).alias("chars"),
        "open",
        "full_hash",
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(narrow, "dedup-rows")
    # Stored, so that the join below is free to split the rows of a hot group.
    groups = stored(
        rows.where("open")
        .groupBy("full_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.max(_best("doc_id", "chars", "row")).alias("best"))
        .where("n > 1")
        .withColumnRenamed("full_hash", "shared_hash"),
        "dedup-groups",
    )
    joined = rows.join(groups, F.col("full_hash") == F.col("shared_hash"), "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.bitwise_not(F.col("best.d"))).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.bitwise_not(F.col("best.r")))).alias("kept"),
        F.col("full_hash").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns. Texts meet only narrow rows, joined by their hash."""
    columns = docs.columns
    hashed = with_full_hash(
        docs.select(
            F.struct(*(F.col(f"`{c}`") for c in columns)).alias("whole"),
            F.col(doc).alias("id"),
            F.col(text).alias("body"),
        ),
        "body",
        all_rows=False,
    ).withColumn("chars", F.length(text_or_empty("body")))
    groups = stored(
        hashed.where("open")
        .groupBy("full_hash", "chars", "id")
        .agg(F.count(F.lit(1)).alias("same"))
        .groupBy("full_hash")
        .agg(
            F.sum("same").alias("n"),
            F.max(F.struct(F.col("chars").alias("c"), F.bitwise_not(F.col("id")).alias("d"), F.col("same").alias("s"))).alias("best"),
        )
        .where("n > 1")
        .select(
            F.col("full_hash").alias("shared_hash"),
            F.col("best.c").alias("best_chars"),
            F.bitwise_not(F.col("best.d")).alias("best_id"),
            F.col("best.s").alias("same"),
        ),
        "dedup-groups",
    )
    stays = F.col("shared_hash").isNull() | (
        (F.col("chars") == F.col("best_chars")) & F.col("id").eqNullSafe(F.col("best_id"))
    )
    # Settled rows go past the join; only the texts of open ones are shuffled.
    settled = hashed.where(~F.col("open")).select("whole.*")
    joined = (
        hashed.where("open")
        .join(groups.hint("shuffle_hash"), F.col("full_hash") == F.col("shared_hash"), "left")
        .where(stays)
    )
    once = settled.unionByName(joined.where("same is null or same = 1").select("whole.*"))
    if groups.where("same > 1").isEmpty():
        return once
    # Rows that agree in length, id and squeezed text: one of each remains.
    repeated = joined.where("same > 1").groupBy("full_hash").agg(F.first("whole").alias("whole"))
    return once.unionByName(repeated.select("whole.*"))
