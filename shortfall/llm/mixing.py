"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 48-bit hash of its key. For each source the words are summed by hash bucket; the bucket
in which the budget is reached is refined by the next bits, and no other. The result is a threshold
per source: rows below it are taken, without a sort. A source's budget may be over its size; then all
rows are taken once, and those below the threshold once more.

Defined results: sources are ordered by code point, null last; rows with equal keys of a source are
taken together; rows without words are taken by the same threshold with 0 words; an empty table gives
an empty result. The rows at the threshold are taken when that comes nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortfall.llm.common import stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
LEVELS = 4
BITS = 12


def hash48(key: Column) -> Column:
    """First 48 bits of the md5 of the key as text, unsigned."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("bigint")


def sized(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(doc).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        hash48(F.col(doc)).alias("h"),
    )


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target; one row per source.

    The budget is shared by weight. No source gets more than `most` times its size; what is over goes
    to the others by weight. Sources ordered by how soon they are full (size per weight) fill up one
    after the other, so running sums give the level at which the rest stop.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    full = F.col("source_size") * F.lit(float(most))
    ranked = sizes.select("source", "source_size", weight.alias("weight"), full.alias("full"))
    by_fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(upto), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    # The first source that its own level does not fill sets the level of all that follow.
    stop = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), "level"))).over(everything)["level"]
    return levels.select(
        "source",
        F.col("source_size").cast("bigint").alias("source_size"),
        F.least(F.col("full"), F.coalesce(stop, F.lit(float("inf"))) * F.col("weight")).alias("target"),
    )


def thresholds(rows: DataFrame, goals: DataFrame, levels: int = LEVELS, bits: int = BITS) -> DataFrame:
    """source, source_size, target, rounds, limit: rows with h < limit are taken once more.

    `rounds` is how often all rows are taken.
    """
    per = 1 << bits
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = stored(
        goals.select(
            F.struct("source").alias("key"),
            "source_size",
            "target",
            rounds.alias("rounds"),
            (F.col("target") - F.col("source_size") * rounds).alias("rest"),
            F.lit(0.0).alias("below"),
            F.lit(0).cast("bigint").alias("prefix"),
        ),
        "mix-state",
    )
    rows = rows.select(F.struct("source").alias("key"), "size", "h")
    for level in range(levels):
        shift = bits * (levels - 1 - level)
        open_rows = rows.join(state.select("key", "prefix"), "key")
        if level:
            open_rows = open_rows.where(F.shiftright("h", shift + bits) == F.col("prefix"))
        buckets = open_rows.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").cast("double").alias("words")
        )
        running = Window.partitionBy("key").orderBy("bucket")
        summed = (
            buckets.withColumn("upto", F.sum("words").over(running))
            .join(state.select("key", "below", "rest"), "key")
            .withColumn("over", F.col("below") + F.col("upto") > F.col("rest"))
        )
        # The boundary: the first bucket that goes over the budget.
        found = summed.groupBy("key").agg(
            F.min(F.when(F.col("over"), F.struct("bucket", F.col("upto") - F.col("words"), "words"))).alias("at")
        ).select(
            "key",
            F.col("at.bucket").alias("bucket"),
            F.col("at.col2").alias("before"),
            F.col("at.words").alias("words"),
        )
        keeps = F.col("bucket").isNull()
        state = stored(
            state.drop("words").join(found, "key", "left").select(
                "key",
                "source_size",
                "target",
                "rounds",
                "rest",
                F.when(keeps, F.col("below")).otherwise(F.col("below") + F.col("before")).alias("below"),
                # No boundary: past the last bucket, everything is below the threshold.
                F.when(keeps, F.shiftleft("prefix", bits) if level else F.lit(per).cast("bigint"))
                .otherwise(F.col("bucket"))
                .alias("prefix"),
                "words",
            ),
            "mix-state",
        )
    nearer = F.coalesce(F.col("below") + F.col("words") - F.col("rest") < F.col("rest") - F.col("below"), F.lit(False))
    return state.select(
        F.col("key.source").alias("source"),
        "source_size",
        "target",
        "rounds",
        (F.col("prefix") + nearer.cast("bigint")).alias("limit"),
    )


def decide(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Thresholds of the sources of sized rows, as a stored table of one row per source."""
    return stored(thresholds(rows, targets(rows, weights, share, most)), "mix-limits")


def times() -> Column:
    """How often a row with h, rounds and limit is taken."""
    return F.col("rounds") + (F.col("h") < F.col("limit")).cast("bigint")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every row."""
    rows = stored(sized(docs), "mix-rows")
    limits = decide(rows, **settings).withColumnRenamed("source", "of")
    joined = rows.join(limits, F.col("source").eqNullSafe(F.col("of")))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * times()).alias("taken")
    )


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    limits = decide(stored(sized(docs), "mix-rows"), **settings).withColumnRenamed("source", "of")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("whole"), "source", hash48(F.col("doc_id")).alias("h"))
    joined = keyed.join(limits, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("whole", F.explode(F.array_repeat(F.lit(1), times().cast("int")))).select("whole.*")
