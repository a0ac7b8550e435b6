"""Connected components of links between numbers, by alternating stars.

Each round hangs the larger neighbours of every node under the least one, then the smaller ones; after
a few rounds every component is a star around its least number. Minima are combined before the shuffle
and rounds end in stored tables, so no node's neighbours ever meet in one row or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.llm.common import stored


def _larger_to_least(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _smaller_to_least(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return (
        links.join(least, "u")
        .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u != v")
        .distinct()
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: for every linked node the least node that can be reached; roots are not listed."""
    links = stored(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "links",
    )
    mark = F.expr("struct(count(1), sum(cast(xxhash64(u, v) as decimal(38, 0))))").alias("mark")
    before = links.agg(mark).first()["mark"]
    while before[0]:
        links = stored(_smaller_to_least(_larger_to_least(links)), "links")
        now = links.agg(mark).first()["mark"]
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
