"""Shards from a weighted hash tree: region, rack, shard.

At each level every child draws -ln(u) / weight, u a hash of the row's key and the child's place, and
the smallest draw wins. A child's draw depends on nothing but the key, its place and its weight, so a
changed weight moves rows only to or from that child. A new shard gets a region of its own: the draws
among the old regions stay as they are, and rows move into the new shard only.

Defined results: the key alone decides, so rows with a null key share a shard; null texts have size 1
and checksum 0; repeated rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortfall.llm.common import fraction, stored, text_or_empty

RUNS = 4096


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def planned_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Full racks of `per_rack` shards, `racks` racks a region."""
    return [
        Leaf(f"region{i // (per_rack * racks)}", f"rack{i // per_rack}", i) for i in range(shards)
    ]


def grown_tree(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    shard = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(f"added{shard}", f"added{shard}", shard, weight)]


def _winner(key: Column, places: dict[str, float]) -> Column:
    """The place with the smallest draw; equal draws go to the first name."""
    draws = [
        F.struct((-F.ln(fraction(key, F.lit(place))) / F.lit(weight)).alias("draw"), F.lit(place).alias("place"))
        for place, weight in sorted(places.items())
    ]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["place"]


def descend(key: Column, tree: list[Leaf]) -> Column:
    """Shard number of a key. A node weighs as much as the leaves below it; weight 0 gets no rows."""

    def level(leaves: list[Leaf], names: list[str], above: str) -> Column:
        if not names:
            return F.lit(leaves[0].shard)
        below: dict[str, list[Leaf]] = {}
        for leaf in leaves:
            below.setdefault(f"{above}/{getattr(leaf, names[0])}", []).append(leaf)
        if len(below) == 1:
            (place, only), = below.items()
            return level(only, names[1:], place)
        won = _winner(key, {place: sum(x.weight for x in some) for place, some in below.items()})
        choice = None
        for place, some in sorted(below.items()):
            down = level(some, names[1:], place)
            choice = F.when(won == place, down) if choice is None else choice.when(won == place, down)
        return choice

    live = [leaf for leaf in tree if leaf.weight > 0]
    if not live:
        raise ValueError("no shard has weight")
    return level(live, ["region", "rack", "shard"], "").cast("int")


def assign(
    docs: DataFrame, tree: list[Leaf], grown: list[Leaf], doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots come from counts: each shard is cut into RUNS runs by hash, runs start where the ones before
    end, and rows are numbered inside their run. Equal rows are counted before the shuffle, so a hot
    row is one row there.
    """
    body = text_or_empty(text)
    rows = (
        docs.select(
            F.col(doc).alias("doc_id"),
            (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("same"))
        .withColumn("shard", descend(F.col("doc_id"), tree))
        .withColumn("grown_shard", descend(F.col("doc_id"), grown))
        .withColumn("run", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(RUNS)))
    )
    rows = stored(rows, "shard-rows")
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # at most shards x RUNS rows
        rows.groupBy("shard", "run")
        .agg(F.sum("same").alias("in_run"))
        .select("shard", "run", F.coalesce(F.sum("in_run").over(before), F.lit(0)).alias("start"))
    )
    within = (
        Window.partitionBy("shard", "run")
        .orderBy("doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("past", F.coalesce(F.sum("same").over(within), F.lit(0)))
        .join(F.broadcast(starts), ["shard", "run"])
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("same") - 1)))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("past") + F.col("copy")).alias("slot"),
            "grown_shard",
        )
    )
