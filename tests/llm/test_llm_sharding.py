from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from conftest import rows
from llm_cases import documents, empty, odd_documents, with_clashing
from pyspark.sql import functions as F

from shortfall.llm import sharding
from shortfall.llm.sharding import Leaf

TREE = sharding.planned_tree(16)
GROWN = sharding.grown_tree(TREE)


def test_rows_slots_and_sizes(spark):
    docs = odd_documents(spark)
    found = sharding.assign(with_clashing(docs), TREE, GROWN).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == texts
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 16
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_even_shares_and_growth(spark):
    keys = spark.range(40_000)
    found = keys.select(
        sharding.descend(F.col("id"), TREE).alias("shard"), sharding.descend(F.col("id"), GROWN).alias("grown")
    ).collect()
    sizes = Counter(r["shard"] for r in found)
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.15 * 40_000 / 16
    assert all(r["grown"] in (r["shard"], 16) for r in found)
    assert abs(sum(r["grown"] == 16 for r in found) - 40_000 / 17) < 300


def test_law_holds_again_and_again(spark):
    tree = sharding.planned_tree(3)
    for _ in range(5):
        more = sharding.grown_tree(tree)
        new = more[-1].shard
        found = spark.range(3000).select(
            sharding.descend(F.col("id"), tree).alias("a"), sharding.descend(F.col("id"), more).alias("b")
        )
        assert found.where(f"a != b and b != {new}").count() == 0
        assert found.where(f"b = {new}").count() > 0
        tree = more


def test_moves_stay_in_the_subtree_that_changed(spark):
    """Weights swapped inside a rack leave all other racks alone; weight 0 empties a shard."""
    swapped = [Leaf(x.region, x.rack, x.shard, {0: 2.0, 1: 0.0}.get(x.shard, 1.0)) for x in TREE]
    found = spark.range(20_000).select(
        sharding.descend(F.col("id"), TREE).alias("a"), sharding.descend(F.col("id"), swapped).alias("b")
    )
    moved = {(r["a"], r["b"]) for r in found.where("a != b").distinct().collect()}
    assert moved and all(a < 4 and b < 4 for a, b in moved)
    assert found.where("b = 1").count() == 0


def test_heavier_region_only_gains(spark):
    heavier = [Leaf(x.region, x.rack, x.shard, 2.0 if x.region == "region1" else 1.0) for x in TREE]
    found = spark.range(20_000).select(
        sharding.descend(F.col("id"), TREE).alias("a"), sharding.descend(F.col("id"), heavier).alias("b")
    )
    assert found.where("a != b and b < 8").count() == 0
    assert abs(found.where("b >= 8").count() / 20_000 - 2 / 3) < 0.02


def test_empty_table(spark):
    assert rows(sharding.assign(empty(spark), TREE, GROWN)) == []


def plain_shard(key, tree):
    """Each level's draws by the hash library."""
    import math

    import xxhash

    def draw(place, weight):
        seed = 42 if key is None else xxhash.xxh64_intdigest((key % 2**64).to_bytes(8, "little"), 42)
        h = xxhash.xxh64_intdigest(place.encode(), seed)
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight

    leaves, above = [x for x in tree if x.weight > 0], ""
    for name in ("region", "rack", "shard"):
        below = {}
        for leaf in leaves:
            below.setdefault(f"{above}/{getattr(leaf, name)}", []).append(leaf)
        above = min(below, key=lambda p: (draw(p, sum(x.weight for x in below[p])), p))
        leaves = below[above]
    return leaves[0].shard


def test_shards_equal_a_plain_descent(spark):
    from pyspark.sql import functions as F

    uneven = [sharding.Leaf("a", "x", 0, 2.0), sharding.Leaf("a", "y", 1), sharding.Leaf("b", "z", 2, 0.5), sharding.Leaf("b", "z", 3, 3.0), sharding.Leaf("b", "w", 4, 0.0)]
    keys = [None, 0, 1, -5, 2**62, *range(100, 500)]
    table = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for tree in (sharding.planned_tree(16), sharding.grown_tree(sharding.planned_tree(16)), uneven, uneven[:1]):
        found = {r["k"]: r["s"] for r in table.select("k", sharding.descend(F.col("k"), tree).alias("s")).collect()}
        assert found == {k: plain_shard(k, tree) for k in keys}
