"""SimHash near-dedup with BK-trees.

A text's fingerprint has 64 bits; fingerprints at `RADIUS` or fewer differing bits are linked, and links
make components. Distinct fingerprints are cut into RADIUS + 1 blocks of bits: two that are linked agree
in one block, so each fingerprint goes to one shard per block, named by the block's leading bits. The
number of leading bits follows the number of fingerprints, so a shard has about `TREE_NODES` of them
at any corpus size. Each shard has a BK-tree, in which a child hangs on its parent by their distance
and a search follows only edges within the radius of its own distance. Fuller shards are cut into
several trees, and each tree goes to every part of its own shard's fingerprints. A tree is bounded, so
a cell (tree, part) is too; a tree of all fingerprints would not be, and is never made or collected.

A cell returns links that join its finds, not all pairs; components come from stored link tables.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; texts
of fewer words than a shingle are one shingle; component_id is null only if all its doc_ids are null;
repeated rows are returned each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.llm.common import by_value, slices, stored
from shortfall.llm.components import components

by_value(__name__)

SHINGLE = 3
SEED = 42
RADIUS = 2
TREE_NODES = 4096
SEARCH_ROWS = 512


# -- fingerprints ------------------------------------------------------------------------


def simhash(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a text: a bit is set if over half the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = max(1, len(words) - width + 1)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    totals = np.zeros((8, 8), np.int64)
    for start in range(0, shingles, 1 << 16):  # bounded arrays, however long the text is
        stop = min(shingles, start + (1 << 16))
        hashes = np.fromiter(
            (xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(start, stop)),
            dtype="<u8",
            count=stop - start,
        )
        by_byte = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8) << 8)
        totals += np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ bits
    return int(np.packbits((2 * totals > shingles).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [simhash(t, width, seed) for t in part.column("text").to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(signed)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        prints, "doc_id bigint, fp bigint"
    )


# -- BK-trees ----------------------------------------------------------------------------


def bk_tree(values: np.ndarray) -> np.ndarray:
    """Child of each node by distance, -1 for none. Values are distinct; node 0 is the root.

    All values descend together: of those that reach a free edge at once the first becomes the child,
    the others go on below it.
    """
    child = np.full((len(values), 65), -1, np.int32)
    flat = child.reshape(-1)
    waiting = np.arange(1, len(values))
    parent = np.zeros(len(waiting), np.int64)
    while len(waiting):
        edge = parent * 65 + np.bitwise_count(values[waiting] ^ values[parent])
        free = flat[edge] < 0
        edges, first = np.unique(edge[free], return_index=True)
        flat[edges] = waiting[free][first]
        parent = flat[edge].astype(np.int64)
        below = parent != waiting
        waiting, parent = waiting[below], parent[below]
    return child


def bk_search(
    values: np.ndarray, child: np.ndarray, queries: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) numbers within the radius, for blocks of queries."""
    reach = np.arange(-radius, radius + 1)
    for start in range(0, len(queries), SEARCH_ROWS):
        query = np.arange(start, min(len(queries), start + SEARCH_ROWS))
        node = np.zeros(len(query), np.int64)
        while len(query):
            distance = np.bitwise_count(queries[query] ^ values[node]).astype(np.int64)
            near = distance <= radius
            if near.any():
                yield query[near], node[near]
            edge = distance[:, None] + reach
            after = child[node[:, None], np.clip(edge, 0, 64)]
            on = (after >= 0) & (edge >= 0) & (edge <= 64)
            query, node = np.broadcast_to(query[:, None], on.shape)[on], after[on].astype(np.int64)


def joined(count: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least number reachable from each of `count` numbers."""
    label = np.arange(count)
    if not pairs:
        return label
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def cell_links(cell: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links that join what one tree and one part of a shard have within the radius."""
    tree = cell.loc[cell["in_tree"], "fp"].to_numpy(np.int64).view(np.uint64)
    asked = cell.loc[cell["asks"], "fp"].to_numpy(np.int64).view(np.uint64)
    if not len(tree) or not len(asked):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    same = bool((cell["in_tree"] & cell["asks"]).all())
    child = bk_tree(tree)
    shift = 0 if same else len(tree)
    pairs = [(q + shift, n) for q, n in bk_search(tree, child, asked, radius)]
    values = (tree if same else np.concatenate([tree, asked])).view(np.int64)
    label = joined(len(values), pairs)
    moved = label != np.arange(len(values))
    return pd.DataFrame({"a": values[moved], "b": values[label[moved]]})


# -- links and components ----------------------------------------------------------------


def near_links(prints: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """a, b: links whose components are those of all pairs of distinct prints within the radius."""
    blocks = radius + 1
    width = 64 // blocks
    leading = min(width, max(0, ceil(log2(max(1, prints.count() / tree_nodes)))))
    if not leading:
        blocks = 1  # one shard has them all
    names = [
        F.concat_ws(
            ":",
            F.lit(str(i)),
            F.shiftrightunsigned(F.shiftleft("fp", i * width), 64 - leading) if leading else F.lit(""),
        )
        for i in range(blocks)
    ]
    members = stored(prints.select("fp", F.explode(F.array(*names)).alias("shard")), "near-shards")
    # A shard of ordinary size is one tree; parts are as large as two such shards at most.
    parts = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (2 * tree_nodes)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    counted = members.join(parts, "shard").withColumn("own", own)
    # The tree of part i is asked by the parts i, i + 1, ...
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("tree"), F.greatest(k, F.col("own")).alias("part")),
    )
    dealt = counted.select("shard", "fp", "own", F.explode(cells).alias("cell")).select(
        "shard",
        "cell.tree",
        "cell.part",
        "fp",
        (F.col("own") == F.col("cell.tree")).alias("in_tree"),
        (F.col("own") == F.col("cell.part")).alias("asks"),
    )

    def links(cell: pd.DataFrame) -> pd.DataFrame:
        return cell_links(cell, radius)

    return dealt.groupBy("shard", "tree", "part").applyInPandas(links, "a bigint, b bigint")


def near_groups(docs: DataFrame, width: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows = stored(fingerprints(docs, width, seed), "near-prints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "near-distinct")
    roots = components(near_links(prints.select("fp"), radius), "a", "b")
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.join(
        rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root"
    ).select(F.col("fp").alias("print"), "component_id")
    return rows.join(named, F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id")
