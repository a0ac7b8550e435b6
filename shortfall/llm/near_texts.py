"""SimHash near-dedup by shingle similarity: wide fingerprints in BK-trees.

For texts that share four fifths of their five-word shingles a radius of two bits is too narrow, and in
64 bits their distances mix with those of looser pairs. Here a text's distinct shingles make a fingerprint
of `BITS` bits, and pairs are sought up to a distance (`reach`) that nearly all pairs of the
least similarity keep to. A radius this wide leaves a tree of a whole corpus nothing to prune, so shards
are chosen by content: each text goes to `BANDS` shards, each named by its least shingles under
`PER_BAND` orders. Texts that share four fifths of their shingles miss each other in all shards once in
3500, at nine tenths once in a million. Shards with the same members are searched once, shards of one
member never. A shard has a BK-tree, in which a search follows only edges within the reach of its own
distance; fuller shards are cut into several trees, and every tree is sent to every part of its own shard.

A cell (tree, part) holds the shingle sets of its members, so each pair within reach that is not joined yet
is checked there on the exact sets, nearest first, and only a forest of links with the similarity leaves the
cell: fewer links than members, whatever the number of pairs. Sets travel once for each cell of a text that
has company; texts of few shingles, whose fingerprints scatter, are compared without regard to distance.

Defined results: null, empty and blank texts are equal; texts of fewer words than a shingle are one
shingle; of a group the row with the least doc_id, then the least hash of the text stays; rows without a
doc_id stay; rows that repeat the one that stays in id and text stay too; an empty table gives an empty
result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortfall.llm.common import by_value, hash_bits, light_slices, stored, text_or_empty, with_mark
from shortfall.llm.components import components
from shortfall.llm.simhash import joined

by_value(__name__)

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
BITS = 512
BANDS = 8
PER_BAND = 2
TREE_NODES = 4096
SEARCH_ROWS = 128
CELL_BYTES = 32 << 20  # of shingle sets; a shard with more is cut, as one with more members than trees hold
HELD_PAIRS = 1 << 20
CHECKED_PAIRS = 1 << 14  # pairs that are checked before joined ones are left out again
FEW_SHINGLES = 16  # up to here the distance does not count
MANY_ROWS = 256
LEADERS = 64
CHUNK = 1 << 16


def distance_at(similarity: float, spreads: float, bits: int = BITS) -> int:
    """Distance of sets of equal size with this Jaccard similarity, so many spreads from the mean."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return max(0, int(bits * share + spreads * sqrt(bits * share * (1 - share))))


def reach_of(similarity: float) -> int:
    """Pairs of the similarity keep to this distance, but for one in ten thousand or so."""
    return distance_at(similarity, 4.0)


# -- fingerprints and shard names --------------------------------------------------------


def constants(count: int, seed: int) -> np.ndarray:
    """Odd multipliers, the same in every task."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1 << 62, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(hashes: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    """The hashes under another hash function."""
    x = (hashes ^ (hashes >> np.uint64(29))) * multiplier
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """Distinct hashes of the shingles of a whole text, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    count = max(1, len(words) - width + 1)
    return np.unique(
        np.fromiter((xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(count)), np.uint64, count)
    )


def wide_print(hashes: np.ndarray, multipliers: np.ndarray) -> bytes:
    """A bit for each bit of each mixed hash: 1 if set in over half the hashes."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    offsets = np.arange(8) << 8
    found = []
    for multiplier in multipliers:
        totals = np.zeros((8, 8), np.int64)
        for start in range(0, len(hashes), CHUNK):
            by_byte = mixed(hashes[start : start + CHUNK], multiplier).view(np.uint8).reshape(-1, 8) + offsets
            totals += np.bincount(by_byte.ravel(), minlength=2048).reshape(8, 256) @ bits
        found.append(np.packbits((2 * totals > len(hashes)).ravel(), bitorder="little"))
    return b"".join(x.tobytes() for x in found)


def shard_names(hashes: np.ndarray, multipliers: np.ndarray, bands: int) -> list[int]:
    """The least hashes under several orders, joined by band into signed numbers."""
    if not len(hashes):
        return list(range(bands))
    least = np.array([mixed(hashes, m).min() for m in multipliers], np.uint64).reshape(bands, -1)
    names = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.T:
        names = mixed(names ^ column, multipliers[0])
    return names.view(np.int64).tolist()


def prints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, print, shards and number of shingles of every row."""
    schema = "doc_id bigint, text_key bigint, print binary, shards array<bigint>, shingles bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = constants(BITS // 64, seed)
        by_order = constants(BANDS * PER_BAND, seed + 1)
        for part in light_slices(batches, "text"):
            hashes = [shingle_hashes(t, width, seed) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array([wide_print(h, by_word) for h in hashes], pa.binary()),
                    pa.array([shard_names(h, by_order, BANDS) for h in hashes], pa.list_(pa.int64())),
                    pa.array([len(h) for h in hashes], pa.int64()),
                ],
                ["doc_id", "text_key", "print", "shards", "shingles"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key("text").alias("text_key"), "text").mapInArrow(run, schema)


def text_key(text: str) -> Column:
    return F.xxhash64(text_or_empty(text))


# -- BK-trees of wide fingerprints -------------------------------------------------------


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Tree:
    """BK-tree of distinct fingerprints, node 0 the root. Edges are sorted by parent and distance, so a
    search takes the children within reach as one run."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.span = values.shape[1] * 64 + 1
        edges = np.zeros(len(values), np.int64)  # by node: parent and distance as one number
        waiting = np.arange(1, len(values))
        parent = np.zeros(len(waiting), np.int64)
        taken, child = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(waiting):
            # All values descend together; of those at a free edge the first becomes the child.
            edge = parent * self.span + distances(values[waiting], values[parent])
            at = np.searchsorted(taken, edge)
            free = np.ones(len(edge), bool)
            free[at < len(taken)] = taken[at[at < len(taken)]] != edge[at < len(taken)]
            new, first = np.unique(edge[free], return_index=True)
            edges[waiting[free][first]] = new
            taken, child = np.concatenate([taken, new]), np.concatenate([child, waiting[free][first]])
            order = np.argsort(taken)
            taken, child = taken[order], child[order]
            parent = child[np.searchsorted(taken, edge)]
            below = parent != waiting
            waiting, parent = waiting[below], parent[below]
        self.edges, self.child = taken, child

    def search(self, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, node and distance of what is within reach, for a block of queries at a time."""
        for start in range(0, len(queries), SEARCH_ROWS):
            query = np.arange(start, min(len(queries), start + SEARCH_ROWS))
            node = np.zeros(len(query), np.int64)
            while len(query):
                distance = distances(queries[query], self.values[node])
                near = distance <= reach
                if near.any():
                    yield query[near], node[near], distance[near]
                base = node * self.span
                low = np.searchsorted(self.edges, base + np.maximum(distance - reach, 0))
                high = np.searchsorted(self.edges, base + np.minimum(distance + reach, self.span - 1), side="right")
                count = high - low
                run = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                query, node = np.repeat(query, count), self.child[np.repeat(low, count) + run]


def forest(count: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Numbers of the links that join what all links join, nearest first."""
    order = np.lexsort((b, a, far))
    a, b = a[order], b[order]
    label, chosen = np.arange(count), []
    rank = np.arange(len(a))
    while len(rank):
        x, y = label[a[rank]], label[b[rank]]
        apart = x != y
        rank, x, y = rank[apart], x[apart], y[apart]
        if not len(rank):
            break
        best = np.full(count, len(a))  # each tree takes its nearest link
        np.minimum.at(best, x, rank)
        np.minimum.at(best, y, rank)
        took = np.unique(best[best < len(a)])
        chosen.append(took)
        label = joined(count, [(label[a[took]], label[b[took]])])[label]
    return order[np.concatenate(chosen)] if chosen else order[:0]


class Cell:
    """Distinct fingerprints of a cell with their shingle sets, and the clusters found so far."""

    def __init__(self, prints: list[bytes], sets: list[bytes], similarity: float):
        self.values = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
        hashes = [np.frombuffer(x, np.uint64) for x in sets]
        self.sizes = np.array([len(h) for h in hashes])
        distinct, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
        self.members = np.split(numbers.ravel(), np.cumsum(self.sizes)[:-1])  # a set as numbers of the cell
        self.marked = np.zeros(len(distinct), np.int64)
        self.similarity = similarity
        self.label = np.arange(len(prints))
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def alike(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others have the similarity to one."""
        low, high = np.minimum(self.sizes[one], self.sizes[others]), np.maximum(self.sizes[one], self.sizes[others])
        found = (low >= self.similarity * high) & (low > 0)
        asked = others[found]
        if len(asked):
            starts = np.cumsum(self.sizes[asked]) - self.sizes[asked]
            self.marked[self.members[one]] = 1
            both = np.add.reduceat(self.marked[np.concatenate([self.members[i] for i in asked])], starts)
            self.marked[self.members[one]] = 0
            found[found] = both >= self.similarity * (self.sizes[one] + self.sizes[asked] - both)
        return found

    def join(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        """Joins clusters by links, of which a forest is kept."""
        took = forest(len(self.label), self.label[a], self.label[b], far)
        if len(took):
            self.links.append((a[took], b[took]))
            self.label = joined(len(self.label), [(self.label[a[took]], self.label[b[took]])])[self.label]

    def check(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        """Checks pairs, nearest first, and joins by those that have the similarity."""
        order = np.lexsort((b, a, far))
        for start in range(0, len(order), CHECKED_PAIRS):
            part = order[start : start + CHECKED_PAIRS]
            part = part[self.label[a[part]] != self.label[b[part]]]
            part = part[np.argsort(a[part], kind="stable")]
            ones, firsts = np.unique(a[part], return_index=True)
            good = [run[self.alike(one, b[run])] for one, run in zip(ones, np.split(part, firsts[1:]), strict=True)] if len(part) else []
            if good:
                took = np.concatenate(good)
                self.join(a[took], b[took], far[took])

    def follow_leaders(self, reach: int) -> None:
        """Clusters around a few fingerprints. One pass for each leader, always outside the largest cluster, so
        that a large group of copies needs no pairs."""
        for turn in range(LEADERS):
            outside = np.flatnonzero(self.label != np.bincount(self.label).argmax())
            if not len(outside):
                break
            leader = outside[turn * 7919 % len(outside)]
            distance = distances(self.values, self.values[leader][None, :])
            near = np.flatnonzero((distance <= reach) & (self.label != self.label[leader]))
            near = near[self.alike(leader, near)]
            self.join(np.full(len(near), leader), near, distance[near])

    def compare_short(self) -> None:
        """Pairs of texts of few shingles."""
        short = np.flatnonzero(self.sizes <= FEW_SHINGLES)
        for at, one in enumerate(short[:-1]):
            others = short[at + 1 :]
            others = others[self.label[others] != self.label[one]]
            others = others[self.alike(one, others)]
            if len(others):
                self.join(np.full(len(others), one), others, np.zeros(len(others), np.int64))


def cell_links(rows: pd.DataFrame, reach: int, similarity: float) -> tuple[list[bytes], list[bytes]]:
    """A forest of the links between what one tree and one part of a shard hold.

    In a cell with many rows those of the largest cluster are joined already; the tree is of the others, and
    all rows ask it.
    """
    rows = rows.drop_duplicates("print")
    if len(rows) < 2:
        return [], []
    cell = Cell(rows["print"].tolist(), rows["hashes"].tolist(), similarity)
    nodes, askers = np.flatnonzero(rows["in_tree"].to_numpy(bool)), np.flatnonzero(rows["asks"].to_numpy(bool))
    if len(rows) >= MANY_ROWS:
        cell.follow_leaders(reach)
        nodes, askers = np.flatnonzero(cell.label != np.bincount(cell.label).argmax()), np.arange(len(rows))
    cell.compare_short()
    held, waiting = 0, []
    if len(nodes) and len(askers):
        for query, node, distance in Tree(cell.values[nodes]).search(cell.values[askers], reach):
            x, y = askers[query], nodes[node]
            apart = cell.label[x] != cell.label[y]
            waiting.append((np.minimum(x, y)[apart], np.maximum(x, y)[apart], distance[apart]))
            held += len(waiting[-1][0])
            if held > HELD_PAIRS:
                cell.check(*map(np.concatenate, zip(*waiting, strict=True)))
                held, waiting = 0, []
    if waiting:
        a, b, far = map(np.concatenate, zip(*waiting, strict=True))
        once = np.unique(a * len(rows) + b, return_index=True)[1]  # found from both ends
        cell.check(a[once], b[once], far[once])
    names = rows["print"].tolist()
    return [names[i] for a, _ in cell.links for i in a], [names[i] for _, b in cell.links for i in b]


# -- links and groups --------------------------------------------------------------------


def dealt_cells(rows: DataFrame, tree_nodes: int = TREE_NODES) -> DataFrame:
    """print, cells (pack, shard, tree, part, in_tree, asks): where distinct prints of a shard meet."""
    members = stored(
        rows.select("print", "shingles", F.explode("shards").alias("shard"))
        .groupBy("shard", "print")
        .agg(F.max("shingles").alias("shingles"))
        .withColumn("node", F.xxhash64("print")),
        "near-members",
    )
    # Shards with the same members are one: of those with equal counts and sums, the least name stays.
    mark = F.sum(F.xxhash64("node").cast("decimal(38, 0)")).alias("mark")
    size = F.sum(8 * F.col("shingles") + 64)
    full = (
        members.groupBy("shard")
        .agg(F.count(F.lit(1)).alias("n"), mark, F.min("node").alias("least"), size.alias("bytes"))
        .where("n > 1")
        .groupBy("n", "mark", "least", "bytes")
        .agg(F.min("shard").alias("shard"))
        .select(
            "shard", F.ceil(F.greatest(F.col("n") / (2 * tree_nodes), F.col("bytes") / CELL_BYTES)).cast("int").alias("parts")
        )
    )
    full = stored(full, "near-shards")
    searched = stored(members.join(full, "shard"), "near-searched")
    count, total = searched.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    packs = max(1, -(-count // tree_nodes), -(-total // CELL_BYTES))
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("tree"), F.greatest(k, F.col("own")).alias("part")),
    )
    # Small shards share a task; a cell of a full shard is dealt by itself.
    pack = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("shard"), F.lit(packs))).otherwise(
        F.xxhash64("shard", "cell.tree", "cell.part")
    )
    return (
        searched.withColumn("own", own)
        .select("shard", "print", "own", "parts", F.explode(cells).alias("cell"))
        .select(
            "print",
            F.struct(
                pack.alias("pack"),
                "shard",
                "cell.tree",
                "cell.part",
                (F.col("own") == F.col("cell.tree")).alias("in_tree"),
                (F.col("own") == F.col("cell.part")).alias("asks"),
            ).alias("cell"),
        )
        .groupBy("print")
        .agg(F.collect_list("cell").alias("cells"))
    )


def with_sets(docs: DataFrame, wanted: DataFrame, width: int, seed: int) -> DataFrame:
    """pack, shard, tree, part, in_tree, asks, print, hashes: the wanted texts' shingles in their cells.

    `wanted` names one row for each print by doc_id and text_key. Texts that are certainly not wanted stay where
    they are; the others meet their names in a shuffle.
    """
    kept = "print binary, cells " + wanted.schema["cells"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in light_slices(batches, "text"):
            sets = [shingle_hashes(t, width, seed).tobytes() for t in part.column("text").to_pylist()]
            columns = [part.column("print"), part.column("cells"), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["print", "cells", "hashes"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key("text").alias("text_key"), "text")
    likely = with_mark(texts, hash_bits(wanted, "doc_id", "text_key"), "doc_id", "text_key").where("marked")
    found = likely.join(wanted.hint("shuffle_hash"), ["doc_id", "text_key"]).select("print", "cells", "text")
    return (
        found.mapInArrow(run, f"{kept}, hashes binary")
        .select("print", "hashes", F.explode("cells").alias("cell"))
        .select("cell.*", "print", "hashes")
    )


def near_links(cells: DataFrame, reach: int, similarity: float) -> DataFrame:
    """a, b: links of all cells, each with the similarity."""

    def links(pack: pd.DataFrame) -> pd.DataFrame:
        found = [cell_links(cell, reach, similarity) for _, cell in pack.groupby(["shard", "tree", "part"], sort=False)]
        return pd.DataFrame({side: pd.Series([x for f in found for x in f[k]], dtype=object) for k, side in enumerate("ab")})

    found = cells.groupBy("pack").applyInPandas(links, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def dropped_rows(
    docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, seed: int = SEED, tree_nodes: int = TREE_NODES
) -> DataFrame:
    """doc_id, text_key of the rows that another one of their group stands for."""
    rows = stored(prints(docs.select("doc_id", "text").where("doc_id is not null"), width, seed), "near-prints")
    first = F.struct("doc_id", "text_key")
    known = stored(rows.groupBy("print").agg(F.min(first).alias("first")), "near-known")
    wanted = stored(
        dealt_cells(rows, tree_nodes).join(known, "print").select("first.doc_id", "first.text_key", "print", "cells"),
        "near-wanted",
    )
    cells = with_sets(docs, wanted, width, seed)
    roots = components(near_links(cells, reach_of(similarity), similarity), "a", "b")
    rooted = known.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    rooted = stored(rooted, "near-rooted")
    best = stored(rooted.groupBy("root").agg(F.min("first").alias("best")), "near-best")
    named = stored(rooted.join(best, "root").select("print", "best"), "near-named")
    return (
        rows.join(named, "print")
        .where((F.col("doc_id") != F.col("best.doc_id")) | (F.col("text_key") != F.col("best.text_key")))
        .select("doc_id", "text_key")
        .distinct()
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One row of each group of near texts, all columns."""
    dropped = stored(dropped_rows(docs, **settings), "near-dropped")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_key("text").alias("text_key"),
    )
    # Rows that certainly stay go past the join; only the texts of the others are shuffled.
    marked = with_mark(rows, hash_bits(dropped, "doc_id", "text_key"), "doc_id", "text_key")
    stay = marked.where(~F.col("marked")).select("whole.*")
    open_rows = marked.where("marked").join(dropped.hint("shuffle_hash"), ["doc_id", "text_key"], "left_anti")
    return stay.unionByName(open_rows.select("whole.*"))
