"""Best-fit packing into bins of several permitted lengths.

Pieces are packed longest first. A piece goes into the open bin with the least room that holds it. If
there is none, a bin is opened of the length with the least cost per token, where a bin's expected
contents are the piece and as much of what is still to come as fits. In the end each bin shrinks to the
least permitted length that holds its contents.

Rows are dealt by hash to groups of about `GROUP_ROWS` pieces, each packed in one task: bins never span
groups, and at this size the last, partly filled bins of a group are a small share. Documents over the
largest length are cut into pieces of that length and a rest, so no word is lost.

Defined results: a document without words gets one row without a bin (bin_id, capacity and position
null); repeated rows are packed each for themselves; null keys are kept; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortfall.llm.common import by_value, stored, word_count

by_value(__name__)

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP_ROWS = 4096
GROUP_BITS = 32


def training_cost(length: int) -> float:
    """Cost of one sequence: a fixed part, a part by token, and attention by pairs of tokens."""
    return 64 + length + length * length / 16384


def best_fit(
    sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = training_cost
) -> tuple[list[int], list[int], list[int]]:
    """Bin and position of each size (given longest first), and the final length of each bin."""
    lengths = sorted(lengths)
    price = {length: cost(length) for length in lengths}
    rooms: list[int] = []  # distinct free rooms, ascending
    with_room: dict[int, list[int]] = {}
    used: list[int] = []
    bins, positions = [], []
    left = sum(sizes)
    for size in sizes:
        left -= size
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            number = with_room[room].pop()
            if not with_room[room]:
                del with_room[room]
                rooms.pop(at)
        else:
            room = min(
                (length for length in lengths if length >= size),
                key=lambda length: (price[length] / (size + min(length - size, left)), length),
            )
            number = len(used)
            used.append(0)
        bins.append(number)
        positions.append(used[number])
        used[number] += size
        room -= size
        if room:
            if room not in with_room:
                insort(rooms, room)
                with_room[room] = []
            with_room[room].append(number)
    return bins, positions, [lengths[bisect_left(lengths, n)] for n in used]


def pieces(rows: DataFrame, largest: int) -> DataFrame:
    """doc_id, size -> doc_id, piece, start, n_words, row; one row for each piece."""
    last = F.greatest(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {largest}"))
    return rows.select(
        "doc_id",
        "size",
        F.monotonically_increasing_id().alias("row"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"),
    ).select(
        "doc_id",
        "row",
        "piece",
        (F.col("piece") * largest).alias("start"),
        F.least(F.col("size") - F.col("piece") * largest, F.lit(largest)).cast("bigint").alias("n_words"),
    )


def pack(
    rows: DataFrame,
    lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = training_cost,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """doc_id, size -> doc_id, piece, start, n_words, bin_id, capacity, position."""
    cut = stored(pieces(rows, max(lengths)), "pack-pieces")
    groups = max(1, -(-cut.count() // group_rows))
    columns = ["doc_id", "piece", "start", "n_words"]

    def pack_group(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["group"].iloc[0])
        group = group.sort_values(["n_words", "row", "piece"], ascending=[False, True, True])
        bins, positions, capacities = best_fit(group["n_words"].tolist(), lengths, cost)
        return group[columns].assign(
            bin_id=[(number << GROUP_BITS) + b for b in bins],
            capacity=[capacities[b] for b in bins],
            position=positions,
        )

    packed = (
        cut.where("n_words > 0")
        .withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(
            pack_group,
            "doc_id bigint, piece bigint, start bigint, n_words bigint, bin_id bigint, capacity bigint, position bigint",
        )
    )
    empty = F.lit(None).cast("bigint")
    wordless = cut.where("n_words <= 0").select(
        *columns, empty.alias("bin_id"), empty.alias("capacity"), empty.alias("position")
    )
    return packed.unionByName(wordless)


def pack_documents(docs: DataFrame, **settings) -> DataFrame:
    """Packing by number of words."""
    return pack(docs.select("doc_id", word_count(F.col("text")).alias("size")), **settings)
