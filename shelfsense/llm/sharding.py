"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Keys and the virtual nodes of the shards are hashed to a ring of cells. A key belongs to the
first virtual node at or after its cell. A shard takes keys until it is full; the rest go on
clockwise to the next node whose shard has room. With a load factor of 1 the capacities add up
to the number of rows, so counts differ by one at most; with more room, adding a shard moves
fewer keys.

Only the counts of the cells, a number fixed by the ring, decide who goes where: they are summed
before they reach the driver, walked once around the ring there, and the resulting table of
ranges (cell, ranks, shard) joins back to the rows. The walk takes rows cell by cell, so a row's
place depends on its rank within its cell only. No text is shuffled.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8_crc32

#: Cells of the ring. The count and range tables have at most about this many rows.
CELL_BITS = 14
VIRTUAL_NODES = 128
_MASK = (1 << 64) - 1


def _scatter(x: int) -> int:
    """A fixed 64-bit hash for the places of virtual nodes."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For each cell the shards of the virtual nodes in it, in ring order.

    A node's place depends on its shard and number alone: another shard moves none of them.
    """
    cells: list[list[tuple[int, int]]] = [[] for _ in range(1 << CELL_BITS)]
    for shard in range(shards):
        for node in range(virtual_nodes):
            place = _scatter(shard * 1_000_003 + node)
            cells[place >> (64 - CELL_BITS)].append((place, shard))
    return [[shard for _, shard in sorted(cell)] for cell in cells]


def capacities(rows: int, shards: int, load: float) -> list[int]:
    """Most rows of each shard; with ``load`` 1 they add up to ``rows``."""
    if load <= 1:
        return [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return [math.ceil(load * rows / shards)] * shards


def walk(counts: dict[int, int], nodes: list[list[int]], room: list[int]):
    """Ranges (cell, first rank, end rank, shard, first slot) that place every counted row.

    Rows wait in the order in which the walk meets them. At a virtual node the waiting rows
    enter its shard until it is full; those left go on to the next node.
    """
    left, taken = list(room), [0] * len(room)
    waiting: deque[tuple[int, int, int]] = deque()
    ranges = []
    for turn in range(2):
        for cell, shards in enumerate(nodes):
            if turn == 0 and counts.get(cell):
                waiting.append((cell, 0, counts[cell]))
            for shard in shards:
                while waiting and left[shard]:
                    origin, low, high = waiting.popleft()
                    n = min(high - low, left[shard])
                    ranges.append((origin, low, low + n, shard, taken[shard]))
                    left[shard] -= n
                    taken[shard] += n
                    if low + n < high:
                        waiting.appendleft((origin, low + n, high))
    return ranges


def ring_shards(
    docs: DataFrame, shards: int, load: float = 1.25, virtual_nodes: int = VIRTUAL_NODES
) -> DataFrame:
    """Shard of every row of ``docs`` (columns ``doc_id``, ``text``): one output row per row.

    ``doc_id``, ``size`` (UTF-8 bytes of the text plus 16; a null text has none), ``text_crc32``,
    ``shard``, ``slot`` (0, 1, ... without gaps in each shard). A row without id is keyed by its
    text. Within a cell, rows are ranked by hash, id and text checksum; rows equal in all of these
    take neighbouring ranks in any order. An empty table gives no rows; other columns are
    ignored.
    """
    text = F.coalesce("text", F.lit(""))
    key: Column = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    cell = F.shiftrightunsigned(key, 64 - CELL_BITS).cast("int")
    counts = {
        row["cell"]: row["n"]
        for row in docs.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    total = sum(counts.values())
    ranges = walk(counts, ring(shards, virtual_nodes), capacities(total, shards, load))
    spark = docs.sparkSession
    schema = "cell int, low bigint, high bigint, shard int, first_slot bigint"
    placed = F.broadcast(spark.createDataFrame(ranges, schema))  # bounded by cells and shards
    from pyspark.sql import Window

    order = Window.partitionBy("cell").orderBy("key", "doc_id", "text_crc32", "size")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        utf8_crc32(text).alias("text_crc32"),
        key.alias("key"),
        cell.alias("cell"),
    ).withColumn("rank", F.row_number().over(order) - 1)
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return rows.join(placed, "cell").where(inside).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("first_slot") + F.col("rank") - F.col("low")).alias("slot"),
    )
