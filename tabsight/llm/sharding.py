"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. A row's hash names its cell, and the row belongs to the next virtual node
clockwise; once that node's shard is full, it goes on clockwise to the next node of a shard with room. The loads
of the shards are bounded so that their counts are at most one apart. Only rows beyond a full shard move.

Rows enter in the order of the ring, so the counts per cell decide everything: the driver walks the cells (their
number is fixed), and every row finds its shard and slot from its rank within its cell.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.text import id_column

CELL_BITS = 14
VIRTUAL = 256


def ring(shards: int, virtual: int = VIRTUAL, bits: int = CELL_BITS) -> list[tuple[int, int, int]]:
    """(cell, tie, shard) of all virtual nodes in clockwise order."""
    nodes = []
    for shard in range(shards):
        for v in range(virtual):
            h = int.from_bytes(hashlib.md5(f"{shard}/{v}".encode()).digest()[:8])
            nodes.append((h >> 64 - bits, h, shard))
    return sorted(nodes)


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, virtual: int = VIRTUAL, bits: int = CELL_BITS) -> list[tuple[int, int, int, int, int]]:
    """(cell, low, high, shard, slot): the cell's rows of rank low to high - 1 lie in the shard from that slot."""
    room = capacities(sum(counts.values()), shards)
    used = [0] * shards
    nodes = [x for x in ring(shards, virtual, bits) if room[x[2]]]
    out = []
    for cell in sorted(counts):
        low, n = 0, counts[cell]
        while low < n:
            shard = nodes[bisect_left(nodes, (cell,)) % len(nodes)][2]
            took = min(n - low, room[shard] - used[shard])
            out.append((cell, low, low + took, shard, used[shard]))
            used[shard] += took
            low += took
            if used[shard] == room[shard]:
                nodes = [x for x in nodes if x[2] != shard]
    return out


def assign_shards(df: DataFrame, key: str, shards: int, carry: tuple[str, ...] = (), virtual: int = VIRTUAL,
                  bits: int = CELL_BITS) -> DataFrame:
    """The key, the carried columns, shard and slot (from 0, without gaps in a shard) of every row.

    The hash covers the key and the carried columns, so rows with a null or a common key still spread over the
    ring; rows that agree in all of them are counted before they are shuffled and dealt out again behind each
    other. Other columns are not read. An empty table gives no rows.
    """
    columns = [key, *carry]
    id_column(df, key)
    h = F.xxhash64(*columns)
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    cell = F.shiftrightunsigned("__h", 64 - bits)
    groups = groups.withColumn("__h", h).withColumn("__cell", cell)
    counts = {r["__cell"]: r["n"] for r in df.select(*columns).withColumn("__h", h).groupBy(cell.alias("__cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    table = df.sparkSession.createDataFrame(walk(counts, shards, virtual, bits), "__cell long, __low long, __high long, shard int, __slot long")
    order = Window.partitionBy("__cell").orderBy("__h", *columns)
    ranked = (groups.withColumn("__first", F.sum("__n").over(order) - F.col("__n"))
              .withColumn("__rank", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1))))
    hit = (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high"))
    # at most a row per cell and shard more: 2**bits + shards
    placed = ranked.join(F.broadcast(table.withColumnRenamed("__cell", "__own")), (F.col("__cell") == F.col("__own")) & hit)
    return placed.select(*columns, "shard", (F.col("__slot") + F.col("__rank") - F.col("__low")).alias("slot"))
