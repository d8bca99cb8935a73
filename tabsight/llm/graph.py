"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.sources.files import discard, materialised


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn, each of which halves the depth of a tree at least; a step's edges are
    written, so lineage stays short. Loops, repeated edges and edges in both directions do no harm.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    table = materialised(edges.filter("a <> b").select(a.alias("a"), b.alias("b")).distinct())
    state = _state(table)
    while True:
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialised(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b"))
        done = materialised(small.distinct())
        discard(table, large)
        table, before, state = done, state, _state(done)
        if state == before:
            break
    return table.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
