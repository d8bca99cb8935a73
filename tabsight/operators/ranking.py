"""Running totals over a total order without a single-partition window.

Rows, one per point of the order, are dealt by ranges of (group, value) into cells of about equal size and written
once, so every stage and every retry sees the same cells. Totals per cell give each cell's starting offset; the window
then runs inside a cell only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.operators.small import joined
from tabsight.sources.files import materialised


def cell_count(df: DataFrame) -> int:
    """Cells to aim for: one per shuffle partition, at least 16."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def range_cells(df: DataFrame, order: Sequence[str], cell: str = "cell", cells: int | None = None) -> DataFrame:
    """Add a ``cell`` that is monotone along ``order``; cells hold about equally many rows.

    Give one row per point of the order: equal points share a cell. Leading group columns are part of the
    order, so a group has cells of its own range. The dealt rows are written: every later reader sees the same cells.
    """
    dealt = df.repartitionByRange(cells or cell_count(df), *order)
    return materialised(dealt.withColumn(cell, F.spark_partition_id()))


def with_cells(df: DataFrame, value: str, edges: Sequence[float], name: str = "cell") -> DataFrame:
    """Add the integer cell of ``value``; the lookup is a JVM-side binary search."""
    if len(edges) < 3:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=list(edges), inputCol="_cell_x", outputCol="_cell", handleInvalid="keep")
    # adding 0.0 turns -0.0 into 0.0: the lookup tells them apart, grouping does not
    out = cut.transform(df.withColumn("_cell_x", F.col(value).cast("double") + F.lit(0.0)))
    return out.withColumn(name, F.col("_cell").cast("int")).drop("_cell_x", "_cell")


def running_totals(df: DataFrame, *, by: Sequence[str], value: str | Sequence[str], sums: Mapping[str, str],
                   descending: bool = False, totals: Mapping[str, str] | None = None, cells: int | None = None) -> DataFrame:
    """Inclusive running sums within ``by`` along ``value``, and whole-group sums if ``totals`` names them.

    ``df`` has one row per (by, value). ``sums`` maps a summed column to the name of its running total. NULL is a
    group like any other.
    """
    by, values = list(by), [value] if isinstance(value, str) else list(value)
    placed = range_cells(df, [*by, *values], "_cell", cells)

    def ordered(c: str):
        return F.col(c).desc() if descending else F.col(c).asc()

    per_cell = placed.groupBy(*by, "_cell").agg(*[F.sum(s).alias(s) for s in sums])
    before = W.partitionBy(*by).orderBy(ordered("_cell")).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_cell.select(
        *by, "_cell", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}_0") for s in sums],
        *[F.sum(s).over(W.partitionBy(*by)).alias(t) for s, t in (totals or {}).items()])
    inside = W.partitionBy(*by, "_cell").orderBy(*[ordered(v) for v in values]).rowsBetween(W.unboundedPreceding, 0)
    out = joined(placed.withColumns({t: F.sum(s).over(inside) for s, t in sums.items()}), offsets, [*by, "_cell"])
    return (out.withColumns({t: F.col(t) + F.col(f"_{s}_0") for s, t in sums.items()})
            .drop("_cell", *[f"_{s}_0" for s in sums]))


def nearest_knots(queries: DataFrame, knots: DataFrame, by: Sequence[str], x: str = "x") -> DataFrame:
    """``by..., x, below, above`` for every distinct query: the last knot at or before it and the first at or after it.

    ``knots`` has one row per (by, x); a knot is a struct of x and its other columns, NULL where there is none. Points are
    dealt into cells by range; knots of other cells come from a table of a row per cell.
    """
    by, fields = list(by), [c for c in knots.columns if c not in by]
    knot = F.struct(x, *[c for c in fields if c != x])
    none = F.lit(None).cast(knots.select(knot.alias("k")).schema["k"].dataType)
    points = (queries.select(*by, x, F.lit(True).alias("_q"), none.alias("_knot")).unionByName(knots.select(*by, x, F.lit(False).alias("_q"), knot.alias("_knot")))
              .groupBy(*by, x).agg(F.max("_q").alias("_q"), F.max("_knot").alias("_knot")))
    cells = range_cells(points, [*by, x], "_cell")
    order = W.partitionBy(*by).orderBy("_cell")
    per_cell = cells.groupBy(*by, "_cell").agg(F.min("_knot").alias("_first"), F.max("_knot").alias("_last"))
    outer = per_cell.select(*by, "_cell", F.last("_last", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_below"),
                            F.first("_first", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_above"))
    inside = W.partitionBy(*by, "_cell")
    near = cells.withColumns({"below": F.last("_knot", True).over(inside.orderBy(x).rowsBetween(W.unboundedPreceding, 0)),
                              "above": F.last("_knot", True).over(inside.orderBy(F.col(x).desc()).rowsBetween(W.unboundedPreceding, 0))})
    near = joined(near.filter("_q"), outer, [*by, "_cell"])
    return near.select(*by, x, F.coalesce("below", "_below").alias("below"), F.coalesce("above", "_above").alias("above"))
