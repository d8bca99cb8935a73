"""Exact order statistics that never gather a whole column in one task.

``percentile()`` keeps every distinct value of a column in one aggregation buffer. Here a mergeable
sketch first brackets each wanted rank (one pass, a few numbers back to the driver); a second pass
counts the rows outside the brackets and groups only the values inside them by value, with map-side
combine. What is left per wanted rank is about ``6 / accuracy`` of the rows. Grouped quantiles skip the sketch and
count by value. The running count always goes cell by cell. The answer is exact, not approximate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.functions.expressions import finite
from tabsight.operators.ranking import running_totals, with_cells

ACCURACY = 20_000


def _bracket_edges(n: int, sketch: list[float] | None, k: int, accuracy: int) -> list[float]:
    """Merged brackets as a flat ascending list lo, hi, lo, hi...; a value is inside ``[lo, hi)``.

    Empty (everything is inside) while the sketch may be off by a rank or two.
    """
    if not n or 3 * n < 2 * accuracy:
        return []
    edges: list[float] = []
    for i in range(k):
        lo, hi = sketch[2 * i], math.nextafter(sketch[2 * i + 1], math.inf)
        if edges and lo <= edges[-1]:
            edges[-1] = max(edges[-1], hi)
        else:
            edges += [lo, hi]
    return edges


def ranked_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, by: Sequence[str] = (),
                  accuracy: int = ACCURACY) -> DataFrame:
    """Counts by value around the wanted ranks, with running totals.

    Returns ``by..., column, cell, value, m, upto, n``: ``m`` rows hold the value, ``upto`` rows are at
    or below it, ``n`` rows have a value at all. Rows between the brackets come as one line each with
    a NULL value. NULL, NaN and infinities are ignored.
    """
    by, probs = list(by), sorted(probs)
    k = len(probs)
    src = df.select(*by, *[finite(c).alias(f"x{j}") for j, c in enumerate(columns)])
    if by:
        # every value stays: groups may be many, and their brackets would have to travel with them
        src = src.withColumns({f"c{j}": F.lit(1) for j in range(len(columns))})
    else:
        slack = 3.0 / accuracy
        grid = [p for q in probs for p in (max(0.0, q - slack), min(1.0, q + slack))]
        row = src.agg(*[F.count(f"x{j}").alias(f"n{j}") for j in range(len(columns))],
                      *[F.percentile_approx(f"x{j}", grid, accuracy).alias(f"s{j}") for j in range(len(columns))]).first()
        for j in range(len(columns)):
            e = _bracket_edges(row[f"n{j}"], row[f"s{j}"], k, accuracy)
            cuts = [-math.inf, *e, math.inf]
            src = with_cells(src, f"x{j}", cuts, f"c{j}") if e else src.withColumn(f"c{j}", F.lit(1))

    def place(j: int, name: str) -> Column:
        """(column, cell, value): odd cells are brackets and keep the value, even ones only count."""
        x, cell = F.col(f"x{j}"), F.col(f"c{j}")
        return F.struct(F.lit(name).alias("column"), x.isNotNull().alias("present"), cell.alias("cell"),
                        F.when(cell % 2 == 1, x).alias("value"))

    counts = (src.select(*by, F.inline(F.array(*[place(j, c) for j, c in enumerate(columns)])))
              .groupBy(*by, "column", "cell", "value")
              .agg(F.sum(F.col("present").cast("bigint")).alias("m")))
    return running_totals(counts, by=[*by, "column"], value=["cell", "value"], sums={"m": "upto"}, totals={"m": "n"})


def holds(position: Column) -> Column:
    """Whether a ``ranked_values`` row covers the zero-based position."""
    return (F.col("upto") - F.col("m") <= position) & (position < F.col("upto"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], *,
                    by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Linear-interpolation quantiles of several columns in two scans.

    Returns ``by..., column, n, q`` where ``q`` is an array with one double per requested probability
    in ascending order (NULL for a column without values).
    """
    probs = sorted(probs)
    group = [*by, "column"]
    picked = ranked_values(df, columns, probs, by=by, accuracy=accuracy).groupBy(*group).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(holds(end(F.lit(float(q)) * (F.col("n") - 1))), F.col("value"))).alias(f"{name}{i}")
          for i, q in enumerate(probs) for name, end in (("a", F.floor), ("b", F.ceil))])

    def value(i: int, q: float) -> Column:
        pos = F.lit(float(q)) * (F.col("n") - 1)
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        missed = F.raise_error(F.lit("quantile rank fell outside its bracket")).cast("double")
        return F.when(F.col("n") > 0, F.coalesce(a + (b - a) * (pos - F.floor(pos)), missed))

    return picked.select(*group, "n", F.array(*[value(i, q) for i, q in enumerate(probs)]).alias("q"))


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """``exact_quantiles`` over the whole table, fetched: a few numbers per column."""
    rows = exact_quantiles(df, columns, probs, accuracy=accuracy).collect()
    found = {r["column"]: list(r["q"]) for r in rows}
    return {c: found.get(c, [None] * len(probs)) for c in columns}


def median(df: DataFrame, column: str) -> float | None:
    return quantile_values(df, [column], [0.5])[column][0]
