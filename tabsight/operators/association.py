"""How features relate to each other and to a binary target, and which of them to keep."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.functions.expressions import finite, hash32, melt
from tabsight.operators import forest
from tabsight.operators import metrics as M
from tabsight.operators.cleaning import impute_median, incomplete_columns
from tabsight.operators.quantiles import holds, quantile_values, ranked_values
from tabsight.operators.ranking import nearest_knots, range_cells, running_totals, with_cells
from tabsight.operators.small import SMALL_ROWS, fetch_bounded, joined, moments, small_side
from tabsight.sources.files import materialised

LONG_KEY = ["column"]


def _pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All ordered pairs of ``columns`` with their correlation over rows where both are present.

    Complete columns go through Spark ML's one-pass Gram matrix, others through a masked one.
    """
    stats = moments(df, columns)
    rows = max(m["n"] for m in stats.values())
    if rows and all(m["n"] == rows for m in stats.values()) and not incomplete_columns(df, columns):
        # scaled first, so that large means cost no precision
        scaled = df.select(*[((finite(c) - stats[c]["mean"]) / (stats[c]["std"] or 1.0)).alias(f"x{i}")
                             for i, c in enumerate(columns)])
        vec = VectorAssembler(inputCols=scaled.columns, outputCol="v").transform(scaled)
        r = Correlation.corr(vec, "v").first()[0].toArray()
        data = [(a, b, 1.0 if a == b else None if math.isnan(r[i, j]) else float(r[i, j]))
                for i, a in enumerate(columns) for j, b in enumerate(columns)]
        return df.sparkSession.createDataFrame(data, "a string, b string, r double")
    return _masked_pairs(df, columns, stats)


def _masked_pairs(df: DataFrame, columns: Sequence[str], stats: dict) -> DataFrame:
    """Pairwise-complete correlations from one Gram matrix of values, squares and presence flags.

    The products of a pair's values and flags are all its moments, so a task hands on a number per pair of columns and
    moment, however many rows it has.
    """
    scaled = df.select(*[((finite(c) - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std"] or 1.0)).alias(f"x{i}") for i, c in enumerate(columns)])
    p = len(columns)
    i, j = np.divmod(np.arange(p * p), p)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3 * p, 3 * p))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = np.isfinite(x)
            x = np.where(there, x, 0.0)
            z = np.concatenate([x, x * x, there])
            total += z @ z.T
        xs, squares, flags = total[:p], total[p: 2 * p], total[2 * p:]
        moments_ = (flags[:, 2 * p:], xs[:, 2 * p:], flags[:, :p], squares[:, 2 * p:], flags[:, p: 2 * p], xs[:, :p])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(m.ravel()) for m in moments_)], ["i", "j", *names])

    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    sums = scaled.mapInArrow(gram, "i long, j long, " + ", ".join(f"{c} double" for c in names)).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in names)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    r = F.when((vx > 1e-9 * n * n) & (vy > 1e-9 * n * n), (n * sxy - sx * sy) / F.sqrt(vx * vy))
    label = F.array(*[F.lit(c) for c in columns])
    return sums.select(F.get(label, F.col("i").cast("int")).alias("a"), F.get(label, F.col("j").cast("int")).alias("b"),
                       F.when(F.col("i") == F.col("j"), 1.0).otherwise(r).alias("r"))


def corr_pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form over pairwise-complete rows."""
    return _pairs(df, columns)


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, rank``: average rank per distinct value of every column."""
    long = melt(df, [], columns).withColumn("value", finite("value")).filter(F.col("value").isNotNull())
    counts = long.groupBy("column", (F.col("value") + F.lit(0.0)).alias("value")).agg(F.count("*").alias("m"))
    ranked = running_totals(counts, by=LONG_KEY, value="value", sums={"m": "upto"})
    return ranked.select("column", "value", (F.col("upto") - (F.col("m") - 1) / 2.0).alias("rank"))


def rank_transform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per row of ``df``, in any order, with every value replaced by its average rank; NULL stays NULL.

    Columns of few distinct values look theirs up in a broadcast table of checked size. A single other one meets its ranks
    in one join of the rows, in which NULLs do not travel. Several go together: their (row, column, value) cells meet the
    ranks in one join and one shuffle puts the rows together again.
    """
    columns = list(columns)
    ranks = materialised(average_ranks(df, columns))
    distinct = {r["column"]: r["n"] for r in fetch_bounded(ranks.groupBy("column").agg(F.count("*").alias("n")), len(columns))}
    many = [c for c in columns if distinct.get(c, 0) > SMALL_ROWS]
    few = [c for c in columns if c not in many]
    name = {c: f"_x{i}" for i, c in enumerate(columns)}
    out = df.select(*[finite(c).alias(name[c]) for c in columns])
    for c in few:
        lookup = ranks.filter(F.col("column") == c).select(F.col("value").alias(name[c]), F.col("rank").alias("_rank"))
        out = out.join(F.broadcast(lookup), name[c], "left").drop(name[c]).withColumnRenamed("_rank", name[c])
    if len(many) == 1:
        x = name[many[0]]
        lookup = ranks.filter(F.col("column") == many[0]).select(F.col("value").alias(x), F.col("rank").alias("_rank"))
        met = out.filter(F.col(x).isNotNull()).join(lookup, x).drop(x).withColumnRenamed("_rank", x)
        out = met.unionByName(out.filter(F.col(x).isNull()))
    elif many:
        rows = materialised(out.withColumn("_row", F.monotonically_increasing_id()))  # written, so that a row keeps its number
        cells = (melt(rows, ["_row"], [name[c] for c in many]).filter("value IS NOT NULL")
                 .join(ranks.select(F.element_at(F.create_map(*[F.lit(x) for c in many for x in (c, name[c])]), F.col("column")).alias("column"),
                                    "value", "rank").filter("column IS NOT NULL"), ["column", "value"])
                 .select("_row", "column", "rank", *[F.lit(None).cast("double").alias(name[c]) for c in few]))
        looked_up = rows.select("_row", F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("rank"), *[name[c] for c in few])
        out = cells.unionByName(looked_up).groupBy("_row").agg(
            *[F.max(name[c]).alias(name[c]) for c in few],
            *[F.max(F.when(F.col("column") == name[c], F.col("rank"))).alias(name[c]) for c in many])
    return out.select(*[F.col(name[c]).alias(c) for c in columns])


def corr_spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute rank correlation in long form."""
    ranked = materialised(rank_transform(df, columns))
    return _pairs(ranked, columns).withColumn("r", F.abs("r"))


def corr_edges(df: DataFrame, columns: Sequence[str], threshold: float = 0.3) -> DataFrame:
    """Edges between columns whose absolute correlation exceeds the threshold, each pair once."""
    order = F.array(*[F.lit(c) for c in columns])
    return (corr_pearson(df, columns)
            .filter((F.array_position(order, F.col("a")) < F.array_position(order, F.col("b")))
                    & (F.abs("r") > threshold)))


def distinct_levels(df: DataFrame, columns: Sequence[str], at_most: int) -> dict[str, int | None]:
    """Exact distinct count of columns with few values, None for the others.

    A sketch rules out the clearly wide columns; only narrow ones are counted exactly.
    """
    rough = df.agg(*[F.approx_count_distinct(finite(c)).alias(c) for c in columns]).first().asDict()
    narrow = [c for c in columns if rough[c] <= 4 * at_most]
    out: dict[str, int | None] = {c: None for c in columns}
    if narrow:
        exact = (melt(df, [], narrow).filter(F.col("value").isNotNull()).groupBy("column", "value").count()
                 .groupBy("column").count())
        for r in fetch_bounded(exact, len(narrow)):
            out[r["column"]] = r["count"] if r["count"] <= at_most else None
    return out


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 16) -> DataFrame:
    """Plug-in estimate of I(column; target) in nats.

    Columns with at most ``bins`` values are used as they are, others are cut at their exact
    ``1/bins`` quantiles (right-closed). Values differ from a nearest-neighbour estimate by design.
    """
    filled = impute_median(df.select(*columns, target), columns)
    levels = distinct_levels(filled, columns, bins)
    wide = [c for c in columns if levels[c] is None]
    cuts = quantile_values(filled, wide, [i / bins for i in range(1, bins)]) if wide else {}

    binned = filled.select(F.col(target).alias("y"), *columns)
    for c, v in cuts.items():
        edges = sorted({math.nextafter(x, math.inf) for x in v if x is not None})
        binned = with_cells(binned, c, [-math.inf, *edges, math.inf], f"_b_{c}")
    cells = binned.select("y", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}" if c in cuts else c).cast("double").alias("bin"))
        for c in columns])))
    joint = cells.groupBy("column", "bin", "y").agg(F.count("*").alias("m"))
    # at most bins+1 rows per column and class from here on
    px = joint.groupBy("column", "bin").agg(F.sum("m").alias("mx"))
    py = joint.groupBy("column", "y").agg(F.sum("m").alias("my"))
    n = joint.groupBy("column").agg(F.sum("m").alias("n"))
    m, mx, my, total = (F.col(k).cast("double") for k in ("m", "mx", "my", "n"))
    return (joint.join(px, ["column", "bin"]).join(py, ["column", "y"]).join(n, "column")
            .groupBy("column").agg(F.sum(m / total * F.log(m * total / (mx * my))).alias("mutual_info")))


#: A neighbour counts as inside a radius up to this share of it, which is what "closer than" means among rounded sums.
INSIDE = 1 - 1e-9


def digamma(x: Column) -> Column:
    """Of positive numbers, to about 1e-9: an asymptotic series six steps up, and the recurrence back."""
    z, back = x + 6.0, F.lit(0.0)
    for i in range(6):
        back = back + 1.0 / (x + float(i))
    q = 1.0 / (z * z)
    return F.log(z) - 0.5 / z - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240))) - back


def neighbour_distances(counts: DataFrame, by: Sequence[str], k: int, value: str = "value", m: str = "m", cells: int | None = None) -> DataFrame:
    """``by..., value, m, d``: distance to the ``k``-th nearest other row of the group, for each distinct value.

    ``counts`` has the rows ``m`` per (by, value); groups have two rows at least, and ``k`` is at most their number less
    one. Values are dealt into cells by range. The nearest rows of a value are among the ``k`` values on either side, so
    a cell needs no more than that from its neighbours.
    """
    placed = range_cells(counts.select(*by, value, m), [*by, value], "_cell", cells)
    ranked = placed.withColumns({"_up": F.row_number().over(W.partitionBy(*by, "_cell").orderBy(value)),
                                 "_down": F.row_number().over(W.partitionBy(*by, "_cell").orderBy(F.col(value).desc()))})
    ends = ranked.groupBy(*by, "_cell").agg(F.array_sort(F.collect_list(F.when(F.col("_up") <= k, F.struct(value, m)))).alias("_head"),
                                            F.array_sort(F.collect_list(F.when(F.col("_down") <= k, F.struct(value, m)))).alias("_tail"))
    order = W.partitionBy(*by).orderBy("_cell")  # a row per cell; each has a value at least, so k cells are enough
    before = F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("_tail").over(order.rowsBetween(-k, -1))))), 1, k)
    after = F.slice(F.array_sort(F.flatten(F.collect_list("_head").over(order.rowsBetween(1, k)))), 1, k)
    halo = ends.select(*by, "_cell", before.alias("_b"), after.alias("_a")).select(*by, "_cell", F.explode(F.concat("_b", "_a")).alias("_e")).select(
        *by, F.col(f"_e.{value}").alias(value), F.col(f"_e.{m}").alias(m), "_cell", F.lit(False).alias("_own"))

    def distances(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(value)
        v, n = rows[value].to_numpy(float), rows[m].to_numpy(np.int64)
        at = np.arange(len(v))[:, None] + np.arange(-k, k + 1)
        inside = (at >= 0) & (at < len(v))
        at = np.clip(at, 0, len(v) - 1)
        gap = np.where(inside, np.abs(v[at] - v[:, None]), np.inf)
        near = np.where(inside, n[at], 0)
        near[:, k] -= 1  # the row itself
        by_gap = np.argsort(gap, axis=1, kind="stable")
        enough = np.cumsum(np.take_along_axis(near, by_gap, 1), axis=1) >= k
        rows = rows.assign(d=np.take_along_axis(gap, by_gap, 1)[np.arange(len(v)), enough.argmax(1)])
        return rows[rows["_own"]][[*by, value, m, "d"]]

    types = [f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in (*by, value, m)]
    return placed.withColumn("_own", F.lit(True)).unionByName(halo).groupBy(*by, "_cell").applyInPandas(distances, ", ".join([*types, "d double"]))


def mutual_information_knn(df: DataFrame, columns: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """Nearest-neighbour estimate of I(column; target) in nats for a discrete target, not below 0.

    For every row: the distance to its ``k``-th neighbour in its class, and the rows of all classes closer than that (or
    at the same value, where that distance is 0). Rows of equal value and class count as one with a multiplicity. Missing
    values are filled with the median; classes of a single row are left out.
    """
    long = melt(impute_median(df.select(*columns, target), columns), [target], columns)
    counts = materialised(long.withColumn("value", finite("value")).filter("value IS NOT NULL").groupBy("column", F.col(target).cast("double").alias("y"), "value")
                          .agg(F.count("*").alias("m")))
    sizes = counts.groupBy("column", "y").agg(F.sum("m").alias("size")).filter("size > 1")
    counts = materialised(joined(counts, small_side(sizes), ["column", "y"]))
    parts = [neighbour_distances(counts.filter(F.col("size") > k), ["column", "y"], k)]
    for fewer in range(1, k):  # classes with too few rows have as many neighbours as there are
        few = counts.filter(F.col("size") == fewer + 1)
        if few.limit(1).count():
            parts.append(neighbour_distances(few, ["column", "y"], fewer))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = materialised(rows.withColumns({"low": F.col("value") - F.col("d") * INSIDE, "high": F.col("value") + F.col("d") * INSIDE}))
    upto = running_totals(counts.groupBy("column", "value").agg(F.sum("m").alias("m")), by=LONG_KEY, value="value", sums={"m": "upto"})
    knots = materialised(upto.select("column", F.col("value").alias("x"), "upto", "m"))
    ends = rows.select("column", F.explode(F.array("low", "high")).alias("x"))
    found = materialised(nearest_knots(ends, knots, LONG_KEY))
    until = found.select("column", F.col("x").alias("high"), F.coalesce("below.upto", F.lit(0)).alias("until"))
    under = found.select("column", F.col("x").alias("low"), F.coalesce(F.when(F.col("below.x") == F.col("x"), F.col("below.upto") - F.col("below.m"))
                                                                     .otherwise(F.col("below.upto")), F.lit(0)).alias("under"))
    met = rows.join(until, ["column", "high"]).join(under, ["column", "low"])
    near = met.groupBy("column").agg(F.sum(F.col("m") * digamma((F.col("until") - F.col("under")).cast("double"))).alias("near"))
    size = F.col("size").cast("double")
    classes = sizes.groupBy("column").agg(F.sum("size").cast("double").alias("n"), F.sum(size * digamma(size)).alias("own"),
                                          F.sum(size * digamma(F.least(size - 1.0, F.lit(float(k))))).alias("k"))
    return near.join(classes, "column").select("column", F.greatest(
        digamma(F.col("n")) + (F.col("k") - F.col("own") - F.col("near")) / F.col("n"), F.lit(0.0)).alias("mutual_info"))


def _feature_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    long = melt(df, [target], columns).filter(F.col("value").isNotNull())
    return M.score_counts(long, by=LONG_KEY, y=target, p="value")


def univariate_auc(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """ROC-AUC of every column as a score; NULL for a constant column."""
    return M.ranking_metrics(_feature_scores(df, columns, target), LONG_KEY).select(
        "column", F.when(F.col("distinct") > 1, F.col("roc_auc")).alias("auc"), "distinct")


def feature_audit(df: DataFrame, columns: Sequence[str], target: str, drop: Sequence[str] = (),
                  near_constant_share: float = 0.001) -> DataFrame:
    """Variance, distinct count, binary and constant flags, association with the target, selection."""
    filled = impute_median(df.select(*columns, target), columns)
    cells = [F.struct(F.lit(c).alias("column"), F.var_samp(finite(c)).alias("variance"),
                      F.bool_and(F.coalesce(finite(c).isin(0.0, 1.0), F.lit(True))).alias("is_binary"),
                      F.count("*").alias("rows")) for c in columns]
    stats = df.agg(F.array(*cells).alias("a")).select(F.inline("a"))
    limit = F.greatest(F.lit(2), F.floor(F.col("rows") * near_constant_share))
    out = (stats.join(univariate_auc(filled, columns, target), "column")
           .join(mutual_information(df, columns, target), "column"))
    return out.select(
        "column", "mutual_info", "auc", "variance", "is_binary", "distinct",
        (F.col("distinct") <= 1).alias("constant"), (F.col("distinct") <= limit).alias("near_constant"),
        (~(F.col("distinct") <= limit) & ~F.col("column").isin(list(drop))).alias("selected"))


def redundant_features(df: DataFrame, columns: Sequence[str], target: str, threshold: float = 0.92) -> DataFrame:
    """Features a greedy pass over strongly rank-correlated pairs would drop.

    The p x p matrix and two numbers per column come to the driver; the data work is above.
    """
    pairs = fetch_bounded(corr_spearman(df, columns), len(columns) ** 2)
    info = {r["column"]: r["mutual_info"] for r in mutual_information(df, columns, target).collect()}
    spread = df.agg(*[F.var_samp(finite(c)).alias(c) for c in columns]).first().asDict()
    place = {c: i for i, c in enumerate(columns)}
    strong = sorted((p for p in pairs if place[p["a"]] < place[p["b"]] and p["r"] is not None and p["r"] > threshold),
                    key=lambda p: (-p["r"], place[p["a"]], place[p["b"]]))
    gone: dict[str, tuple[str, float]] = {}
    for p in strong:
        a, b = p["a"], p["b"]
        if a in gone or b in gone:
            continue
        known = info.get(a) is not None and info.get(b) is not None
        better = info if known else spread
        loser, winner = (b, a) if (better.get(a) or 0.0) >= (better.get(b) or 0.0) else (a, b)
        gone[loser] = (winner, float(p["r"]))
    return df.sparkSession.createDataFrame([(c, w, r) for c, (w, r) in gone.items()],
                                           "dropped string, kept string, r double")


def prune_correlated(df: DataFrame, columns: Sequence[str], target: str, threshold: float = 0.9,
                     drop_first: Sequence[str] = (), info: DataFrame | None = None) -> DataFrame:
    """One column per strongly correlated pair to drop: a listed one first, else the less informative.

    ``info`` (column, mutual_info) decides when given, otherwise |correlation with the target|.
    """
    matrix = corr_pearson(df, [*columns, target])
    worth = (info.select(F.col("column").alias("c"), F.col("mutual_info").alias("v")) if info is not None else
             matrix.filter(F.col("b") == target).select(F.col("a").alias("c"), F.abs("r").alias("v")))
    order = F.array(*[F.lit(c) for c in columns])
    first = [F.lit(c) for c in drop_first] or [F.lit("")]
    pairs = matrix.filter((F.array_position(order, F.col("a")) > 0)
                          & (F.array_position(order, F.col("a")) < F.array_position(order, F.col("b")))
                          & (F.abs("r") > threshold))
    both = (pairs.join(worth.select(F.col("c").alias("a"), F.col("v").alias("va")), "a", "left")
            .join(worth.select(F.col("c").alias("b"), F.col("v").alias("vb")), "b", "left"))
    listed_a, listed_b = F.col("a").isin(first), F.col("b").isin(first)
    loser = (F.when(listed_a & ~listed_b, F.col("a")).when(listed_b & ~listed_a, F.col("b"))
             .when(F.col("va").isNull(), F.col("a")).when(F.col("vb").isNull(), F.col("b"))
             .when(F.col("va") < F.col("vb"), F.col("a")).otherwise(F.col("b")))
    return both.select(loser.alias("dropped")).distinct()


def binary_duplicates(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """0/1 columns whose strongest rank correlation with another column exceeds the threshold."""
    flags = df.agg(*[F.bool_and(F.coalesce(finite(c).isin(0.0, 1.0), F.lit(True))).alias(c) for c in columns])
    binary = [c for c, v in flags.first().asDict().items() if v]
    return (corr_spearman(df, columns).filter(F.col("a").isin(binary) & (F.col("a") != F.col("b")))
            .groupBy(F.col("a").alias("column")).agg(F.max("r").alias("max_r"))
            .filter(F.col("max_r") > threshold))


TIE_BITS = 52
TIE_CELL_BITS = 18


def _tie_cuts(df: DataFrame, wanted: Mapping[int, tuple[str, float, int]], keys: Sequence[str]) -> dict[int, tuple]:
    """The (hash, key...) at a given offset among the rows holding a value; one per wanted cut.

    The hash is uniform, so its top bits split even a very common value into small cells: counts per
    cell find the right one, and only that cell's rows are ordered.
    """
    ties = df.select("_u", *keys, F.explode(F.array_compact(F.array(*[
        F.when(finite(c) == v, F.lit(t)) for t, (c, v, _) in wanted.items()]))).alias("_t"))
    ties = ties.withColumn("_cell", F.shiftright("_u", TIE_BITS - TIE_CELL_BITS))
    offset = F.coalesce(*[F.when(F.col("_t") == t, F.lit(o)) for t, (_, _, o) in wanted.items()])
    order = W.partitionBy("_t").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    cells = (ties.groupBy("_t", "_cell").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(order))
             .filter(holds(offset)).select("_t", "_cell", (offset - (F.col("upto") - F.col("m"))).alias("i")))
    found = fetch_bounded(cells, len(wanted))
    here = F.lit(False)
    for r in found:
        here = here | ((F.col("_t") == r["_t"]) & (F.col("_cell") == r["_cell"]))
    need = F.coalesce(*[F.when(F.col("_t") == r["_t"], F.lit(r["i"])) for r in found])
    place = F.row_number().over(W.partitionBy("_t").orderBy("_u", *keys)) - 1
    hit = ties.filter(here).withColumn("_place", place).filter(F.col("_place") == need)
    return {r["_t"]: (r["_u"], *[r[k] for k in keys]) for r in fetch_bounded(hit, len(wanted))}


def quantile_bins(df: DataFrame, columns: Sequence[str], keys: Sequence[str], q: int = 4, seed: str = "ties",
                  names: Mapping[str, str] | None = None) -> DataFrame:
    """Equal-count bins ``column_Q1..Qq`` over a total order: value, then a hash of the key, then the key.

    Only the ``q - 1`` cut rows per column are looked up (exact order statistics); every row is then
    compared with them, so nothing is sorted or moved. A value shared by very many rows is split at
    the right row by the hash.
    """
    src = df.withColumn("_u", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[
        F.col(k).cast("string") for k in keys])), 1, 13), 16, 10).cast("bigint"))
    ranked = ranked_values(src, columns, [b / q for b in range(1, q)])
    at = [F.floor((F.col("n") - 1) * b / q) for b in range(1, q)]
    rows = ranked.select("column", "value", "m", "upto", F.explode(F.array_compact(F.array(*[
        F.when(holds(p), F.struct(F.lit(b).alias("b"), p.alias("pos"))) for b, p in enumerate(at, start=1)]))).alias("s"))
    found = {(r["column"], r["s"]["b"]): (r["value"], r["m"], int(r["s"]["pos"] - (r["upto"] - r["m"])))
             for r in fetch_bounded(rows, len(columns) * q)}
    split = [cut for cut, (_, tied, offset) in found.items() if offset < tied - 1]
    cuts = _tie_cuts(src, {i: (c, found[c, b][0], found[c, b][2]) for i, (c, b) in enumerate(split)}, keys) if split else {}

    out = {}
    types = [src.schema["_u"].dataType, *[src.schema[k].dataType for k in keys]]
    for c in columns:
        x = finite(c)
        number = F.lit(1)
        for b in range(1, q):
            if (c, b) not in found:
                continue
            value = found[c, b][0]
            beyond = x > value
            if (c, b) in split:
                last = cuts[split.index((c, b))]
                after = F.struct("_u", *keys) > F.struct(*[F.lit(v).cast(t) for v, t in zip(last, types)])
                beyond = beyond | ((x == value) & after)
            number = number + F.when(beyond, 1).otherwise(0)
        shown = (names or {}).get(c, c.split("__", 1)[-1])
        out[shown] = F.when(x.isNotNull(), F.concat(F.lit(f"{shown}_Q"), number.cast("string")))
    return src.select(*keys, *[e.alias(n) for n, e in out.items()])


# Shift severity by AUC.
SHIFT_BANDS = [(0.55, True, "None"), (0.6, True, "Low"), (0.7, True, "Medium")]


def shift_severity(auc: Column) -> Column:
    out = F.when(auc.isNull(), F.lit(None).cast("string"))
    for bound, _, label in SHIFT_BANDS:
        out = out.when(auc <= bound, F.lit(label))
    return out.otherwise(F.lit("High"))


def shift_univariate(df: DataFrame, columns: Sequence[str], split: str) -> DataFrame:
    """How well each column alone tells the two parts of a 0/1 split apart."""
    return univariate_auc(df, columns, split).select("column", "auc", shift_severity(F.col("auc")).alias("severity"))


def shift_classifier(df: DataFrame, columns: Sequence[str], split: str, keys: Sequence[str], *,
                     model: str = "forest", holdout: float = 0.3, trees: int = 100, depth: int = 5,
                     seed: int = 42) -> DataFrame:
    """Train a classifier to tell the parts apart; AUC on held-out rows, with ranked importances."""
    ready = materialised(impute_median(df.select(*keys, split, *columns), columns).withColumn(
        "_held", hash32(f"shift{seed}", *keys) < int(holdout * 2**32)))
    train, held = ready.filter(~F.col("_held")), ready.filter("_held")
    if model == "forest":
        grown = forest.grow(train, split, columns, keys, [forest.Growth(trees, depth)], seed=seed)
        found = {r["feature"]: r["importance"] for r in forest.importance(grown).collect()}  # a row per feature
        weight, scored = [found.get(c, 0.0) for c in columns], forest.score(held, grown)
    else:
        assemble = VectorAssembler(inputCols=list(columns), outputCol="_x").transform
        fit = LogisticRegression(featuresCol="_x", labelCol=split, maxIter=50).fit(assemble(train))
        weight = [abs(v) for v in fit.coefficients]
        scored = fit.transform(assemble(held)).withColumn("y_pred", vector_to_array("probability")[1])
    scored = scored.select(F.lit(model).alias("model"), F.col(split).alias("y_true"), "y_pred")
    auc = M.roc_auc(M.score_counts(scored), ["model"]).first()["roc_auc"]
    ranked = df.sparkSession.createDataFrame(
        [(model, c, float(weight[i])) for i, c in enumerate(columns)], "model string, column string, importance double")
    ranked = ranked.withColumn("auc", F.lit(auc).cast("double"))
    return ranked.withColumn("severity", shift_severity(F.col("auc")))
