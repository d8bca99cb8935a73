"""Calibration of scores, for all groups (models, folds) at once.

Rows are reduced to counts per group and distinct score first. Platt maps of all groups are fitted together by Newton
steps, one aggregate per step whatever the number of groups. Isotonic maps pool adjacent violators inside ranges of
scores; ranges whose ends still violate the order are pooled in pairs, two at a time, until none does, so no task and no
driver ever holds a group's blocks. Maps are tables and are met by joins.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.operators import metrics as M
from tabsight.operators.ranking import nearest_knots, range_cells
from tabsight.operators.small import fetch_bounded, joined, small_side
from tabsight.sources.files import materialised

NEWTON_STEPS = 60
_GROUP = "_gid"


def grouped_scores(df: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """``by..., p, w, pos``: rows and positives per distinct score, all that a one-dimensional calibrator needs."""
    return df.groupBy(*by, (F.col(p).cast("double") + F.lit(0.0)).alias("p")).agg(
        F.count("*").cast("double").alias("w"), F.sum(F.col(y).cast("double")).alias("pos"))


def _numbered(counts: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The groups with an integer each, and the counts with that integer; groups are models and folds, so few."""
    rows = fetch_bounded(counts.select(*by).distinct(), what="calibrated groups") if by else [()]
    schema = ", ".join([f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by] + [f"{_GROUP} int"])
    groups = F.broadcast(counts.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema))
    return groups, joined(counts, groups, by)


def platt_maps(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., slope, intercept`` of each group's logistic map, L2-penalised with C = 1."""
    groups, numbered = _numbered(counts, by)
    table = materialised(numbered.select(_GROUP, "p", "w", "pos"))
    spark = counts.sparkSession
    fits = {r[0]: (0.0, 0.0) for r in table.select(_GROUP).distinct().collect()}  # as few as the groups
    moving = set(fits)
    for _ in range(NEWTON_STEPS):
        if not moving:
            break
        now = F.broadcast(spark.createDataFrame([(g, *fits[g]) for g in moving], f"{_GROUP} int, _a double, _b double"))
        q = 1.0 / (1.0 + F.exp(-(F.col("p") * F.col("_a") + F.col("_b"))))
        gap, bend, p = F.col("w") * q - F.col("pos"), F.col("w") * q * (1.0 - q), F.col("p")
        sums = table.join(now, _GROUP).groupBy(_GROUP).agg(*[F.sum(e).alias(c) for c, e in (
            ("ga", gap * p), ("gb", gap), ("haa", bend * p * p), ("hab", bend * p), ("hbb", bend))]).collect()
        for r in sums:
            a, b = fits[r[_GROUP]]
            ga, haa, hab, hbb = r["ga"] + a, r["haa"] + 1.0, r["hab"], max(r["hbb"], 1e-12)
            det = haa * hbb - hab * hab
            step = ((hbb * ga - hab * r["gb"]) / det, (haa * r["gb"] - hab * ga) / det)
            size = max(map(abs, step))
            scale = min(1.0, 5.0 / size) if size else 1.0  # a group of one class would run away
            fits[r[_GROUP]] = (a - scale * step[0], b - scale * step[1])
            if size < 1e-10:
                moving.discard(r[_GROUP])
    maps = spark.createDataFrame([(g, *f) for g, f in fits.items()], f"{_GROUP} int, slope double, intercept double")
    return groups.join(F.broadcast(maps), _GROUP).select(*by, "slope", "intercept")


def apply_platt(df: DataFrame, maps: DataFrame, by: Sequence[str] = (), p: str = "y_pred") -> DataFrame:
    if not by:
        one = maps.first()
        return Platt(one["slope"], one["intercept"]).apply(df, p) if one else df.withColumn(p, F.lit(None).cast("double"))
    found = joined(df, small_side(maps), by, "left")
    return found.withColumn(p, 1.0 / (1.0 + F.exp(-(F.col(p) * F.col("slope") + F.col("intercept"))))).select(*df.columns)


def _pooled(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks of increasing means from blocks in score order; a pooled block stays in its first one's cell."""
    out: list[list] = []
    for g, cell, lo, hi, w, pos in rows.sort_values("lo")[[_GROUP, "cell", "lo", "hi", "w", "pos"]].itertuples(index=False):
        out.append([g, cell, lo, hi, w, pos])
        while len(out) > 1 and out[-2][5] * out[-1][4] >= out[-1][5] * out[-2][4]:
            _, _, _, hi, w, pos = out.pop()
            out[-1][3:] = [hi, out[-1][4] + w, out[-1][5] + pos]
    return pd.DataFrame(out, columns=[_GROUP, "cell", "lo", "hi", "w", "pos"])


def isotonic_maps(counts: DataFrame, by: Sequence[str] = (), cells: int | None = None) -> DataFrame:
    """``by..., x, v``: the knots of each group's monotone map, two for each block of pooled scores (or one)."""
    groups, numbered = _numbered(counts, by)
    schema = f"{_GROUP} int, cell int, lo double, hi double, w double, pos double"
    placed = range_cells(numbered.select(_GROUP, "p", "w", "pos"), [_GROUP, "p"], cells=cells)
    start = placed.select(_GROUP, "cell", F.col("p").alias("lo"), F.col("p").alias("hi"), "w", "pos")
    blocks, shift = materialised(start.groupBy(_GROUP, "cell").applyInPandas(_pooled, schema)), 0
    while True:
        mean = F.col("pos") / F.col("w")
        ends = blocks.groupBy(_GROUP, "cell").agg(F.min_by(mean, "lo").alias("low"), F.max_by(mean, "lo").alias("high"))
        order = W.partitionBy(_GROUP).orderBy("cell")  # a row per cell
        ends = materialised(ends.withColumns({"rank": F.row_number().over(order), "wrong": F.lag("high").over(order) >= F.col("low")}))
        if not ends.filter("wrong").limit(1).count():
            break
        pairs = ends.select(_GROUP, "cell", F.floor((F.col("rank") + shift) / 2).alias("pair"))
        blocks = materialised(blocks.join(F.broadcast(pairs), [_GROUP, "cell"]).groupBy(_GROUP, "pair").applyInPandas(_pooled, schema))
        shift = 1 - shift
    knots = blocks.select(_GROUP, (F.col("pos") / F.col("w")).alias("v"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"))
    return knots.join(groups, _GROUP).select(*by, "x", "v")


def _interpolated(scores: DataFrame, maps: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., p, v`` for distinct scores: the value between the knots on either side, or of the nearest at the ends."""
    near = nearest_knots(scores.withColumnRenamed("p", "x"), maps, by)
    a, b = F.col("below"), F.col("above")
    v = (F.when(a.isNull(), b["v"]).when(b.isNull() | (a["x"] == b["x"]), a["v"])
         .otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("x") - a["x"]) / (b["x"] - a["x"])))
    return near.select(*by, F.col("x").alias("p"), v.alias("v"))


def apply_isotonic(df: DataFrame, maps: DataFrame, by: Sequence[str] = (), p: str = "y_pred") -> DataFrame:
    """Scores by linear interpolation between knots, ends clipped; a group without a map gets NULL."""
    exact = F.col(p).cast("double") + F.lit(0.0)
    scores = df.select(*by, exact.alias("p")).filter("p IS NOT NULL").distinct()
    found = _interpolated(scores, maps, by).withColumnsRenamed({"p": "_p", "v": "_v"})
    return joined(df.withColumn("_p", exact), found, [*by, "_p"], "left").withColumn(p, F.col("_v")).select(*df.columns)


_METHODS = {"platt": (platt_maps, apply_platt), "isotonic": (isotonic_maps, apply_isotonic)}


def calibrate(df: DataFrame, method: str = "platt", *, fit_on: DataFrame | None = None, by: Sequence[str] = (), y: str = "y_true",
              p: str = "y_pred") -> DataFrame:
    """Calibrated probabilities, a map for each group of ``by``. ``fit_on`` keeps the fitting rows apart from the scored ones."""
    fit, apply = _METHODS[method]
    return apply(df, fit(grouped_scores(df if fit_on is None else fit_on, by, y, p), by), by, p)


def cross_calibrate(oof: DataFrame, method: str = "platt", *, fold: str = "fold", model: str = "model", y: str = "y_true",
                    p: str = "y_pred") -> DataFrame:
    """Every row calibrated by its own model's calibrator, fitted on all folds of that model but the row's.

    A NULL model or fold is a model or fold like any other; a model of one fold has nothing to fit on and is an error.
    Counts per score go to each calibrator that they help to fit, so rows are read once.
    """
    fit, apply = _METHODS[method]
    counts = materialised(grouped_scores(oof, [model, fold], y, p))
    folds = [(r[0], r[1]) for r in fetch_bounded(counts.select(model, fold).distinct(), what="models and folds")]
    single = [m for m in dict.fromkeys(m for m, _ in folds) if sum(m == n for n, _ in folds) < 2]
    if single:
        raise ValueError(f"models of a single fold cannot be calibrated across folds: {single}")
    if not folds:
        return oof
    kind = {c: oof.schema[c].dataType.simpleString() for c in (model, fold)}
    uses = counts.sparkSession.createDataFrame([(m, own, other) for m, own in folds for n, other in folds if m == n and own != other],
                                               f"`{model}` {kind[model]}, `{fold}` {kind[fold]}, _for {kind[fold]}")
    fitted = joined(counts, F.broadcast(uses), [model, fold]).groupBy(model, F.col("_for").alias(fold), "p").agg(F.sum("w").alias("w"), F.sum("pos").alias("pos"))
    return apply(oof, fit(fitted, [model, fold]), [model, fold], p)


def calibration_delta(before: DataFrame, after: DataFrame, *, fold: str = "fold", model: str = "model",
                      bins: int = 15) -> DataFrame:
    """Brier and ECE of two versions of the same predictions, per fold and overall (fold -1)."""
    def both(df: DataFrame, tag: str) -> DataFrame:
        wide = df.select(model, "y_true", "y_pred", F.explode(F.array(F.col(fold), F.lit(-1))).alias(fold))
        by = [model, fold]
        return (M.basic_metrics(wide, by=by).select(*by, F.col("brier").alias(f"brier_{tag}"))
                .join(M.ece_left_closed(wide, by=by, bins=bins).withColumnRenamed("ece", f"ece_{tag}"), by))

    out = both(before, "pre").join(both(after, "post"), [model, fold])
    return out.withColumns({"delta_brier": F.col("brier_post") - F.col("brier_pre"),
                            "delta_ece": F.col("ece_post") - F.col("ece_pre")})


def calibration_report(oof: DataFrame, method: str = "platt", *, folds: Sequence[int], fold: str = "fold",
                       model: str = "model", bins: int = 15) -> DataFrame:
    """Brier and ECE per model and fold before and after calibrating on that model's fold, and over all folds."""
    own = oof.filter(F.col(fold).isin(list(folds)))
    after = calibrate(own, method, by=[model, fold])
    return calibration_delta(oof, after, fold=fold, model=model, bins=bins)


class Platt:
    """The logistic map of one score."""

    def __init__(self, slope: float, intercept: float) -> None:
        self.slope, self.intercept = slope, intercept

    @classmethod
    def fit(cls, df: DataFrame, y: str = "y_true", p: str = "y_pred") -> Platt:
        r = platt_maps(grouped_scores(df, (), y, p)).first()
        return cls(r["slope"], r["intercept"])

    def apply(self, df: DataFrame, p: str = "y_pred") -> DataFrame:
        return df.withColumn(p, 1.0 / (1.0 + F.exp(-(F.col(p) * self.slope + self.intercept))))
