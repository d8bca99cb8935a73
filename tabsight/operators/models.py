"""Training, search and scoring of forests (see ``forest``) and of a logistic model. Every fit is distributed."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators import forest
from tabsight.operators import metrics as M
from tabsight.operators.calibration import Platt, calibrate, calibration_delta, calibration_report, cross_calibrate  # noqa: F401
from tabsight.operators.forest import Forests, Growth
from tabsight.operators.small import joined, moments, small_side
from tabsight.operators.splits import stratified_folds, stratified_split
from tabsight.sources.files import materialised

DEFAULT_PARAMS = {"trees": 200, "depth": None, "features": "sqrt", "leaf": 5}
DRAWS_EACH = 6
# Search ranges of the forest.
SEARCH_SPACE = {"depth": (6, 30), "features": ("sqrt", "log2", 0.2, 1.0), "trees": (200, 1500, 50), "leaf": (1, 15)}


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """``n / (classes * n_class)`` per class."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all"), F.count("*").alias("classes")).first()
    return counts.select(target, "n", (F.lit(whole["all"]) / (F.lit(whole["classes"]) * F.col("n"))).alias("weight")).orderBy(target)


def with_class_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    weights = small_side(class_weights(df, target).select(target, F.col("weight").alias(name)))
    return joined(df, weights, [target], "left")


def _growths(params: Sequence[Mapping]) -> list[Growth]:
    return [Growth.of({**DEFAULT_PARAMS, **p}) for p in params]


def fit_forest(df: DataFrame, target: str, keys: Sequence[str], features: Sequence[str], params: Mapping | None = None, *,
               fold: str | None = None, seed: int = 42) -> Forests:
    """A class-balanced random forest, or one for each left-out fold; a depth of None means as deep as trees are grown.

    Every tree draws as many rows as there are to train on, from all of them.
    """
    return forest.grow(df, target, features, keys, _growths([params or {}]), fold=fold, seed=seed)


def oof_predictions(folded: DataFrame, target: str, keys: Sequence[str], features: Sequence[str], *, k: int,
                    fold: str = "fold", params: Sequence[Mapping] = ({},), calibration: str | None = "platt",
                    model: str = "rf", seed: int = 42) -> DataFrame:
    """Every row scored by the forest of the folds it is not in, and calibrated on the scores of the other folds.

    ``params`` gives each fold's parameters in turn. ``y_raw`` is the score as it was before calibration.
    """
    out = None
    for i in range(min(k, len(params))):
        own = folded.filter(F.col(fold) % len(params) == i) if len(params) > 1 else folded
        grown = fit_forest(folded, target, keys, features, params[i], fold=fold, seed=seed)
        part = forest.score(own.select(*keys, fold, target, *[c for c in features if c not in keys]), grown, fold=fold)
        part = part.select(*keys, fold, F.lit(model).alias("model"), F.col(target).alias("y_true"), "y_pred")
        out = part if out is None else out.unionByName(part)
    out = materialised(out.withColumn("y_raw", F.col("y_pred")))
    return cross_calibrate(out, calibration, fold=fold) if calibration else out


def forest_oof(df: DataFrame, target: str, keys: Sequence[str], features: Sequence[str], *, k: int = 5,
               params: Sequence[Mapping] = ({},), calibration: str | None = "platt", seed: int = 42) -> DataFrame:
    """Stratified k-fold out-of-fold predictions; the folded table is written once and shared by all fits."""
    folded = materialised(stratified_folds(df.select(*keys, target, *[c for c in features if c not in keys]), target, keys, k=k, seed=str(seed)))
    return oof_predictions(folded, target, keys, features, k=k, params=params, calibration=calibration, seed=seed)


def fold_scores(df: DataFrame, forests: Forests, folds: Sequence[int], *, fold: str = "fold") -> DataFrame:
    """Every row scored by the forest of every fold: ``df`` once per fold with ``fold`` and ``y_pred``."""
    wide = df.drop(fold).withColumn(fold, F.explode(F.array(*[F.lit(int(f)) for f in folds])))
    return forest.score(wide, forests, fold=fold)


def sample_params(n: int, seed: int = 42, space: Mapping = SEARCH_SPACE, each: int = DRAWS_EACH) -> list[dict]:
    """Seeded random draws from the search space.

    The features tried and the least leaf shape how a tree grows; depth and number of trees only cut what has grown. So
    ``each`` draws of the latter two share one draw of the former, and one forest answers for all of them.
    """
    rng = random.Random(seed)
    out: list[dict] = []
    while len(out) < n:
        kinds = space["features"]
        named = [f for f in kinds if isinstance(f, str)]
        low, high = [f for f in kinds if not isinstance(f, str)]
        trees = space["trees"]
        shape = {"features": rng.choice(named) if rng.random() < 0.5 else str(round(rng.uniform(low, high), 3)), "leaf": rng.randint(*space["leaf"])}
        out += [{"depth": rng.randint(*space["depth"]) if rng.random() < 0.5 else max(space["depth"]),
                 "trees": rng.randrange(trees[0], trees[1] + 1, trees[2]), **shape} for _ in range(each)]
    return out[:n]


def forest_search(df: DataFrame, target: str, keys: Sequence[str], features: Sequence[str], *, trials: int = 30,
                  k: int = 5, space: Mapping = SEARCH_SPACE, weights: Sequence[float] = (0.4, 0.4, 0.2), seed: int = 42,
                  folded: DataFrame | None = None) -> DataFrame:
    """Random search over forest parameters by cross-validated composite score, best first.

    Trials that differ in depth and number of trees only are read off one forest per fold, by running sums of its votes.
    The composite is the mean over folds of the weighted ROC-AUC, average precision and accuracy; all held-out rows
    count, reduced to those of different bins. ``folded`` are the rows with their folds where they were dealt before.
    """
    if folded is None:
        folded = materialised(stratified_folds(df.select(*keys, target, *[c for c in features if c not in keys]), target, keys, k=k, seed=str(seed)))
    drawn = sample_params(trials, seed, space)
    shapes = list(dict.fromkeys((p["features"], p["leaf"]) for p in drawn))
    members = [[i for i, p in enumerate(drawn) if (p["features"], p["leaf"]) == s] for s in shapes]
    growths = [Growth(max(drawn[i]["trees"] for i in own), max(drawn[i]["depth"] for i in own), *s) for s, own in zip(shapes, members)]
    grown = forest.grow(folded, target, features, keys, growths, fold="fold", seed=seed)
    cells = forest.cells_of(folded, target, grown.binning)
    counts = None
    for g, own in enumerate(members):
        part = forest.staged_counts(cells, grown, g, [(i, drawn[i]["depth"], drawn[i]["trees"]) for i in own])
        counts = part if counts is None else counts.unionByName(part)
    counts = materialised(counts)
    right = F.when(F.col("score") >= 0.5, F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    accuracy = counts.groupBy("trial", "fold").agg((F.sum(right) / F.sum("n")).alias("accuracy"))
    ranked = M.ranking_metrics(counts, ["trial", "fold"]).join(accuracy, ["trial", "fold"])
    terms = [w * F.coalesce(c, F.lit(0.0)) for w, c in zip(weights, ("roc_auc", "pr_auc", "accuracy"))]
    scores = {r["trial"]: r["composite"] for r in ranked.groupBy("trial").agg(F.avg(sum(terms[1:], terms[0])).alias("composite")).collect()}  # a row per trial
    return df.sparkSession.createDataFrame(
        [(i, p["depth"], str(p["features"]), p["trees"], p["leaf"], float(scores.get(i, 0.0))) for i, p in enumerate(drawn)],
        "trial int, depth int, features string, trees int, leaf int, composite double").orderBy(
        F.col("composite").desc(), "trial")


def final_scoring(df: DataFrame, target: str, keys: Sequence[str], features: Sequence[str], *, k: int = 5,
                  params: Sequence[Mapping] | None = None, trials: int = 12, calibration: str = "platt", seed: int = 42) -> DataFrame:
    """The test part scored once: parameters by search on the training part, or those of the best fold where ``params``
    gives each fold's; calibrator and threshold from out-of-fold rows."""
    split = materialised(stratified_split(df.select(*keys, target, *[c for c in features if c not in keys]), target, keys, seed=str(seed)))
    train, test = split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")
    folded = materialised(stratified_folds(train, target, keys, k=k, seed=str(seed)))
    if params is None:
        best = forest_search(train, target, keys, features, trials=trials, k=k, seed=seed, folded=folded).first()
        params = [{c: best[c] for c in ("depth", "features", "trees", "leaf")}]
    raw = materialised(oof_predictions(folded, target, keys, features, k=k, params=params, calibration=None, seed=seed))
    oof = materialised(cross_calibrate(raw, calibration))
    per_fold = M.score_counts(oof, by=["model", "fold"])
    chosen = M.select_best_fold(M.average_precision(per_fold, ["model", "fold"])).first()["selected_fold"]
    model = fit_forest(train, target, keys, features, params[chosen % len(params)], seed=seed)
    scored = forest.score(test, model).select(F.lit("rf").alias("model"), *keys, F.col(target).alias("y_true"), "y_pred")
    scored = materialised(calibrate(scored, calibration, fit_on=raw))
    policy = M.best_f1_grid(oof)
    at = M.metrics_at_threshold(scored, policy).select(
        "model", F.col("threshold").alias("threshold_deploy"), F.col("f1").alias("f1_deploy"),
        F.col("accuracy").alias("accuracy_deploy"))
    return M.all_metrics(scored).join(at, "model").withColumn("selected_fold", F.lit(int(chosen)))


def fold_ensemble_scoring(df: DataFrame, target: str, keys: Sequence[str], features: Sequence[str], *, k: int = 5,
                          params: Mapping | None = None, seed: int = 42) -> DataFrame:
    """Headline metrics on the test part of every fold's forest (fold 0 to k-1) and of their mean (fold -1)."""
    split = materialised(stratified_split(df.select(*keys, target, *[c for c in features if c not in keys]), target, keys, seed=str(seed)))
    folded = materialised(stratified_folds(split.filter("split = 'train'").drop("split"), target, keys, k=k, seed=str(seed)))
    grown = fit_forest(folded, target, keys, features, params, fold="fold", seed=seed)
    each = materialised(fold_scores(split.filter("split = 'test'").drop("split"), grown, range(k)).select(
        F.lit("rf").alias("model"), *keys, "fold", F.col(target).alias("y_true"), "y_pred"))
    mean = materialised(M.fold_ensemble(each, by=["model", *keys], folds=k).select("model", F.lit(-1).alias("fold"), "y_true", "y_pred"))
    return M.all_metrics(each.select("model", "fold", "y_true", "y_pred").unionByName(mean), by=["model", "fold"])


def forest_importance(folded: DataFrame, target: str, keys: Sequence[str], features: Sequence[str], *, k: int, fold: str = "fold",
                      params: Mapping | None = None, seed: int = 42) -> DataFrame:
    """``fold, feature, importance`` of each fold's forest; a feature that no tree uses has 0."""
    found = forest.importance(fit_forest(folded, target, keys, features, params, fold=fold, seed=seed))
    every = folded.sparkSession.createDataFrame([(f, c) for f in range(k) for c in features], "fold int, feature string")
    return every.join(found, ["fold", "feature"], "left").select("fold", "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def forest_attribution(df: DataFrame, target: str, keys: Sequence[str], features: Sequence[str], *, params: Mapping | None = None,
                       steps: int = 4, seed: int = 42) -> DataFrame:
    """``keys..., base, y_pred, feature, step, score`` of a forest grown on the same rows; see ``forest.attribution``."""
    return forest.attribution(df, fit_forest(df, target, keys, features, params, seed=seed), keys, steps=steps)


def row_attribution(df: DataFrame, target: str, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``keys..., feature, step, score``: shares of |coefficient * (x - mean)| of a logistic model.

    Scores are non-negative and sum to 1 per row (0 for a row at the mean), as the consumers expect.
    """
    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    fit = LogisticRegression(featuresCol="_x", labelCol=target, regParam=1e-4, maxIter=50).fit(rows)
    mean = moments(df, features)
    part = [F.abs(float(w) * (F.col(c).cast("double") - mean[c]["mean"])) for c, w in zip(features, fit.coefficients)]
    total = sum(part[1:], part[0])
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(0).alias("step"),
                      F.when(total > 0, v / total).otherwise(0.0).alias("score")) for c, v in zip(features, part)]
    return df.select(*keys, F.inline(F.array(*cells)))
