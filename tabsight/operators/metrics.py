"""Metrics of scored binary predictions, as aggregates grouped by any key columns.

Ranked metrics never sort rows. ``score_counts`` first reduces the rows to one per distinct score
(map-side combined, so a score shared by a third of the rows costs nothing); running totals over
those scores are taken cell by cell (see ``ranking``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.functions.expressions import ratio
from tabsight.operators.ranking import running_totals
from tabsight.operators.small import joined, small_side
from tabsight.operators.splits import hash_words, poisson_draws
from tabsight.sources.files import materialised


def score_counts(df: DataFrame, *, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """``by..., score, pos, n``: rows and positives per distinct score."""
    # adding 0.0 turns -0.0 into 0.0
    return (df.groupBy(*by, (F.col(p).cast("double") + F.lit(0.0)).alias("score"))
            .agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count("*").alias("n")))


def ranked_scores(counts: DataFrame, by: Sequence[str], descending: bool = True, cells: int | None = None) -> DataFrame:
    """Add ``tp`` and ``m``: positives and rows at or above (below, if ascending) each score; and
    ``p_all`` and ``n_all``: the group's totals."""
    return running_totals(counts, by=by, value="score", sums={"pos": "tp", "n": "m"}, descending=descending,
                          totals={"pos": "p_all", "n": "n_all"}, cells=cells)


def _group_totals(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("pos").alias("p_all"), F.sum("n").alias("n_all"))


def _auc() -> Column:
    neg = F.col("n") - F.col("pos")
    above_neg = F.col("m") - F.col("tp") - neg
    lost = F.sum(F.col("pos") * (above_neg + neg / F.lit(2.0)))
    pos, negs = F.sum("pos"), F.sum(neg)
    return F.when((pos > 0) & (negs > 0), 1.0 - lost / (pos.cast("double") * negs))


def _ap() -> Column:
    step = F.sum(F.col("pos") * F.col("tp") / F.col("m").cast("double"))
    return F.when(F.sum("pos") > 0, step / F.sum("pos"))


def roc_auc(counts: DataFrame, by: Sequence[str], cells: int | None = None) -> DataFrame:
    """Rank form of ROC-AUC, a tie counting one half; NULL when a class is missing."""
    return ranked_scores(counts, by, cells=cells).groupBy(*by).agg(_auc().alias("roc_auc"))


def average_precision(counts: DataFrame, by: Sequence[str], cells: int | None = None) -> DataFrame:
    """Sum of recall steps times precision, without interpolation."""
    return ranked_scores(counts, by, cells=cells).groupBy(*by).agg(_ap().alias("pr_auc"))


def ranking_metrics(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """ROC-AUC, average precision and the number of distinct scores from one ranking."""
    return ranked_scores(counts, by).groupBy(*by).agg(
        _auc().alias("roc_auc"), _ap().alias("pr_auc"), F.count("*").alias("distinct"))


def _confusion(y: Column, flag: Column) -> dict[str, Column]:
    def count(c: Column) -> Column:
        return F.sum(c.cast("bigint"))

    return {"tn": count((y == 0) & ~flag), "fp": count((y == 0) & flag),
            "fn": count((y == 1) & ~flag), "tp": count((y == 1) & flag)}


def f1_value(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def basic_metrics(df: DataFrame, *, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "y_pred",
                  threshold: float = 0.5) -> DataFrame:
    """Accuracy, F1 and Brier score at one threshold."""
    m = _confusion(F.col(y), F.col(p) >= threshold)
    clipped = F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(0.0))
    return (df.groupBy(*by).agg(*[c.alias(k) for k, c in m.items()], F.count("*").alias("n"),
                                F.avg((clipped - F.col(y)) * (clipped - F.col(y))).alias("brier"))
            .select(*by, ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
                    f1_value(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), "brier"))


def confusion_matrix(df: DataFrame, *, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "y_pred",
                     threshold: float | str = 0.5) -> DataFrame:
    """Counts, rates and row-normalised shares; ``threshold`` is a number or a column name."""
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    m = _confusion(F.col(y), F.col(p) >= cut)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in m.items()]).select(
        *by, "tn", "fp", "fn", "tp",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(tn, tn + fp).alias("specificity"),
        f1_value(tp, fp, fn).alias("f1"),
        ratio(tn, tn + fp).alias("tn_share"), ratio(fp, tn + fp).alias("fp_share"),
        ratio(fn, tp + fn).alias("fn_share"), ratio(tp, tp + fn).alias("tp_share"))


def ece_right_closed(df: DataFrame, *, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "y_pred",
                     bins: int = 10) -> DataFrame:
    """Expected calibration error over ``(lower, upper]`` bins; a score of exactly 0 is in no bin."""
    per_bin = (df.withColumn("bin", F.when(F.col(p) > 0, F.ceil(F.col(p) * bins)))
               .groupBy(*by, "bin").agg(F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.count("*").alias("n")))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sp") - F.col("sy"))).otherwise(0.0)
    return per_bin.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def reliability_bins(df: DataFrame, *, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "y_pred",
                     bins: int = 15) -> DataFrame:
    """Counts, accuracy and mean confidence per ``[lower, upper)`` bin, the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return (df.groupBy(*by, b.alias("bin"))
            .agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("accuracy"),
                 F.avg(p).alias("confidence"))
            .withColumns({"lower": F.col("bin") / F.lit(float(bins)),
                          "upper": (F.col("bin") + 1) / F.lit(float(bins))}))


def ece_left_closed(df: DataFrame, *, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "y_pred",
                    bins: int = 15) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")
    return (reliability_bins(df, by=by, y=y, p=p, bins=bins).groupBy(*by)
            .agg((F.sum(gap) / F.sum("n")).alias("ece")))


def best_f1_grid(df: DataFrame, *, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "y_pred",
                 start: int = 10, stop: int = 90, step: int = 1, scale: int = 100) -> DataFrame:
    """Grid threshold ``t/scale`` with the best F1; the lowest wins ties, 0.5 if no F1 is positive.

    Rows collapse to one per grid slot before thresholds are expanded, so the expansion is over at
    most ``(stop-start)/step`` rows per group.
    """
    slots = (stop - start + step - 1) // step
    slot = F.floor((F.floor(F.col(p) * scale + 1e-9) - start) / F.lit(step))
    per_slot = (df.groupBy(*by, F.least(F.greatest(slot, F.lit(-1)), F.lit(slots - 1)).cast("int").alias("slot"))
                .agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count("*").alias("n")))
    totals = _group_totals(per_slot, by)
    reached = F.when(F.col("slot") >= 0, F.sequence(F.lit(0), F.col("slot"))).otherwise(F.array().cast("array<int>"))
    at = (per_slot.select(*by, "pos", "n", F.explode(reached).alias("t")).groupBy(*by, "t").agg(F.sum("pos").alias("tp"), F.sum("n").alias("m")))
    at = joined(at, totals, by)
    f1 = ratio(2 * F.col("tp"), F.col("m") + F.col("p_all"))
    best = at.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("t")).alias("t"))).alias("b"))
    threshold = (start - F.col("b.t") * step) / F.lit(float(scale))
    return (joined(totals, best, by, "left")
            .select(*by, F.when(F.col("b.f1") > 0, threshold).otherwise(F.lit(0.5)).alias("threshold"),
                    F.coalesce(F.col("b.f1"), F.lit(0.0)).alias("f1")))


def f1_at_recall(counts: DataFrame, by: Sequence[str], recalls: Sequence[float] = (0.8, 0.9)) -> DataFrame:
    """Best F1 over all distinct scores whose recall is at least ``r``; one row per group and ``r``.

    Where no score qualifies the row falls back to threshold 0.5 and its F1.
    """
    r = ranked_scores(counts, by)
    recall, precision = ratio(F.col("tp"), F.col("p_all")), F.col("tp") / F.col("m").cast("double")
    scored = r.select(
        *by, "score", "tp", "m", "p_all", recall.alias("recall"),
        (2 * (precision * recall) / (precision + recall + 1e-10)).alias("f1"))
    kept = [F.max(F.when(F.col("recall") >= c, F.struct("f1", (-F.col("score")).alias("t")))).alias(f"b{i}")
            for i, c in enumerate(recalls)]
    half = F.min_by(ratio(2 * F.col("tp"), F.col("m") + F.col("p_all")),
                    F.when(F.col("score") >= 0.5, F.col("score")))
    best = scored.groupBy(*by).agg(*kept, half.alias("half"))
    return best.select(*by, F.inline(F.array(*[
        F.struct(F.lit(float(c)).alias("min_recall"),
                 F.coalesce(-F.col(f"b{i}.t"), F.lit(0.5)).alias("threshold"),
                 F.coalesce(F.col(f"b{i}.f1"), F.col("half"), F.lit(0.0)).alias("f1"))
        for i, c in enumerate(recalls)])))


def metrics_at_threshold(df: DataFrame, policy: DataFrame, *, by: Sequence[str] = ("model",), y: str = "y_true",
                         p: str = "y_pred") -> DataFrame:
    """Metrics at thresholds fixed elsewhere: ``policy`` has one ``threshold`` per group."""
    cut = joined(df, small_side(policy.select(*by, "threshold")), by)
    return confusion_matrix(cut, by=[*by, "threshold"], y=y, p=p, threshold="threshold").select(
        *by, "threshold", "f1", "accuracy", F.col("recall").alias("sensitivity"), "specificity")


def composite_metric(df: DataFrame, *, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "y_pred",
                     weights: Sequence[float] = (0.4, 0.4, 0.2)) -> DataFrame:
    """Weighted sum of ROC-AUC, average precision and accuracy."""
    counts = score_counts(df, by=by, y=y, p=p)
    both = joined(ranking_metrics(counts, by), basic_metrics(df, by=by, y=y, p=p), by)
    w = weights
    return both.select(*by, (w[0] * F.col("roc_auc") + w[1] * F.col("pr_auc")
                               + w[2] * F.col("accuracy")).alias("composite"))


def all_metrics(df: DataFrame, *, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "y_pred",
                bins: int = 10) -> DataFrame:
    """The twelve headline metrics in one row per group.

    Everything is derived from the per-score table: it stands in for the rows, weighted by count.
    """
    counts = score_counts(df, by=by, y=y, p=p)
    ranked = ranked_scores(counts, by)
    s, pos, n = F.col("score"), F.col("pos"), F.col("n")
    neg, tp, m, p_all, n_all = n - pos, F.col("tp"), F.col("m"), F.col("p_all"), F.col("n_all")
    hit = s >= 0.5
    recall, precision = ratio(tp, p_all), tp / m.cast("double")
    f1r = 2 * (precision * recall) / (precision + recall + 1e-10)

    def best(c: float) -> Column:
        return F.max(F.when(recall >= c, F.struct(f1r.alias("f1"), (-s).alias("t"))))

    def gap(b: int) -> Column:
        inside = F.when(F.ceil(s * bins) == b, s * n - pos).otherwise(0.0)
        return F.abs(F.sum(F.when(s > 0, inside).otherwise(0.0)))

    ece = sum((gap(b) for b in range(2, bins + 1)), gap(1))
    one = ranked.groupBy(*by, "p_all", "n_all").agg(
        F.sum(pos * (m - tp - neg + neg / F.lit(2.0))).alias("lost"),
        F.sum(pos * tp / m.cast("double")).alias("ap"),
        F.sum(F.when(hit, pos).otherwise(F.lit(0))).alias("tp5"),
        F.sum(F.when(hit, neg).otherwise(F.lit(0))).alias("fp5"),
        F.sum(pos * (s - 1) * (s - 1) + neg * s * s).alias("sq"),
        ece.alias("gap"), best(0.8).alias("b8"), best(0.9).alias("b9"))
    grid = best_f1_grid(df, by=by, y=y, p=p).select(*by, F.col("f1").alias("f1_best"),
                                                   F.col("threshold").alias("threshold_f1"))
    n_neg = n_all - p_all
    f1_half = ratio(2 * F.col("tp5"), F.col("tp5") + F.col("fp5") + p_all)
    return joined(one, grid, by).select(
        *by,
        F.when((p_all > 0) & (n_neg > 0), 1.0 - F.col("lost") / (p_all.cast("double") * n_neg)).alias("roc_auc"),
        F.when(p_all > 0, F.col("ap") / p_all).alias("pr_auc"),
        ratio(F.col("tp5") + n_neg - F.col("fp5"), n_all).alias("accuracy"),
        f1_half.alias("f1"),
        (F.col("sq") / n_all).alias("brier"), (F.col("gap") / n_all).alias("ece"),
        "f1_best", "threshold_f1",
        F.coalesce(F.col("b8.f1"), f1_half).alias("f1_recall_08"),
        F.coalesce(-F.col("b8.t"), F.lit(0.5)).alias("threshold_recall_08"),
        F.coalesce(F.col("b9.f1"), f1_half).alias("f1_recall_09"),
        F.coalesce(-F.col("b9.t"), F.lit(0.5)).alias("threshold_recall_09"))


ALL_METRICS = ["roc_auc", "pr_auc", "accuracy", "f1", "brier", "ece", "f1_best", "threshold_f1", "f1_recall_08",
               "threshold_recall_08", "f1_recall_09", "threshold_recall_09"]


def cv_summary(df: DataFrame, *, by: Sequence[str] = ("model",), fold: str = "fold", y: str = "y_true",
               p: str = "y_pred") -> DataFrame:
    """Mean and population deviation over folds of every headline metric, in long form."""
    per_fold = all_metrics(df, by=[*by, fold], y=y, p=p)
    return (per_fold.unpivot([*by, fold], ALL_METRICS, "metric", "v").groupBy(*by, "metric")
            .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("folds")))


def roc_curve(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """False and true positive rate per distinct score."""
    r = ranked_scores(counts, by)
    return r.select(*by, "score", ratio(F.col("m") - F.col("tp"), F.col("n_all") - F.col("p_all")).alias("fpr"),
                    ratio(F.col("tp"), F.col("p_all")).alias("tpr"))


def pr_curve(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision and recall per distinct score."""
    r = ranked_scores(counts, by)
    return r.select(*by, "score", ratio(F.col("tp"), F.col("m")).alias("precision"),
                    ratio(F.col("tp"), F.col("p_all")).alias("recall"))


def pair_predictions(a: DataFrame, b: DataFrame, *, id: str = "id", y: str = "y_true",
                     p: str = "y_pred") -> DataFrame:
    """Align two models on key and outcome: ``id, y, p_a, p_b``."""
    return (a.select(id, y, F.col(p).alias("p_a"))
            .join(b.select(id, y, F.col(p).alias("p_b")), [id, y]))


def fold_ensemble(df: DataFrame, *, by: Sequence[str] = ("model", "id"), y: str = "y_true", p: str = "y_pred",
                  folds: int | None = None) -> DataFrame:
    """Mean probability over fold models per id; fails if an id lacks a fold."""
    out = df.groupBy(*by).agg(F.max(y).alias(y), F.avg(p).alias(p), F.count("*").alias("folds"))
    if folds is not None:
        wrong = F.raise_error(F.concat(F.lit("unexpected fold count "), F.col("folds").cast("string")))
        out = out.withColumn("folds", F.when(F.col("folds") == folds, F.col("folds")).otherwise(wrong.cast("bigint")))
    return out


def select_best_fold(fold_metrics: DataFrame, *, by: Sequence[str] = ("model",), fold: str = "fold",
                     metric: str = "pr_auc") -> DataFrame:
    """Fold with the highest validation metric, the first one on ties."""
    best = F.max(F.when(F.col(metric).isNotNull(), F.struct(F.col(metric).alias("v"), (-F.col(fold)).alias("f"))))
    return fold_metrics.groupBy(*by).agg(best.alias("b")).select(
        *by, (-F.col("b.f")).cast("int").alias("selected_fold"), F.col("b.v").alias("score"))


def aggregate_params(params: DataFrame, *, by: Sequence[str] = ("model",), fold: str = "fold", param: str = "param",
                     number: str = "number", text: str = "text") -> DataFrame:
    """One value per parameter: median of numbers (rounded when all are whole), else the commonest text.

    ``params`` is long: one row per fold and parameter, a few values per group.
    """
    whole = F.min((F.col(number) == F.floor(F.col(number))).cast("int")) == 1
    numbers = params.groupBy(*by, param).agg(F.expr(f"percentile({number}, 0.5)").alias("mid"), whole.alias("whole"))
    texts = (params.filter(F.col(text).isNotNull()).groupBy(*by, param, text)
             .agg(F.count("*").alias("c"), F.min(fold).alias("first"))
             .groupBy(*by, param).agg(F.max_by(text, F.struct(F.col("c"), -F.col("first"))).alias("mode")))
    return numbers.join(texts, [*by, param], "left").select(
        *by, param, F.when(F.col("whole"), F.rint("mid")).otherwise(F.col("mid")).alias("number_value"),
        F.when(F.col("mid").isNull(), F.col("mode")).alias("text_value"))


def outcome_listing(df: DataFrame, other: DataFrame, *, id: str = "id", y: str = "y_true", p: str = "y_pred",
                    threshold: float = 0.5) -> DataFrame:
    """TP/TN/FP/FN per row, most probable first, with another model's probability joined by id."""
    flag = F.col(p) >= threshold
    label = (F.when(flag & (F.col(y) == 1), "TP").when(~flag & (F.col(y) == 0), "TN")
             .when(flag, "FP").otherwise("FN"))
    return (df.select(id, y, p, label.alias("outcome"))
            .join(other.select(id, F.col(p).alias("other_pred")), id, "left")
            .orderBy(F.col(p).desc(), id))


def bootstrap_average_precision(cells: DataFrame, score: str, n_boot: int, *, y: str = "y_true", n: str = "n") -> DataFrame:
    """(replicate, ap) over rows in bulk: ``cells`` has a score, a label, a number of equal rows and two hash words each.

    Cells are dealt by ranges of the score and written once. A first pass sums each replicate's weights per range, a
    second one draws the same weights again and adds up precision times recall steps from the sums of the ranges above.
    """
    dealt = materialised(cells.repartitionByRange(F.col(score).desc()).sortWithinPartitions(F.col(score).desc())
                         .withColumn("_range", F.spark_partition_id()))
    replicates, schema = np.arange(n_boot), "_range int, replicate int, pos long, n long"

    def drawn(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        a, b, times, label = (np.array(batch.column(c), np.int64) for c in ("_h0", "_h1", n, y))
        w = poisson_draws(a, b, times, replicates)
        return w * label[:, None], w

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            ranges = np.array(batch.column("_range"))
            for r in np.unique(ranges).tolist():
                own = batch.filter(pa.array(ranges == r))
                for k in range(0, own.num_rows, 1000):
                    found[r] = found.get(r, 0) + np.stack([x.sum(0) for x in drawn(own.slice(k, 1000))])
        for r, total in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n_boot, r, np.int32)), pa.array(replicates.astype(np.int32)), *map(pa.array, total)],
                                             ["_range", "replicate", "pos", "n"])

    each = dealt.mapInArrow(sums, schema).groupBy("_range", "replicate").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    rows = each.orderBy("_range", "replicate").toArrow()  # a row per range and replicate
    order = sorted(set(rows.column("_range").to_pylist()))
    table = np.stack([np.array(rows.column(c)) for c in ("pos", "n")]).reshape(2, len(order), n_boot) if order else np.zeros((2, 0, n_boot), np.int64)
    above = {r: x for r, x in zip(order, np.moveaxis(np.cumsum(table, axis=1) - table, 1, 0), strict=True)}
    shared = cells.sparkSession.sparkContext.broadcast(above)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shares of the ranges in a task, from their cells in order; a score's cells may lie in two batches."""
        at, last, share = None, None, np.zeros(n_boot)
        before = open_ = np.zeros((2, n_boot), np.int64)  # all scores above the open one; the open one so far

        def close(groups: np.ndarray) -> None:
            nonlocal before, share
            upto = before[:, None] + np.cumsum(groups, axis=1)
            share += (groups[0] * upto[0] / np.maximum(upto[1], 1)).sum(0)
            before = upto[:, -1]

        for batch in batches:
            ranges = np.array(batch.column("_range"))
            for r in dict.fromkeys(ranges.tolist()):
                if r != at:
                    close(open_[:, None])
                    at, last, before, open_ = r, None, shared.value[r], np.zeros((2, n_boot), np.int64)
                own = batch.filter(pa.array(ranges == r))
                for k in range(0, own.num_rows, 1000):
                    part = own.slice(k, 1000)
                    p = np.array(part.column(score), float)
                    heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                    groups = np.stack([np.add.reduceat(x, heads, axis=0) for x in drawn(part)])
                    if p[0] == last:
                        groups[:, 0] += open_
                    else:
                        close(open_[:, None])
                    if len(heads) > 1:
                        close(groups[:, :-1])
                    open_, last = groups[:, -1], p[-1]
        close(open_[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(replicates.astype(np.int32)), pa.array(share)], ["replicate", "share"])

    ordered = dealt.repartition("_range").sortWithinPartitions("_range", F.col(score).desc())
    shares = ordered.mapInArrow(steps, "replicate int, share double").groupBy("replicate").agg(F.sum("share").alias("share"))
    whole = each.groupBy("replicate").agg(F.sum("pos").alias("pos"))
    return shares.join(whole, "replicate").select("replicate", F.when(F.col("pos") > 0, F.col("share") / F.col("pos")).alias("ap"))


def bootstrap_ap_ci(pairs: DataFrame, *, y: str = "y_true", n_boot: int = 2000,
                    seed: str = "boot") -> DataFrame:
    """Mean and 2.5/97.5 percentiles of average precision for two models and their paired difference.

    ``pairs`` has ``p_a``, ``p_b`` and the label; both models see the same weights. Rows alike in all three are one cell
    with one draw per replicate (see ``poisson_draws``), so the cost follows the distinct score pairs, not the rows.
    """
    cells = pairs.groupBy("p_a", "p_b", y).agg(F.count("*").alias("n"))
    exact = [F.floor(F.col(c) * 2.0**53) for c in ("p_a", "p_b")]  # any engine's text of these whole numbers is the same
    cells = materialised(cells.select("*", *hash_words(seed, [*exact, y])))
    ap_a, ap_b = (bootstrap_average_precision(cells, f"p_{m}", n_boot, y=y).withColumnRenamed("ap", f"ap_{m}") for m in ("a", "b"))
    both = ap_a.join(ap_b, "replicate")
    both = both.withColumn("diff", F.col("ap_a") - F.col("ap_b"))
    # one row per replicate: an exact percentile over n_boot values is small
    return both.agg(*[f for c in ("ap_a", "ap_b", "diff") for f in (
        F.avg(c).alias(f"{c}_mean"), F.expr(f"percentile({c}, 0.025)").alias(f"{c}_low"),
        F.expr(f"percentile({c}, 0.975)").alias(f"{c}_high"))])
