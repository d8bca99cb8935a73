"""Itemsets and rules, against brute force and Spark's own FP-growth."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from tabsight.operators import itemsets as S
from tabsight.operators import rules as R


def brute(baskets, min_support, max_len):
    items = sorted({i for b in baskets for i in b})
    out = {}
    for k in range(1, max_len + 1):
        for s in combinations(items, k):
            n = sum(set(s) <= set(b) for b in baskets)
            if n and n / len(baskets) >= min_support:
                out[s] = n
    return out


@pytest.fixture(scope="module")
def baskets():
    rng = np.random.default_rng(7)
    out = [[f"i{j}" for j in range(7) if rng.random() < 0.25 + 0.05 * j] for _ in range(250)]
    # a third of the rows are one and the same basket, and some are empty
    return out + [["i1", "i2", "t"]] * 125 + [[]] * 10


@pytest.fixture(scope="module")
def frame(spark, baskets):
    return spark.createDataFrame([(i, i % 2, b) for i, b in enumerate(baskets)], "id long, g int, items array<string>")


@pytest.mark.parametrize("support,size", [(0.05, 3), (0.02, 4), (0.3, 4)])
def test_frequent_itemsets_match_brute_force(frame, baskets, support, size):
    got = {tuple(r["items"]): r["count"] for r in
           S.frequent_itemsets(frame, min_support=support, max_len=size).collect()}
    assert got == brute(baskets, support, size)


def test_frequent_itemsets_match_fpgrowth(frame):
    ours = {tuple(r["items"]): r["count"] for r in S.frequent_itemsets(frame, min_support=0.05, max_len=4).collect()}
    fp = FPGrowth(itemsCol="items", minSupport=0.05).fit(frame).freqItemsets.collect()
    assert ours == {tuple(sorted(r["items"])): r["freq"] for r in fp if len(r["items"]) <= 4}


def test_grouped_itemsets_match_each_group(frame, baskets):
    got = S.frequent_itemsets(frame, by=["g"], min_support=0.1, max_len=3).collect()
    for g in (0, 1):
        mine = {tuple(r["items"]): r["count"] for r in got if r["g"] == g}
        assert mine == brute([b for i, b in enumerate(baskets) if i % 2 == g], 0.1, 3)


def test_long_baskets_and_many_copies(spark):
    rng = np.random.default_rng(8)
    kinds = [sorted(rng.choice(240, 200, replace=False).tolist()) for _ in range(40)]
    times = [1, 2, 3, 5, 64, 1000] + [1] * 34
    baskets = [[f"i{j:03d}" for j in k] for k, n in zip(kinds, times) for _ in range(n)]
    frame = spark.createDataFrame(list(enumerate(baskets)), "id long, items array<string>")
    got = {tuple(r["items"]): r["count"] for r in S.frequent_itemsets(frame, min_support=0.97, max_len=2).collect()}
    has = np.array([[f"i{j:03d}" in set(f"i{x:03d}" for x in k) for j in range(240)] for k in kinds])
    support = (has * np.array(times)[:, None]).astype(np.int64).T @ has.astype(np.int64)
    names, low = [f"i{j:03d}" for j in range(240)], 0.97 * len(baskets)
    want = {(names[a],): int(support[a, a]) for a in range(240) if support[a, a] >= low}
    want |= {(names[a], names[b]): int(support[a, b]) for a in range(240) for b in range(a + 1, 240) if support[a, b] >= low}
    assert got == want and len(got) > 100


def test_subset_pairs_match_brute_force(spark):
    rng = np.random.default_rng(2)
    sets = {tuple(sorted(rng.choice(list("abcdefgh"), rng.integers(1, 7), replace=False).tolist())) for _ in range(120)}
    rows = [(g, list(s)) for g in (None, 1) for s in sets]
    df = spark.createDataFrame(rows, "g int, big array<string>")
    got = sorted((str(r["g"]), tuple(r["big"]), tuple(r["small"])) for r in R.subset_pairs(df, df.withColumnRenamed("big", "small"), ["g"], "big", "small").collect())
    assert got == sorted((str(g), a, b) for g in (None, 1) for a in sets for b in sets if set(b) < set(a))


def test_antecedents_of_any_length_are_pruned(spark):
    long = [f"i{j:02d}" for j in range(40)]
    rules = spark.createDataFrame([(long, ["t"], 0.1, 0.7, 1.4), (long[:30], ["t"], 0.2, 0.8, 1.5), (long[10:], ["t"], 0.3, 0.6, 1.2),
                                   (long[:24], ["t"], 0.1, 0.6, 1.1), (long[:23], ["u"], 0.9, 0.9, 1.9)], RULE)
    assert sorted(len(r["antecedents"]) for r in R.prune_rules(rules).collect()) == [23, 24, 30, 30]


def test_general_rules_match_brute_force(frame, baskets):
    n = len(baskets)
    freq = brute(baskets, 0.1, 3)
    want = {}
    for s, c in freq.items():
        for k in range(1, len(s)):
            for a in combinations(s, k):
                rest = tuple(i for i in s if i not in a)
                lift = (c / n) / (freq[a] / n) / (freq[rest] / n)
                if lift >= 1.1:
                    want[(a, rest)] = lift
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])): r["lift"] for r in
           R.general_rules(S.frequent_itemsets(frame, min_support=0.1, max_len=3)).collect()}
    assert got == pytest.approx(want) and want


def test_target_rules_and_metrics(spark):
    rows = [["a", "t"]] * 4 + [["a"]] * 2 + [["t"]] * 2 + [["b", "t"]] * 2
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, items array<string>")
    rules = R.target_rules(S.frequent_itemsets(df, min_support=0.1), "t", 0.5)
    got = {tuple(r["antecedents"]): r for r in R.rule_metrics(rules).collect()}
    a, b = got[("a",)], got[("b",)]
    assert (a["support"], a["confidence"]) == pytest.approx((0.4, 2 / 3))
    assert a["lift"] == pytest.approx((2 / 3) / 0.8) and a["leverage"] == pytest.approx(0.4 - 0.6 * 0.8)
    assert a["conviction"] == pytest.approx(0.2 / (1 / 3)) and a["jaccard"] == pytest.approx(0.4 / 1.0)
    assert a["zhangs_metric"] == pytest.approx((0.4 - 0.48) / max(0.4 * 0.4, 0.6 * 0.4))
    assert b["confidence"] == 1.0 and b["conviction"] is None and b["certainty"] == pytest.approx(1.0)


RULE = "antecedents array<string>, consequents array<string>, support double, confidence double, lift double"


def test_pruning_drops_only_dominated_supersets(spark):
    rules = spark.createDataFrame([
        (["a"], ["t"], 0.3, 0.7, 1.4), (["a", "b"], ["t"], 0.2, 0.69, 1.38), (["a", "c"], ["t"], 0.2, 0.8, 1.6),
        (["b"], ["t"], 0.1, 0.6, 1.2), (["d"], ["u"], 0.1, 0.6, 1.2)], RULE)
    got = {tuple(r["antecedents"]) for r in R.prune_rules(rules).collect()}
    assert got == {("a",), ("a", "c"), ("b",), ("d",)}


def test_ranking_formula_and_constant_metric(spark):
    rules = spark.createDataFrame([(["a"], ["t"], 0.2, 0.7, 1.4), (["b"], ["t"], 0.2, 0.6, 1.2),
                                   (["c"], ["t"], 0.2, 0.65, 1.3)], RULE)
    got = {r["antecedents"][0]: r["rank_score"] for r in R.rank_rules(rules).collect()}
    assert got["a"] == pytest.approx(1.0)
    assert got["c"] == pytest.approx(1.0 / (0.5 / 0.5 + 0.3 / 0.5 + 0.2))
    assert got["b"] == pytest.approx(0.0, abs=1e-8)
    assert [r["antecedents"][0] for r in R.top_rules(R.rank_rules(rules), 2).collect()] == ["a", "c"]


def test_stability_separates_solid_from_marginal_rules(spark):
    rows = [["a", "t"]] * 90 + [["a"]] * 10 + [["b", "t"]] * 3 + [["b"]] * 3 + [["x"]] * 100
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, items array<string>")
    rules = R.target_rules(S.frequent_itemsets(df, min_support=0.01), "t", 0.5)
    out = R.rule_stability(rules, df, target_item="t", n_boot=40, min_support=0.01, min_confidence=0.6)
    got = {r["antecedents"][0]: r["stability"] for r in out.collect()}
    assert got["a"] == 1.0 and 0.0 < got["b"] < 0.8


def test_min_active_uses_raw_scores_for_short_rows(spark):
    df = spark.createDataFrame([(1, "x", 0.9, 0), (1, "y", 0.8, 0), (1, "z", 0.1, 0), (2, "x", 0.1, 1), (2, "y", 0.2, 1),
                                (2, "z", 0.9, 0)], "id long, feature string, score double, active int")
    got = {(r["id"], r["feature"]): r["active"] for r in S.min_active_items(df, 2).collect()}
    assert got == {(1, "x"): 1, (1, "y"): 1, (1, "z"): 0, (2, "x"): 1, (2, "y"): 1, (2, "z"): 0}


def test_normalise_and_threshold(spark):
    df = spark.createDataFrame([(i, "x", float(i)) for i in range(5)] + [(i, "nil", 0.0) for i in range(5)],
                               "id long, feature string, score double")
    mx = {(r["id"], r["feature"]): r["norm"] for r in S.score_normalise(df, "max").collect()}
    assert mx[(4, "x")] == 1.0 and mx[(1, "x")] == 0.25 and mx[(1, "nil")] == 0.0
    z = [r["norm"] for r in S.score_normalise(df, "zscore").filter("feature = 'x'").orderBy("id").collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    active = S.binarize_scores(S.score_normalise(df, "none"), "p75").filter("feature = 'x' AND active = 1")
    assert sorted(r["id"] for r in active.collect()) == [3, 4]


def test_rule_tables(spark):
    rules = spark.createDataFrame([(["a", "b"], ["t"], 0.2, 0.62, 1.4), (["a"], ["t"], 0.4, 0.68, 1.2)], RULE)
    assert {r["item"]: r["rules"] for r in R.rule_item_freq(rules).collect()} == {"a": 2, "b": 1}
    edges = {r["item"]: r["mean_lift"] for r in R.rule_edges(rules).collect()}
    assert edges == pytest.approx({"a": 1.3, "b": 1.4})
    assert R.rule_stats(rules).first()["rules"] == 2
    assert [r["note"] for r in R.weakest_rules(rules).collect()] == ["check", "careful"]
    assert R.filter_rules(rules, min_support=0.3).count() == 1
    big = spark.createDataFrame([(1, "g", ["a"])] * 3 + [(2, "h", ["a"])] + [(3, None, ["a"])] * 9,
                                "id long, c string, items array<string>")
    assert {r["c"] for r in R.large_groups(big, ["c"], 2).collect()} == {"g"}
    assert S.itemset_quality(big.withColumn("y", F.lit(1)), target="y").first()["rows"] == 13
