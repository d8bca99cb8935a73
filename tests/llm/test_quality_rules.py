import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tabsight.llm.quality_rules import Condition, covers_any, decision, judge, learn, statistics
from tests.llm.edge import SCHEMA, awkward

SPACE = " \t\n\x0b\x0c\r"


def base(text):
    text = text or ""
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", text) if x]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    grams = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
    hit = {j for k in range(len(w) - 2) if grams[tuple(w[k: k + 3])] > 1 for j in range(k, k + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def rows():
    rnd = random.Random(2)
    words = ["alpha", "beta", "gämma", "delta", "éta", "zeta", "eta"] + ["w%d" % i for i in range(80)]
    out = []
    for i in range(300):
        body = [rnd.choice(words) for _ in range(rnd.randint(20, 150))]
        if i % 6 == 0:
            body = [x + "###" for x in body]
        if i % 6 == 1:
            body = [rnd.choice(words)] * 60
        out.append((10_000 + i, " ".join(body) + "\nsame\n \nsame", "n", "p"))
    return out + awkward(20)


def test_statistics_against_brute_force(spark):
    data = rows()
    got = Counter(tuple(r) for r in statistics(spark.createDataFrame(data, SCHEMA)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((r[0], *base(r[1])) for r in data)


def test_rules_reject_junk_and_keep_the_rest(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    labels = spark.createDataFrame([(r[0], 0 if (r[0] - 10_000) % 6 < 2 else 1, "clash") for r in data[:240]] + [(None, 0, "x"), (10_001, None, "x")], "doc_id long, quality int, n string")
    got = {r["doc_id"]: r for r in judge(docs, labels).collect() if r["doc_id"] is not None and r["doc_id"] >= 10_000}
    for i in range(300):
        r = got[10_000 + i]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and i % 6 >= 2), i
    assert any(r["rule"] for r in got.values())


def test_list_is_ordered_and_conditional(spark):
    a, b = (Condition("x", True, 5.0),), (Condition("x", True, 2.0), Condition("y", False, 1.0))
    df = spark.createDataFrame([(6, 0), (3, 0), (3, 2), (1, 1)], "x int, y int")
    assert [r[0] for r in df.select(decision([a, b])).collect()] == [1, 2, None, None]
    assert [r[0] for r in df.select(covers_any([a, b])).collect()] == [True, True, False, False]


def test_noise_gives_no_rules(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.rand(1).alias("a"), F.rand(2).alias("b"), (F.rand(3) < 0.8).cast("int").alias("y"))
    assert learn(df, "y", "doc_id", ("a", "b")) == []


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert judge(docs, labels).count() == 0
    assert judge(spark.createDataFrame(awkward(5), SCHEMA), labels).filter("kept and rule is not null").count() == 0
