import re
from collections import Counter
from math import floor, log

from pyspark.sql import functions as F

from tabsight.llm.queries import URL_RULES
from tabsight.llm.url_filter import gram_scores, host_of, judge, matched_rule, path_of, threshold

URLS = ["https://WWW.Example.com/en/1?q#f", "http://a.example.com/en/", "http://example.com", "http://example.com/en", "ftp://notexample.com/x", "x://net/es/1",
        "x://b.net/fr/?a", "x://b.net/de/#a", "x://h?q/a", "x://h#f", "no scheme/com/", "", None, "a://b://c/d", "http://É.com/É", "x:///en/", "x://com/", "x://org/é?"]


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host):])[0]


def best(host, path):
    fits = [r for _, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits, key=len, default=None)


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string").withColumns({"host": host_of(F.coalesce("url", F.lit(""))), "path": path_of(F.coalesce("url", F.lit("")))})
    for r in df.withColumn("rule", matched_rule(URL_RULES)).collect():
        assert (r["host"], r["path"]) == parts(r["url"])
        assert r["rule"] == best(*parts(r["url"]))


def test_chances_against_brute_force(spark):
    texts = {"banana": (3, 1), "bandana": (1, 0), "cabana": (0, 4), "é": (1, 2)}
    grams = [(("\x02" * 4 + t + "\x03")[i: i + 5], a, b) for t, (a, b) in texts.items() for i in range(len(t) + 1)]

    def chance(gram, which):
        p = 1 / 256
        for k in range(5):
            ctx = gram[4 - k: 4]
            same = [(g[4], n[which]) for g, *n in grams if g[4 - k: 4] == ctx and n[which]]
            total = sum(n for _, n in same)
            if total:
                kinds = len({c for c, _ in same})
                p = (sum(n for c, n in same if c == gram[4]) + kinds * p) / (total + kinds)
        return p

    df = spark.createDataFrame(grams, "gram string, accepted long, rejected long").groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    got = {r["gram"]: r["ratio"] for r in gram_scores(df).collect()}
    assert got == {g: floor((log(chance(g, 0)) - log(chance(g, 1))) * 1e6 + 0.5) for g, *_ in grams}


def test_threshold(spark):
    df = spark.createDataFrame([(50_000.0, "allow"), (30_000.0, "allow"), (-90_000.0, "block"), (10_000.0, "block")], "mean double, judged string")
    assert threshold(df) == 1
    assert threshold(df.filter("judged = 'allow'")) == 0


def test_learns_from_rules(spark):
    rows = [(i, f"https://good{i % 9}.com/en/page{i}", "clash") for i in range(200)] + [(1000 + i, f"https://x.net/es/spamcasino{i}", "c") for i in range(200)]
    rows += [(2000, "https://a.org/en/page9", ""), (2001, "https://a.org/es/spamcasino5", "")]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(rows, "page_id long, url string, host string"), URL_RULES).collect()}
    assert got[2000]["verdict"] == "allow" and got[2001]["verdict"] == "block" and got[2000]["rule"] is None
    assert all(got[k]["verdict"] == ("allow" if k < 1000 else "block") for k in got if k < 2000)


def test_awkward_rows(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "x://org/a"), (3, URLS[3]), (50, "x://org/" + "ab" * 60_000)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(r["verdict"] in ("allow", "block") and r["score"] is not None for r in got)
    assert judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0
