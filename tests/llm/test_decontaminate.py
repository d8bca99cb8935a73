import random
import re

import pytest

import corpus_pipeline
from tabsight.llm.decontaminate import clean, decontaminate, is_contaminated
from tabsight.llm.queries import ORACLES, QUERIES
from tests.compare import compare
from tests.llm.edge import SCHEMA, awkward

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def fixture():
    rnd = random.Random(3)
    words = ["Über", "a", "b", "c1", "d", "ñ", "don't", "x-y", "é"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, " ?! "), (103, items[0][1]), (104, "single"), (None, "a b")]
    docs = [(1000 + i, " ".join(["w%d" % rnd.randint(0, 99) for _ in range(rnd.randint(0, 30))] + [rnd.choice(items)[1] or "", "Single" if i % 7 == 0 else "z"]
                                + ["v%d" % rnd.randint(0, 99) for _ in range(rnd.randint(0, 60))]).upper() + "\n", "n", "p") for i in range(60)]
    return docs + awkward(), items


def brute(text, items):
    found = [(m.start(), m.end(), m[0]) for m in WORD.finditer(lower(text))]
    words = [w for _, _, w in found]
    hit, own = set(), set()
    for item, body in items:
        w = WORD.findall(lower(body))
        if item is None or not w:
            continue
        n = min(13, len(w))
        grams = {tuple(w[k: k + n]) for k in range(len(w) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k: k + n]) in grams:
                hit.update(range(k, k + n))
                own.add(str(item))
    return len(words), len(hit), sorted(own), {c for k in hit for c in range(*found[k][:2])}


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_against_brute_force(spark, block):
    docs, items = fixture()
    got = decontaminate(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).withColumn("c", is_contaminated()).collect()
    by_text = {}
    for d in docs:
        by_text[d[0]] = brute(d[1], items)
    assert len(got) == len(docs)
    for g in got:
        n_words, n_hit, own, chars = by_text[g["doc_id"]]
        assert (g["n_words"], g["n_hit"], sorted(g["items"])) == (n_words, n_hit, own)
        assert g["c"] == (n_hit > 0 and 20 * n_hit >= n_words)
        inside = {c for s in g["spans"] for c in range(s["start"], s["end"])}
        assert chars <= inside and bool(chars) == bool(inside)
    assert sum(g["n_hit"] > 0 for g in got) > 10


def test_empty_tables(spark):
    docs = spark.createDataFrame(awkward(5), SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate(docs, none).collect()} == {0}
    assert decontaminate(docs.limit(0), none).count() == 0


def test_clean_rows_keep_all_their_columns(spark):
    docs, items = fixture()
    frame = spark.createDataFrame(docs, SCHEMA).withColumnRenamed("n", "a column, with `marks`")
    got = clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == frame.columns
    want = sorted(map(str, (d for d in docs if not (lambda n, hit, *_: hit > 0 and 20 * hit >= n)(*brute(d[1], items)))))
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_items_without_an_id_are_hit_as_the_sql_has_it(spark, tmp_path):
    import duckdb

    docs, items = fixture()
    items += [(None, items[1][1]), (None, "only here"), (None, None)]
    docs = docs[:60] + [(5000, "x only here y", "n", "p"), (5001, "a plain text", "n", "p")]
    spark.createDataFrame(docs, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    name = "op9_decontamination"
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], str(tmp_path)) == []
    got = {r["doc_id"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert (got[5000]["n_hit"], got[5000]["n_items"], got[5000]["contaminated"]) == (2, 1, True)
    kept = {r["doc_id"] for r in corpus_pipeline.benchmark(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert kept == {k for k, r in got.items() if not r["contaminated"]} and 5000 not in kept
