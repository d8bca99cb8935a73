import os
import zlib

import numpy as np
import pytest

from tabsight.llm import additive_model
from tabsight.llm.additive_model import FEATURES, classify, features, fit
from tests.compare import ROOT
from tests.llm.edge import SCHEMA, awkward


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def as_bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_features_do_not_depend_on_neighbours():
    texts = ["a b a\na b a\nx", "", "Ä Ä Ä!", " \n ", "b b # | 12 b", "a b a\na b a\nx"]
    together = features(*as_bytes(texts))
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(features(*as_bytes([t]))[0], row)
    named = dict(zip(FEATURES, together[0], strict=True))
    assert named["distinct"] == 3 / 7 and named["distinct_triples"] == 4 / 5 and abs(named["dup_lines"] - 1 / 3) < 1e-12
    assert dict(zip(FEATURES, together[2], strict=True))["again"] == 1 / 3


def test_pairs_learn_what_sums_cannot():
    rnd = np.random.default_rng(0)
    x = rnd.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    flat = fit(x[:3000], y[:3000], pairs=0)
    paired = fit(x[:3000], y[:3000])
    assert auc(y[3000:], flat.score(x[3000:])) < 0.65 < 0.95 < auc(y[3000:], paired.score(x[3000:]))
    assert (0, 1) in paired.pairs


def test_tables_are_all_there_is():
    rnd = np.random.default_rng(1)
    x = rnd.random((500, 2))
    model = fit(x, (x[:, 0] > 0.3).astype(float))
    row = x[7]
    z = model.base + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(model.tables, model.edges, row, strict=True))
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        z += t[np.searchsorted(model.pair_edges[i], row[i], "right"), np.searchsorted(model.pair_edges[j], row[j], "right")]
    assert np.isclose(model.score(x)[7], 1 / (1 + np.exp(-z)))


def test_awkward_rows(spark):
    rows = awkward()
    labels = spark.createDataFrame([(i, i % 2, "clash") for i in range(60)] + [(1, None, None), (None, 1, None)], "doc_id long, quality int, n string")
    got = classify(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.3) for g in got)
    for g in got:
        assert g["held_out"] == (g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0)
    none = classify(spark.createDataFrame(rows, SCHEMA), labels.limit(0)).collect()
    assert {g["score"] for g in none} == {0.5}
    assert classify(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = [r for r in awkward() if r[0] is not None]
    a = [(r[0], r[0] % 2) for r in rows]
    b = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q) for d, q in a]
    docs = spark.createDataFrame(rows, SCHEMA)
    one, two = (sorted(map(tuple, classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())) for x in (a, b))
    assert one == two


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{ROOT}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    y, s = np.array([g["quality"] for g in got]), np.array([g["score"] for g in got])
    assert auc(y, s) > 0.95
    assert additive_model.SAMPLE >= 10_000
