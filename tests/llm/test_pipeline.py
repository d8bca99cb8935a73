"""The pipeline stage by stage next to brute-force versions, on the smallest tables."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tabsight.llm.quality_rules import judge
from tabsight.llm.queries import byte_bpe
from tests.compare import ROOT
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard import brute_classes
from tests.llm.test_quality_rules import base
from tests.llm.test_repeats import brute_words

DIR = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    columns = docs.columns
    rows = {}
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], DIR).cache())
        rows[name] = tables[-1].collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tables[-1].columns == columns
    start, good, unique, cut, clean = (t.collect() for t in tables[:5])

    fired = {r["doc_id"]: r["rule"] for r in judge(docs, labels).collect()}
    want = {r["doc_id"] for r in start if (s := base(r["text"]))[0] >= 50 and 100 * s[4] <= 50 * s[0] and fired[r["doc_id"]] is None}
    assert {r["doc_id"] for r in good} == want and 0 < len(want) < len(start)

    name = brute_classes([(r["doc_id"], r["text"]) for r in good])
    least = {}
    for r in good:
        least[name[r["text"]]] = min(least.get(name[r["text"]], r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in unique} == set(least.values())

    words = {w[0]: w for w in brute_words([(r["doc_id"], r["text"]) for r in unique], 13)}
    before = {r["doc_id"]: r["text"] for r in unique}
    assert {r["doc_id"]: r["text"] for r in cut} == {d: w[3] if w[2] else before[d] for d, w in words.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut)

    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    hits = {r["doc_id"]: brute_hits(r["text"], items) for r in cut}
    assert {r["doc_id"] for r in clean} == {d for d, (n, hit, *_) in hits.items() if not (hit > 0 and 20 * hit >= n)}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe())
    got, places = defaultdict(list), defaultdict(list)
    for p in rows["best-fit packing"]:
        got[p["doc_id"]].append((p["piece"], p["start"], p["length"], p["ids_crc32"]))
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for r in clean:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 0]
        at = 0
        for k, (piece, start_at, length, crc) in enumerate(sorted(got[r["doc_id"]])):
            assert (piece, start_at) == (k, at) and zlib.crc32(np.array(ids[at: at + length], "<u4").tobytes()) == crc
            at += length
        assert at == len(ids)
    assert set(got) == {r["doc_id"] for r in clean}
    assert all(sum(n for _, n in spots) <= 2048 for spots in places.values())

    assert Counter(map(tuple, corpus_pipeline.run(spark, DIR).select("doc_id", "piece", "length", "ids_crc32").collect())) == Counter(
        (p["doc_id"], p["piece"], p["length"], p["ids_crc32"]) for p in rows["best-fit packing"])
