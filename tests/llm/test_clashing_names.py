"""Row-level forms keep columns that are named like their own."""

import pytest
from pyspark.sql import functions as F

from tabsight.llm.jaccard_join import one_of_each
from tabsight.llm.quality_rules import keep_good
from tabsight.llm.substring_dedup import trimmed

NAMES = ["__rows", "__key", "__id", "__tkey", "__blank", "__number", "__row", "__at", "_x", "___row", "kept", "rule", "n_words", "id", "tkey", "body", "rows", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"word{i}" for i in range(70))
    rows = [(i, text if i % 3 == 0 else f"{text} other{i} " + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(12)] + [(3, text), (50, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


@pytest.mark.parametrize("form", [trimmed, one_of_each, lambda d: keep_good(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))])
def test_clashing_names(docs, form):
    out = form(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES)
    plain = form(docs.select("doc_id", "text"))
    assert sorted((r["doc_id"], r["text"] or "") for r in rows) == sorted((r["doc_id"], r["text"] or "") for r in plain.collect())
