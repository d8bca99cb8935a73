import itertools
import pickle
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import types as T

from tabsight.llm.filter_audit import FILTERS, _combined, _deltas, audit, mask_counts, own_mask

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("mask", T.StringType()), T.StructField("part", T.StringType())])
LABELS = "doc_id long, quality int, toxic int, part string"


def fixture():
    long = " ".join(f"word{i} Über" for i in range(150))
    texts = [None, "", " \t\n", "SHORT $ text", long, long, long + " & more", "WORD " * 120, " ".join(f"W{i}" for i in range(130)), long.upper(), "a\x00b é" * 70]
    rows = [((i * 37) % 101, texts[i % len(texts)], ["en", "de", None, ""][i % 4], "m", "p") for i in range(100)]
    rows += [(None, long, "en", "m", "p"), (None, long, "en", "m", "p"), (-5, long, "fr", "m", "p"), (-5, long, "fr", "m", "p"), (-5, long, "en", "m", "p"), (4, "x " * 40_000, "en", "", "")]
    labels = [(i, i % 2, int(i % 5 == 0), "p") for i in range(0, 101, 3)] + [(6, 1, 1, "p"), (-5, 1, 0, "p"), (None, 1, 1, "p")]
    return rows, labels


def brute(rows, labels):
    masks = []
    for doc, text, lang, *_ in rows:
        text = text or ""
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 bool(re.search("[#$%&*|]", text)), doc is not None and any(o is not None and o < doc and (t or "") == text for o, t, *_ in rows)]
        own = [x for x in labels if x[0] == doc and doc is not None]
        masks.append((lang or "", {f for f, x in zip(FILTERS, fails) if x}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {m[0] for m in masks}:
        shapley = Counter()
        for order in itertools.permutations(FILTERS):
            left = [m for m in masks if m[0] == part]
            seen = []
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                shapley[f] += len(gone)
                redundant = sum(f in m[1] and bool(m[1] & set(seen)) for m in masks if m[0] == part)
                alone = sum(m[1] == {f} for m in masks if m[0] == part)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(m[2] for m in gone), sum(m[3] for m in gone)]
                seen.append(f)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("files, batches, texts", [(7, 7, 200), (3, 2, 1), (1, 4, 9)])
def test_against_brute_force(spark, tmp_path, files, batches, texts):
    rows, labels = fixture()
    rows.sort(key=lambda r: -(r[0] or 0))  # the smallest ids arrive last
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, DOCS).coalesce(1).repartition(files).write.parquet(path)
    got = audit(mask_counts(spark, path, spark.createDataFrame(labels, LABELS), batches=batches, texts_per_key=texts)).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute(rows, labels)


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_smaller_ids_retract(spark):
    state, total = State(), Counter()
    for k, (low, at, rest) in enumerate([(50, 1, 3), (70, 1, 0), (20, 2, 1), (20, 1, 0), (None, 2, 0), (10, 1, 0)]):
        frame = pd.DataFrame([(b"x", 3, "en", 1, 0, low, at, rest)], columns=["digest", "mask", "part", "good", "toxic", "low", "at_low", "rest"])
        other = pd.DataFrame([(b"y", 5, "en", 0, 0, 7 + k, 1, 0)], columns=frame.columns)
        for out in _deltas((0,), iter([frame, other]), state):
            for r in out.itertuples():
                total[r.mask] += r.delta
        assert total[3] + total[19] > 0
    assert total == {3: 3, 19: 1 + 3 + 1 + 2 + 1 + 1, 5: 1, 21: 5}  # id 10 and the two unknown ids pass
    assert {k: low for k, (low, _) in pickle.loads(state.get[0]).items()} == {b"x": 10, b"y": 7}


def test_rows_of_a_batch_are_combined(spark):
    rows = [(k, "en", b"x", 1, 0, 0) for k in range(500, 0, -1)] + [(None, "en", b"x", 1, 0, 0)] * 3
    table = spark.createDataFrame(rows, "doc long, part string, digest binary, mask int, good int, toxic int").coalesce(1)
    got = sorted((r["low"] or -1, r["at_low"], r["rest"]) for r in _combined(table).collect())
    assert got == [(-1, 3, 0), (1, 1, 499)]


def test_masks():
    assert own_mask(b"") == 1 and own_mask(b"A $") == 1 + 4 + 8 and own_mask(b"a " * 200) == 2


def test_empty_table(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([], DOCS).write.parquet(path)
    assert audit(mask_counts(spark, path, spark.createDataFrame([], LABELS))).count() == 0
