import hashlib
from collections import defaultdict

import pytest

from tabsight.llm.block_naming import LOWER, UPPER, duplicates
from tests.llm.edge import SCHEMA, awkward


def brute(rows):
    groups = defaultdict(list)
    for k, (doc, text, *_) in enumerate(rows):
        groups[(text or "").translate(str.maketrans(UPPER, LOWER))].append((doc is not None, doc or 0, k, doc))
    out = []
    for text, own in groups.items():
        top = max(own)
        for x in own:
            out.append((x[3], top[3], len(own), x[:2] == top[:2], hashlib.sha256(text.encode()).hexdigest()))
    return out


def fixture():
    rows = awkward(40)
    long = "Lorem Ünder " * 900
    rows += [(2000 + i, long + str(i % 3), "n", None) for i in range(9)]
    rows += [(2100, long[:-1], "n", None), (2101, long.upper(), "", ""), (2102, long, "", ""), (2103, "É", "", ""), (2104, "é", "", "")]
    rows += [(3000 + i, "A hot text" if i % 2 else "a HOT text", "n", "p") for i in range(300)]
    return rows


@pytest.mark.parametrize("block", [1, 7, 64, 2048])
def test_against_brute_force(spark, block):
    rows = fixture()
    if block < 7:  # a name per byte: shorter texts, as many levels as the others
        rows = [r if r[1] is None else (r[0], r[1][:90], *r[2:]) for r in rows]
    got = [tuple(r) for r in duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block).collect()]
    key = lambda r: tuple(str(x) for x in r)
    ties = {(r[0], r[4]) for r in got if sum(x[0] == r[0] and x[4] == r[4] for x in got) > 1}
    plain = [r for r in got if (r[0], r[4]) not in ties]
    assert sorted(plain, key=key) == sorted([r for r in brute(rows) if (r[0], r[4]) not in ties], key=key)
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in got:
        groups[r[4]].append(r)
    assert all(sum(r[3] for r in g) == 1 for g in groups.values())  # also where rows with one id and text are repeated


def test_empty_table(spark):
    out = duplicates(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0
