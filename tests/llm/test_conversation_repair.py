import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import types as T

from tabsight.llm.conversation_repair import cheapest_edits, damaged, edits, repaired
from tabsight.llm.queries import QUERIES

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("key", T.StringType())])
WHITE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(case, text)
            out += [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def brute_best(rows):
    """Cost and least edits by dynamic programming over all edit sequences; rows are (role, fault)."""
    pattern = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(k, state, inserts):
        options = [(0, "")] if k == len(rows) and state in ("", "a") else []
        legal = pattern[state]
        if inserts < 3:
            options += [(3 + c, "I" + p) for r in "ua" if r in legal for c, p in [best(k, r, inserts + 1)]]
        if k < len(rows):
            role, fault = rows[k]
            c, p = best(k + 1, state, 0)
            options.append((4 + c, "D" + p))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in legal:
                    c, p = best(k + 1, role[0], 0)
                    options.append((more + c, "K" + p))
                for r in "ua":
                    if r in legal:
                        c, p = best(k + 1, r, 0)
                        options.append((3 + more + c, "R" + p))
        return min(options, default=(10**9, "~"))

    return best(0, "", 0)


def brute(rows):
    convs = {r[0]: [] for r in rows}
    for r in brute_damage(rows):
        convs[r[0]].append(r[1:])
    out = []
    for conv, own in convs.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = brute_best(tuple((role, f) for (_, role, _), f in zip(own, faults))) if own else (0, "")
        lines, k, last = [], 0, ""
        for e in audit:
            role, text = own[k][1:] if e != "I" else ("", "")
            k += e != "I"
            if e == "D":
                continue
            if e in "IR":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=str)


def fixture():
    rnd = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut off", "  ", "", None, "Done. \n", "über.", "x" * 5000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"]
    rows = []
    for conv in range(150):
        for turn in range(rnd.randint(1, 9)):
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 3]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"text {turn} {conv}."))
    rows += [(1000, t, ["user", "assistant"][t % 2], f"turn {t % 40}.") for t in range(200)]  # long, with many repeats
    rows += [(1001, t, rnd.choice(roles), f"turn {t}" + rnd.choice([".", ""])) for t in range(180)]
    rows += [(None, t, "user", "null id.") for t in range(4)] + [(1002, None, "user", None)]
    one_of = {}
    for r in rows:  # rows of one turn with different contents are ordered by digest; a few stay in
        one_of.setdefault((r[0], r[1]), []).append(r)
    return rows + [one_of[(1000, 3)][0]] * 3


def as_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)


def test_search_against_dynamic_programming():
    rnd = random.Random(1)
    names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    for n in [0, 1, 2, 3, 5, 8, 13, 33, 70]:
        for segment in (3, 32):
            for _ in range(20):
                codes = bytes(rnd.choice([0, 1, 1, 2, 2, 3]) + 4 * rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
                rows = tuple(("suax"[c % 4], names[c // 4]) for c in codes)
                assert cheapest_edits(codes, segment) == brute_best(rows)


def test_query_against_brute_force(spark, tmp_path):
    rows = fixture()
    as_table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_repaired_rows_are_in_order(spark):
    rows = damaged(as_table(spark, fixture()))
    out = repaired(rows, edits(rows)).toPandas()
    for _, own in out.groupby("conv_id", dropna=False):
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in own.sort_values("place")["role"]))
        assert sorted(own["place"]) == list(range(len(own)))


@pytest.mark.parametrize("rows", [[], [(7, 0, "user", None)]])
def test_empty_and_blank(spark, rows):
    table = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = [tuple(r) for r in edits(table).collect()]
    assert got == [(7, 0, 1, 0, 0, 0, 4, "D")][: len(rows)]
