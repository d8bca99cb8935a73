"""Run registered queries next to their SQL text in DuckDB and compare names, types and values.

Usage: python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, f"{v + 0.0:.6f}")
    return (1, str(v))


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> list[str]:
    """Problems found for one query; empty when everything agrees."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return []
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want_types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(want_cols):
        return [f"columns {sorted(df.columns)} != {sorted(want_cols)}"]
    for f, t in df.dtypes:
        if TYPES.get(t, t).upper() != want_types[f].upper() and t in TYPES:
            problems.append(f"type of {f}: {t} vs {want_types[f]}")
    order = sorted(df.columns)
    gi, wi = [df.columns.index(c) for c in order], [want_cols.index(c) for c in order]
    a = sorted(tuple(_key(r[i]) for i in gi) for r in got)
    b = sorted(tuple(_key(r[i]) for i in wi) for r in want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ, columns {order}")
        problems.extend(f"   spark {tuple(v[1] for v in x)}\n    duck {tuple(v[1] for v in y)}" for x, y in bad[:3])
    if not a:
        problems.append("no rows")
    return problems


def main(argv: list[str]) -> int:
    from tests.conftest import build_session
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else f"{ROOT}/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark, con = build_session(), duck(sf_dir)
    failed = 0
    for name in names:
        t = time.time()
        try:
            problems = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as e:  # report and go on to the next query
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        failed += bool(problems)
        mark = "FAIL" if problems else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name} {time.time() - t:.2f}s", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{len(names) - failed}/{len(names)} good")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
