"""Run a registered query beside its SQL twin and compare the results cell by cell.

As a script: ``python tests/oracle.py [folder] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    if isinstance(v, (list, tuple)):
        return repr([_cell(x) for x in v])
    if isinstance(v, dict):
        return repr({k: _cell(x) for k, x in v.items()})
    return repr(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "int64", "int": "int32", "smallint": "int16", "double": "double", "string": "str", "boolean": "bool", "date": "date"}
DUCK_KINDS = {"BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "DOUBLE": "double", "VARCHAR": "str", "BOOLEAN": "bool", "DATE": "date"}


def compare(spark, con, folder: str, query, text: str | None) -> tuple[str, float]:
    start = time.time()
    df = query(spark, folder)
    names = df.columns
    types = [KINDS.get(t, t) for _, t in df.dtypes]
    got = rows_of(names, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if text is None:
        return f"rows only ({len(got)})", took
    cur = con.execute(text)
    dnames = [d[0] for d in cur.description]
    dtypes = [DUCK_KINDS.get(str(d[1]), str(d[1])) for d in cur.description]
    want = rows_of(dnames, cur.fetchall())
    if sorted(names) != sorted(dnames):
        return f"COLUMNS {sorted(set(names) ^ set(dnames))}", took
    kinds = {n: (a, dict(zip(dnames, dtypes))[n]) for n, a in zip(names, types)}
    odd = {n: k for n, k in kinds.items() if k[0] != k[1]}
    note = f" types {odd}" if odd else ""
    if got != want:
        only_s = [r for r in got if r not in set(want)][:2]
        only_d = [r for r in want if r not in set(got)][:2]
        return f"DIFF spark={len(got)} sql={len(want)} {sorted(names)} spark-only={only_s} sql-only={only_d}{note}", took
    return (f"TYPES{note}" if odd else "ok") + f" ({len(got)})", took


if __name__ == "__main__":
    from bizlens.registry import all_queries
    from bizlens.session import build_session

    args = sys.argv[1:]
    folder = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    wanted = [a for a in args if "/" not in a]
    spark = build_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name, (query, text) in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            verdict, took = compare(spark, con, folder, query, text)
        except Exception as e:  # noqa: BLE001
            verdict, took = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0.0
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{took:6.2f}s {name}: {verdict}", flush=True)
    print("bad:", bad)
