"""Run registered queries beside DuckDB and compare the results.

``python tests/oracle.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool | int | str):
        return v
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a short text about the difference."""
    df = fn(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = canonical([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    if got[1] != want[1]:
        pairs = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        return f"{len(pairs)} rows differ, first {pairs[0]}"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries

    from inodeatlas.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__driver__memory="12g",
        spark__sql__shuffle__partitions="8",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            if name in sqls:
                verdict = compare(spark, con, sf_dir, name, fn, sqls[name])
            else:
                verdict = None
                print(f"    {name}: {fn(spark, sf_dir).count()} rows, no SQL")
        except Exception as exc:  # noqa: BLE001
            verdict = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - start:.1f}s {verdict or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
