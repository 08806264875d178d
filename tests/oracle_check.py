"""Run registered queries against DuckDB on the same parquet files: python tests/oracle_check.py [sf] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _key(v):
    return (v is None, str(type(v).__name__), str(v))


def compare(con, df, sql: str, rows=None) -> str | None:
    """None when equal, else a description of the first difference."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    idx = [names.index(c) for c in order]
    mine = [tuple(r[c] for c in order) for r in (df.collect() if rows is None else rows)]
    theirs = [tuple(r[i] for i in idx) for r in theirs]
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    mine.sort(key=lambda r: [_key(v) for v in r])
    theirs.sort(key=lambda r: [_key(v) for v in r])
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            bad = sum(1 for x, y in zip(mine, theirs) if x != y)
            return f"{bad} of {len(mine)} rows differ, first: {order}\n   spark  {a}\n   oracle {b}"
    return None


def main(argv):
    import __spark_entry__ as entry

    from gaugeline.session import build_session

    sf = argv[0] if argv else "0.001"
    spark = build_session("local[8]", shuffle_partitions=8, spark__driver__memory="12g")
    con = connect(f"{DATA}/sf{sf}")
    queries, sql = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    failed = 0
    for n in names:
        if n.endswith("*"):
            names += [q for q in queries if q.startswith(n[:-1]) and q not in names]
            continue
        t0 = time.time()
        try:
            df = queries[n](spark, f"{DATA}/sf{sf}")
            if n in sql:
                rows = df.collect()
                res = compare(con, df, sql[n], rows)
                empty = "" if rows else " EMPTY"
            else:
                rows = df.collect()
                res, empty = None, f" (no oracle, {len(rows)} rows)"
        except Exception as e:
            res, empty = f"{type(e).__name__}: {str(e)[:1500]}", ""
        failed += res is not None
        print(f"{'ok  ' if res is None else 'FAIL'} {n}{empty} {time.time() - t0:.1f}s" + (f"\n  {res}" if res else ""), flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
