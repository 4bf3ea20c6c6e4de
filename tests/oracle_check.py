"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import signal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT"}


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, repr(v + 0.0))
    return (1, repr(v) if not isinstance(v, (list, tuple, dict)) else repr(v))


def compare(name, spark, con, folder, queries, oracles):
    df = queries[name](spark, folder)
    cols = sorted(df.columns)
    rows = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    if name not in oracles:
        return f"rows={len(rows)} (no SQL)" if rows else "FAIL: empty"
    global SQL_SECONDS
    began = time.time()
    rel = con.execute(oracles[name])
    desc = [(d[0], str(d[1])) for d in rel.description]
    order = {d[0]: i for i, d in enumerate(desc)}
    if sorted(order) != cols:
        return f"FAIL columns spark={cols} sql={sorted(order)}"
    want = sorted(tuple(_cell(r[order[c]]) for c in cols) for r in rel.fetchall())
    note = ""
    kinds = dict(desc)
    for c, t in df.dtypes:
        if TYPES.get(t) != kinds[c]:
            note += f" TYPE {c}: {t} vs {kinds[c]}"
    SQL_SECONDS = time.time() - began
    if len(rows) != len(want):
        return f"FAIL rows spark={len(rows)} sql={len(want)} only-spark={sorted(set(rows) - set(want))[:2]} only-sql={sorted(set(want) - set(rows))[:2]}" + note
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return f"FAIL {len(bad)}/{len(rows)} values, cols={cols}, first: spark={bad[0][0]} sql={bad[0][1]}" + note
    return ("FAIL" + note if note else f"ok rows={len(rows)}") + ("" if rows else " FAIL: empty")


SQL_SECONDS = 0.0


def _expired(*_):
    raise TimeoutError("query took too long")


def main():
    import __spark_entry__ as entry
    from parcelworks.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = duck(folder), entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    failed = []
    for name in names:
        start = time.time()
        signal.signal(signal.SIGALRM, _expired)
        globals()["SQL_SECONDS"] = 0.0
        signal.alarm(int(os.environ.get("QUERY_SECONDS", "60")))
        try:
            result = compare(name, spark, con, folder, queries, oracles)
        except Exception as error:  # report and go on
            result = f"FAIL {type(error).__name__}: {str(error)[:700]}"
        signal.alarm(0)
        if "FAIL" in result:
            spark.sparkContext.cancelAllJobs()
            failed.append(name)
        print(f"{name:28s} {time.time() - start:6.2f}s (sql {SQL_SECONDS:5.2f}s) {result}", flush=True)
    print(f"{len(names)} checked, {len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
