"""Compare registered queries with their SQL twins run by DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value == int(value) and abs(value) < 1e15 else repr(round(value, 9)))
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, fn, sql, folder):
    df = fn(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = rows([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        return f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    return None if got[1] else "EMPTY"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from crowdtide.catalog import load
    from crowdtide.session import build_session

    scale, only = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark = build_session(cores="8", partitions=8)
    con = connect(folder)
    fns, sqls = load()
    for name, fn in fns.items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, fn, sqls[name], folder)
            else:
                n = len(fn(spark, folder).collect())
                problem = None if n else "EMPTY"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        print("ok  " if problem is None else "FAIL", name, f"{time.time() - start:.1f}s", "" if name in sqls else "(rows only)", problem or "", flush=True)
