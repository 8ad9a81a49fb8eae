"""Run registered queries against DuckDB and compare: python tests/oracle.py [sf_dir] [name-prefix…]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def kind(t):
    t = str(t).upper()
    for a, b in (("BIGINT", "int"), ("INT", "int"), ("DOUBLE", "float"), ("FLOAT", "float"), ("DECIMAL", "decimal"),
                 ("VARCHAR", "str"), ("STRING", "str"), ("BOOLEAN", "bool"), ("TIMESTAMP", "ts")):
        if t.startswith(a):
            return b
    return "int!" if t.startswith("HUGEINT") else t


def compare(spark, con, query, folder):
    """(ok, message, n_rows) of one query."""
    df = query(spark, folder)
    got = df.collect()
    if query.sql is None:
        return None, "rows only", len(got)
    rel = con.sql(query.sql)
    want, cols = rel.fetchall(), rel.columns
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    types = dict(zip(cols, map(kind, rel.types)))
    mine = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    diff = {c: (mine[c], types[c]) for c in cols if mine[c] != types[c]}
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        only_a = [r for r in a if r not in b[:20000]][:2] if len(a) < 20000 else []
        only_b = [r for r in b if r not in a[:20000]][:2] if len(b) < 20000 else []
        return False, f"{len(a)} vs {len(b)} rows; spark {only_a} duck {only_b} cols {sorted(cols)}", len(got)
    return not diff, f"types {diff}" if diff else "ok", len(got)


if __name__ == "__main__":
    from wardline.plans import catalog  # noqa: F401
    from wardline.plans.registry import QUERIES
    from wardline.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = local_session(), connect(folder)
    bad = []
    for name, q in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        try:
            ok, message, n = compare(spark, con, q, folder)
        except Exception as exc:  # noqa: BLE001
            ok, message, n = False, f"{type(exc).__name__}: {str(exc)[:900]}", -1
        if ok is False:
            bad.append(name)
        flag = {True: "PASS", None: "rows", False: "FAIL"}[ok]
        print(f"{flag} {name} n={n} {time.time() - t0:.1f}s {'' if ok else message}", flush=True)
    print("failed:", bad)
