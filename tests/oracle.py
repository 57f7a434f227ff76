"""Compare registered queries with their SQL in DuckDB: python tests/oracle.py [sf_dir] [name-part ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return plain(float(v)) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v.is_integer() and abs(v) < 1e15 else float(f"{v:.9g}"))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con) -> str:
    """Empty if equal, else what differs."""
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; first only here {next((g for g in got if g not in set(want)), None)}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"{g} against {w}"
    return ""


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from quillset.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, bad = build_session(), connect(sf_dir), 0
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if argv[1:] and not any(p in name for p in argv[1:]):
            continue
        began = time.time()
        try:
            what = compare(query(spark, sf_dir), sql[name], con) if name in sql else f"ok (rows only: {query(spark, sf_dir).count()})"
        except Exception as e:
            what = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(what) and not what.startswith("ok")
        print(f"{name:32s} {time.time() - began:6.1f}s {what or 'equal'}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
