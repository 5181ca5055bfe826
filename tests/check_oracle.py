"""Run registered queries next to their SQL: python tests/check_oracle.py <sf_dir> [query ...]"""

from __future__ import annotations

import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_norm(r[i]) for i in order) for r in rows])


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return took, len(got), None, ""
    start = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - start
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if sorted(df.columns) != sorted(cols):
        return took, len(got), False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if a == b:
        return took, len(got), True, f"sql {sql_took:.1f}s"
    sa, sb = set(a), set(b)
    return took, len(got), False, f"{len(a)} vs {len(b)} rows; {sorted(df.columns)}\n   spark only {sorted(sa - sb)[:3]}\n   sql only   {sorted(sb - sa)[:3]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from invoicelake.session import build_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(queries())
    spark = build_session("check", "local[8]", 8, {"spark.driver.memory": "12g"})
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            took, n, ok, note = compare(spark, con, sf_dir, name, queries()[name], oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001
            took, n, ok, note = 0, 0, False, str(e)[:1500]
        bad += ok is False
        print(f"{'ok ' if ok else '-- ' if ok is None else 'BAD'} {name:28s} {took:6.1f}s {n:8d} rows {note}", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
