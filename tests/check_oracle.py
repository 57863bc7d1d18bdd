"""Run registered queries against their SQL: python tests/check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir: str, name: str, plan, sql: str | None) -> tuple[str, float, float, int]:
    start = time.time()
    df = plan(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return "rows-only", took, 0.0, len(got)
    start = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    sql_took = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}", took, sql_took, len(got)
    if got == want:
        return "ok", took, sql_took, len(got)
    got_set, want_set = set(got), set(want)
    only_got = [r for r in got if r not in want_set][:2]
    only_want = [r for r in want if r not in got_set][:2]
    return f"DIFF {len(got)} vs {len(want)}\n   spark {only_got}\n   sql   {only_want}", took, sql_took, len(got)


def main() -> None:
    from factloom.queries import load
    from factloom.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    registry = load()
    names = [n for n in registry if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        plan, sql = registry[name]
        try:
            status, took, sql_took, n = check(spark, con, sf_dir, name, plan, sql)
        except Exception as exc:  # noqa: BLE001
            status, took, sql_took, n = f"ERROR {str(exc)[:700]}", 0.0, 0.0, 0
        bad += status not in ("ok", "rows-only")
        print(f"{name:32s} {n:7d} rows  {took:6.2f}s  sql {sql_took:6.2f}s  {status}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
