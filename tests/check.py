"""Runs registered queries against their SQL in DuckDB: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from undercroft.queries.base import SOURCES  # noqa: E402

ROOT = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def same(a: list[tuple], b: list[tuple]) -> bool:
    return len(a) == len(b) and all(same_row(x, y) for x, y in zip(a, b, strict=True))


def same_row(x: tuple, y: tuple) -> bool:
    return all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-6) for u, v in zip(x, y, strict=True))


def main() -> None:
    import __spark_entry__ as entry
    from undercroft.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    spark = build_session()
    spark.sparkContext.setLogLevel("OFF")
    folder = f"{ROOT}/{sf}"
    con, sql, bad = connect(folder), entry.oracle_sql(), []
    wanted = [n for n in entry.queries() if not args or any(n == a or n.startswith(a.rstrip("*")) and a.endswith("*") for a in args)]
    for name in wanted:
        start = time.time()
        try:
            names, got = rows_of_spark(entry.queries()[name](spark, folder))
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
                continue
            theirs, want = rows_of_sql(con, sql[name])
            exact, near = got == want, same(got, want)
            state = "ok" if exact and names == theirs and got else ("NEAR" if near and got else "BAD")
            print(f"{state:5} {name}: {len(got)}/{len(want)} rows, {took:.1f}s, sql {time.time() - start - took:.1f}s", flush=True)
            if state != "ok":
                bad.append(name)
                diff = [(x, y) for x, y in zip(got, want) if x != y][:2] or [(got[len(want):][:2], want[len(got):][:2])]
                print("   ", names, theirs if theirs != names else "", "\n    ", *diff, flush=True)
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            con = connect(folder)
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("checked", len(wanted), "bad", bad)


if __name__ == "__main__":
    main()
