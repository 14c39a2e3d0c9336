"""Compare Spark queries with their SQL on the same parquet tables.

    python -m tests.oracle_check [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def difference(con: duckdb.DuckDBPyConnection, rows, sql: str) -> str | None:
    """None if the Spark rows equal the statement's rows, else what differs."""
    con.register("actual", rows.toArrow())
    con.execute(f"create or replace temp table expected as {sql}")
    columns = con.execute("select column_name, column_type from (describe actual) order by 1").fetchall()
    wanted = con.execute("select column_name, column_type from (describe expected) order by 1").fetchall()
    if columns != wanted:
        return f"columns {columns} instead of {wanted}"
    names = ", ".join(f'"{c}"' for c, _ in columns)
    out = []
    for what, a, b in (("surplus", "actual", "expected"), ("missing", "expected", "actual")):
        query = f"select {names} from {a} except all select {names} from {b}"
        n = con.execute(f"select count(*) from ({query})").fetchall()[0][0]
        if n:
            out.append(f"{n} {what}: {con.execute(query + ' limit 2').fetchall()}")
    if out:
        return "; ".join(out)
    return None if con.execute("select count(*) from expected").fetchall()[0][0] else "no rows"


def main(sf_dir: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from titletags.session import local_session

    ORACLE, QUERIES = oracle_sql(), queries()

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in ORACLE:
                found = difference(con, QUERIES[name](spark, sf_dir), ORACLE[name])
            else:
                n = QUERIES[name](spark, sf_dir).count()
                found = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:250]}"
        bad += found is not None
        print(f"{time.time() - start:6.2f}s {'ok  ' if found is None else 'FAIL'} {name} {found or ''}",
              flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(bool(main(args[0] if args else "/root/testdata/sf0.01", args[1:])))
