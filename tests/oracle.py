"""Compare queries with their SQL checks: ``python tests/oracle.py [folder] [name part ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return db


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(frame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    types = {d[0]: str(d[1]) for d in found.description}
    expected = sorted_rows(names, found.fetchall())
    actual = sorted_rows(frame.columns, frame.collect())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    odd = [f"{n}: {d} / {types[n]}" for n, d in frame.dtypes if TYPES.get(d) not in (None, types[n])]
    if odd:
        return f"types differ: {odd}"
    if len(expected) != len(actual):
        return f"{len(actual)} rows, {len(expected)} expected\n  {actual[:3]}\n  {expected[:3]}"
    for a, e in zip(actual, expected):
        if a != e:
            return f"row {a}\n  !=  {e}"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from tabscope.catalog import check_sql, spark_queries
    from tabscope.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark, db = local_session(8), connect(folder)
    queries, checks = spark_queries(), check_sql()
    failed = 0
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            problem = difference(frame, db, checks[name]) if name in checks else f"rows only: {len(frame.collect())}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad = problem is not None and not problem.startswith("rows only")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
