"""Runs registered queries beside their SQL.  From the repository root:

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.inputs import TABLES  # noqa: E402


def normal(value):
    """One Python form for a value of either engine."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [normal(v) for v in value]
    return value


def kind(value) -> str:
    return type(value).__name__


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def rows_of(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([normal(r[i]) for i in order] for r in rows), key=repr)


def difference(result, connection, sql: str) -> str | None:
    """What differs between a DataFrame and the SQL result, or None."""
    names, mine = rows_of(result.columns, [tuple(r) for r in result.collect()])
    cursor = connection.execute(sql)
    other_names, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != other_names:
        return f"columns {names} and {other_names}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if a != b or [kind(x) for x in a] != [kind(x) for x in b]:
            return f"{a}\n  and {b}"
    return None


def main() -> int:
    import __spark_entry__ as registered
    from tests.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    connection = oracle_connection(folder)
    queries, sql = registered.queries(), registered.oracle_sql()
    failed = 0
    for name in wanted or queries:
        start = time.time()
        try:
            if name in sql:
                found = difference(queries[name](spark, folder), connection, sql[name])
            else:
                found = None if queries[name](spark, folder).collect() else "no rows"
        except Exception as error:  # report and go on with the next query
            found = f"{kind(error)}: {str(error)[:1500]}"
        failed += found is not None
        mark = "ok  " if found is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.2f}s {'' if name in sql else '(rows only)'}"
              f" {found or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
