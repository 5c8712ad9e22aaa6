"""Compare registered queries with their SQL twins on DuckDB.

    python tests/oracle.py [sf_dir] [query …]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    if isinstance(value, (list, tuple)):
        return [_cell(v) for v in value]
    return repr(value)


def _table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(row[i]) for i in order) for row in rows], key=str)


def differences(spark_df, con, sql: str) -> str | None:
    """None when names, row count and all values agree."""
    left_rows = spark_df.collect()
    result = con.sql(sql)
    right_rows, right_columns = result.fetchall(), result.columns
    if sorted(spark_df.columns) != sorted(right_columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(right_columns)}"
    if len(left_rows) != len(right_rows):
        return f"rows {len(left_rows)} != {len(right_rows)}"
    left, right = _table(spark_df.columns, left_rows), _table(right_columns, right_rows)
    off = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    if off:
        return f"{len(off)} of {len(left)} rows differ, first {off[0]}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as contract

    from ledgerlens.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in only or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                problem = differences(df, con, sql[name])
            else:
                problem = None if df.collect() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        verdict = "ok" if problem is None else "FAIL"
        kind = "sql" if name in sql else "rows"
        print(f"{verdict:5}{kind:5}{time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{len(only or queries) - failed} ok, {failed} failed")
    return failed


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(where, sys.argv[2:]) else 0)
