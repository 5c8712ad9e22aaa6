"""Registration of this subpackage's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: White space of the word and line rules, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def text_or_empty(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str, limit: int) -> DataFrame:
    """Join a key table, broadcast only when a count shows at most ``limit`` keys."""
    few = keys.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(keys) if few else keys, on, how)


def crc32_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of an ASCII string expression."""
    start, poly = "4294967295::UBIGINT", "3988292384::UBIGINT"
    shift = f"CASE WHEN y % 2 = 1 THEN xor(y // 2, {poly}) ELSE y // 2 END"
    eight = "list_transform(range(8), lambda k: 0::UBIGINT)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::UBIGINT)"
    byte = f"list_reduce(list_concat([xor(a, x)], {eight}), lambda y, z: {shift})"
    return f"xor(list_reduce(list_concat([{start}], {codes}), lambda a, x: {byte}), {start})"
