"""Query registration and the role views that both sides share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.roles import expand_vector, with_elapsed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 9


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name`` with its equivalent SQL when there is one."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column; adding zero drops the sign of a negative zero."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL text that rounds as :func:`rounded` does."""
    return f"(round({expr}, {digits}) + 0.0)"


def with_views(body: str, *views: str) -> str:
    return f"WITH {', '.join(views)} {body}" if views else body


def union_all(parts: Iterable[str]) -> str:
    return " UNION ALL ".join(parts)


# -- role views ---------------------------------------------------------------------


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as transactions: time in seconds since the first, label = error."""
    events = table(spark, sf_dir, "events")
    return with_elapsed(events, "ts").select(
        "event_id", "time", F.col("value").alias("amount"), "user_id", "event_type",
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as transactions: four features, label = returned."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        "l_returnflag", "l_linestatus",
    )


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels where they have one."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as V1 … V64 with the given cluster and label = cluster 0."""
    wide = expand_vector(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return wide.withColumnRenamed("label", "cluster").withColumn(
        "label", (F.col("cluster") == 0).cast("int")
    )


FEATURES = ["quantity", "price", "discount", "tax"]
EMB_FEATURES = [f"V{i}" for i in range(1, 65)]

TX = """tx AS (
  SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6 AS time,
         value AS amount, user_id, event_type, CAST(event_type = 'error' AS INTEGER) AS label
  FROM events)"""
FEAT = """feat AS (
  SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
         l_tax AS tax, CAST(l_returnflag = 'R' AS INTEGER) AS label, l_returnflag, l_linestatus
  FROM lineitem)"""
DOC = """doc AS (
  SELECT d.doc_id, lang, source, n_chars, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
EMB = (
    "emb AS (SELECT vec_id, label AS cluster, CAST(label = 0 AS INTEGER) AS label, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS V{i}" for i in range(1, 65))
    + " FROM embeddings)"
)
