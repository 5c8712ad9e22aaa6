"""Exact-size samples by hash order, repeatable at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
SPACE = 2**32
FANOUT = 4096
TRIM_ROWS = 100_000


def sample_hash(df: DataFrame, key: str, seed: int = SEED) -> Column:
    """Leading 32 bits of the MD5 of ``key:seed``; a missing key counts as an empty text."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def lowest_hashes(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """Exactly min(n, rows) rows: those with the smallest (hash, key).

    Counting passes over 4096 hash buckets find the bucket that contains the n-th row;
    only rows of that one bucket are ordered.
    """
    hashed = df.withColumn("_hash", sample_hash(df, key, seed))
    if n <= 0:
        return df.limit(0)
    low, size, need = 0, SPACE, n
    while True:
        width = max(1, size // FANOUT)
        inside = hashed.where(F.col("_hash").between(low, low + size - 1))
        slot = F.floor((F.col("_hash") - low) / width).alias("slot")
        counts = inside.groupBy(slot).agg(F.count("*").alias("n")).orderBy("slot").collect()
        if sum(r["n"] for r in counts) <= need:  # the whole range is wanted
            return hashed.where(F.col("_hash") < low + size).drop("_hash")
        for row in counts:
            if row["n"] >= need:
                break
            need -= row["n"]
        low, size = low + row["slot"] * width, width
        if row["n"] <= TRIM_ROWS or size == 1:
            break
    sure = hashed.where(F.col("_hash") < low)
    edge = hashed.where(F.col("_hash").between(low, low + size - 1))
    edge = edge.orderBy("_hash", key).limit(need)
    return sure.unionByName(edge).drop("_hash")


def simple_sample(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """n rows regardless of label."""
    return lowest_hashes(df, n, key, seed)


def _by_quota(
    df: DataFrame, quota: dict[int, int], label: str, key: str, seed: int
) -> DataFrame:
    ones = lowest_hashes(df.where(F.col(label) == 1), quota[1], key, seed)
    return ones.unionByName(lowest_hashes(df.where(F.col(label) == 0), quota[0], key, seed))


def _sizes(df: DataFrame, label: str) -> tuple[int, int, int]:
    return tuple(
        df.agg(
            F.count("*"), F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
        ).head()
    )


def stratified_sample(
    df: DataFrame, n: int, label: str, key: str, seed: int = SEED
) -> DataFrame:
    """n rows that keep the label ratio; the whole input when it is not larger."""
    total, ones, zeros = _sizes(df, label)
    if total <= n:
        return df
    take = min(ones, int(n * (ones / total)))
    return _by_quota(df, {1: take, 0: min(zeros, n - take)}, label, key, seed)


def boosted_sample(df: DataFrame, n: int, label: str, key: str, seed: int = SEED) -> DataFrame:
    """Up to n/10 positives, the rest negatives; for charts of rare positives."""
    total, ones, zeros = _sizes(df, label)
    if total <= n:
        return df
    take = min(ones, n // 10)
    return _by_quota(df, {1: take, 0: min(zeros, n - take)}, label, key, seed)


def sampling_info(df: DataFrame, n: int) -> DataFrame:
    """Original size, analysed size, and whether sampling applies."""
    return df.agg(F.count("*").alias("original_size")).select(
        "original_size",
        F.least("original_size", F.lit(n)).alias("analyzed_size"),
        (F.col("original_size") > n).alias("sampling_applied"),
    )


def head_sample(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an explicit order."""
    return df.orderBy(*order).limit(n)
