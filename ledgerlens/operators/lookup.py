"""Joining rows with a per-group lookup table, safe for hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialise

FEW_GROUPS = 1_000


def hot_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """None when there are at most FEW_GROUPS groups, else those with more than the share of one
    shuffle partition in the rows: fewer than a shuffle has partitions. Reads the key columns only.
    """
    if not keys or df.select(*keys).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        return None
    rows = df.select(*keys).count()
    sizes = df.groupBy(*keys).agg((F.count("*") * _salts(df) > rows).alias("_hot"))
    return materialise(sizes.where("_hot").select(*keys))


def _salts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _salted(df: DataFrame, keys: Sequence[str], hot: DataFrame, salt: Column, other: Column) -> DataFrame:
    """``df`` with ``salt`` for the rows of hot groups and ``other`` for the rest, as ``_salt``."""
    names = [f"_hot_{i}" for i in range(len(keys))]
    known = hot.toDF(*names).withColumn("_hot", F.lit(True))
    on = F.lit(True)
    for k, name in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(name))
    marked = df.join(F.broadcast(known), on, "left")
    return marked.withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(other)).drop("_hot", *names)


def lookup_join(
    rows: DataFrame, table: DataFrame, pairs: Sequence[tuple[str, str]], hot: DataFrame | None,
    extra: Column | None = None,
) -> DataFrame:
    """Inner join of ``rows`` with ``table`` on (row key, table key) ``pairs``.

    NULL keys match each other. ``hot`` is what :func:`hot_groups` found for the row keys, in
    their order. A table of few groups is broadcast. Otherwise both sides are shuffled, never
    collected, however small they are estimated to be; the rows of a hot group are spread over
    as many tasks as a shuffle has, and only its entries are copied for each of them.
    """
    on = F.lit(True) if extra is None else extra
    for left, right in pairs:
        on = on & F.col(left).eqNullSafe(F.col(right))
    if hot is None:
        return rows.join(F.broadcast(table), on)
    if hot.isEmpty():
        return rows.join(table.hint("merge"), on)
    salts = _salts(rows)
    part = F.pmod(F.spark_partition_id(), F.lit(salts))
    salted = _salted(rows, [left for left, _ in pairs], hot, part, F.lit(0))
    every, first = F.sequence(F.lit(0), F.lit(salts - 1)), F.array(F.lit(0))
    copies = _salted(table, [right for _, right in pairs], hot, every, first)
    copies = copies.withColumn("_table_salt", F.explode("_salt")).drop("_salt")
    both = on & (F.col("_salt") == F.col("_table_salt"))
    return salted.join(copies.hint("merge"), both).drop("_salt", "_table_salt")
