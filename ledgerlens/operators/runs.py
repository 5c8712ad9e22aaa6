"""Run-metric tables: one row per executed operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def operation_stats(runs: DataFrame) -> DataFrame:
    """count, average, minimum, maximum and total duration per operation."""
    d = F.col("duration_seconds")
    return runs.groupBy(F.col("operation_name").alias("operation")).agg(
        F.count("*").alias("count"),
        F.avg(d).alias("avg_duration"),
        F.min(d).alias("min_duration"),
        F.max(d).alias("max_duration"),
        F.sum(d).alias("total_duration"),
    )


def throughput(runs: DataFrame) -> DataFrame:
    """Add rows per second and, where both readings exist, the memory change."""
    rate = F.when(
        (F.col("rows_processed") != 0) & (F.col("duration_seconds") > 0),
        F.try_divide(F.col("rows_processed").cast("double"), "duration_seconds"),
    )
    out = runs.withColumn("throughput_rows_per_sec", rate)
    if {"memory_before_mb", "memory_after_mb"} <= set(runs.columns):
        change = F.col("memory_after_mb") - F.col("memory_before_mb")
        out = out.withColumn("memory_delta_mb", change)
    return out


def recent_runs(runs: DataFrame, n: int = 10, time: str = "start_time", *ties: str) -> DataFrame:
    """The n most recent rows."""
    return runs.orderBy(F.col(time).desc(), *ties).limit(n)
