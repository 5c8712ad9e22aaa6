"""Incremental profiles: mergeable partials per micro-batch, merged on read."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions.stats import tidy
from ledgerlens.roles import as_double


def partial_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One mergeable row per column: central moments, extremes, missing, quantile sketch."""
    base = df.select(*[as_double(df, c).alias(f"x_{i}") for i, c in enumerate(cols)])
    aggs, fields = [F.count("*").alias("rows")], {}
    for i, c in enumerate(cols):
        x = F.col(f"x_{i}")
        aggs += [
            F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"mean_{i}"), F.var_pop(x).alias(f"v_{i}"),
            F.skewness(x).alias(f"s_{i}"), F.kurtosis(x).alias(f"k_{i}"),
            F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}"),
            F.kll_sketch_agg_double(x).alias(f"q_{i}"),
        ]
        n, v = F.col(f"n_{i}").cast("double"), F.coalesce(f"v_{i}", F.lit(0.0))
        fields[c] = {
            "n": f"n_{i}",
            "missing": F.col("rows") - F.col(f"n_{i}"),
            "mean": f"mean_{i}",
            "m2": n * v,
            "m3": F.coalesce(n * F.col(f"s_{i}") * v * F.sqrt(v), F.lit(0.0)),
            "m4": F.coalesce(n * (F.col(f"k_{i}") + 3) * v * v, F.lit(0.0)),
            "min": f"lo_{i}",
            "max": f"hi_{i}",
            "sketch": f"q_{i}",
        }
    return tidy(base.agg(*aggs), fields)


def merge_partials(parts: DataFrame) -> DataFrame:
    """Exact merge of the moments of any number of partials per column."""
    weighted = F.sum(F.col("n") * F.coalesce("mean", F.lit(0.0)))
    centre = parts.groupBy(F.col("column").alias("of")).agg(
        F.try_divide(weighted, F.sum("n")).alias("centre")
    )
    d = F.coalesce(F.col("mean") - F.col("centre"), F.lit(0.0))
    n = F.col("n").cast("double")
    return (
        parts.join(F.broadcast(centre), F.col("column") == F.col("of"))  # a row per column
        .groupBy("column")
        .agg(
            F.sum("n").alias("n"),
            F.sum("missing").alias("missing"),
            F.max("centre").alias("mean"),
            F.sum(F.col("m2") + n * d * d).alias("m2"),
            F.sum(F.col("m3") + 3 * d * F.col("m2") + n * d * d * d).alias("m3"),
            F.sum(
                F.col("m4") + 4 * d * F.col("m3") + 6 * d * d * F.col("m2") + n * d * d * d * d
            ).alias("m4"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.kll_merge_agg_double("sketch").alias("sketch"),
        )
    )


def finish_profile(
    merged: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Readable statistics; moments are exact, quantiles come from the sketch."""
    n = F.col("n").cast("double")
    v = F.try_divide("m2", n)
    g1 = F.try_divide(F.try_divide("m3", n), v * F.sqrt(v))
    g2 = F.try_divide(F.try_divide("m4", n), v * v) - 3
    left = F.sqrt(n * F.greatest(n - 1, F.lit(0.0)))
    g2_factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    rank = F.when(n > 0, F.kll_sketch_get_quantile_double(
        "sketch", F.array(*[F.lit(float(p)) for p in probs])
    ))
    return merged.select(
        "column", "n", "missing", "mean",
        F.when(n >= 2, F.sqrt(F.try_divide("m2", n - 1))).alias("std"),
        "min", "max",
        F.when(n >= 3, g1 * F.try_divide(left, n - 2)).alias("skewness"),
        F.when(n >= 4, g2_factor * ((n + 1) * g2 + 6)).alias("kurtosis"),
        rank.alias("approx_quantiles"),
    )


def incremental_profile(
    stream: DataFrame, cols: Sequence[str], state: str, checkpoint: str
) -> StreamingQuery:
    """Write one partial table per micro-batch below ``state``.

    A replayed batch overwrites its own folder, so a restart cannot count rows twice.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, at: save_partial(batch, cols, state, at))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def save_partial(batch: DataFrame, cols: Sequence[str], state: str, batch_id: int) -> None:
    """The partial of one batch, in a folder of its own."""
    partial_profile(batch, cols).write.mode("overwrite").parquet(f"{state}/batches/batch={batch_id}")


def _folded(spark: SparkSession, state: str) -> tuple[DataFrame | None, int]:
    """The newest folded partials and the last batch that they contain."""
    try:
        versions = spark.read.parquet(f"{state}/folded")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None, -1
    upto = versions.agg(F.max("upto")).first()[0]
    return versions.where(F.col("upto") == upto).drop("upto"), upto


def _partials(spark: SparkSession, state: str) -> DataFrame:
    folded, upto = _folded(spark, state)
    batches = spark.read.parquet(f"{state}/batches").where(F.col("batch") > upto).drop("batch")
    return batches if folded is None else folded.unionByName(batches)


def fold_partials(spark: SparkSession, state: str) -> int:
    """Merge all partials so far into one row per column; returns the last batch in them.

    The result is a new version beside the old ones, and readers pass over the batches that
    it contains: a batch that is replayed later changes nothing, and folders of folded
    batches can be removed at any time.
    """
    last = spark.read.parquet(f"{state}/batches").agg(F.max("batch")).first()[0]
    merge_partials(_partials(spark, state)).write.mode("overwrite").parquet(
        f"{state}/folded/upto={last}"
    )
    return last


def read_profile(spark: SparkSession, state: str) -> DataFrame:
    """The profile of everything that has arrived."""
    return finish_profile(merge_partials(_partials(spark, state)))


def hourly_stream(
    stream: DataFrame, ts: str, watermark: str = "1 hour", window: str = "1 hour"
) -> DataFrame:
    """(window_start, hour, count) per hour of a live stream, in append mode."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    counts = timed.groupBy(F.window("_ts", window).alias("w")).agg(F.count("*").alias("count"))
    start = F.col("w.start")
    return counts.select(start.alias("window_start"), F.hour(start).alias("hour"), "count")


def map_reduce_chunks(
    df: DataFrame,
    processor: Callable[[pd.DataFrame], pd.DataFrame],
    aggregator: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    levels: Sequence[int] = (1024, 32, 1),
) -> DataFrame:
    """User map over Arrow chunks, user merge up a tree with ``levels`` nodes.

    ``processor`` turns a chunk into partial rows; ``aggregator`` turns many partials
    into fewer of the same schema and must be associative.  Partials of one task are
    merged before anything is shuffled.
    """

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for chunk in chunks:
            part = processor(chunk)
            both = part if held is None else pd.concat([held, part], ignore_index=True)
            held = aggregator(both)
        if held is not None:
            yield held.assign(_node=TaskContext.get().partitionId())

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return aggregator(rows.drop(columns="_node")).assign(_node=key[0])

    with_node = schema + ", _node bigint"
    level = df.mapInPandas(run, with_node)
    for size in levels:
        level = level.withColumn("_node", F.pmod("_node", F.lit(size)))
        level = level.groupBy("_node").applyInPandas(merge, with_node)
    return level.drop("_node")
