"""Exact silhouettes from tiles: a block of points against a block of points or of centres.

Rows are packed into blocks of a fixed size where they lie. Blocks meet by a partition-wise
product, without a broadcast, and only sums for each point and cluster leave a tile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.roles import as_double
from ledgerlens.session import materialise

#: Points or centres of one block, so a tile holds the square of it in distances.
BLOCK = 1_024


def _packed(rows: DataFrame, width: int, prefix: str) -> DataFrame:
    """(block, clusters, data) from (cluster, x): at most ``BLOCK`` rows in one, as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["clusters", "data"]
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False)
                assert len(x) == part.num_rows * width
                clusters = pa.array([part.column(0).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([clusters, pa.array([x.tobytes()], pa.binary())], names)

    made = rows.mapInArrow(work, "clusters array<long>, data binary")
    block = F.monotonically_increasing_id()
    made = materialise(made.select(block.alias("block"), "clusters", "data"))
    return made.select(*[F.col(c).alias(f"{prefix}_{c}") for c in made.columns])


def _coded(
    df: DataFrame, features: Sequence[str], cluster: str, asked: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Complete rows as (code, x, asked), written, and (code, cluster): codes are hashes."""
    rows = df.select(
        F.xxhash64(cluster).alias("\0code"), F.col(cluster).alias(cluster),
        F.array(*[as_double(df, c) for c in features]).alias("\0x"),
        (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))).alias("\0asked"),
    )
    rows = materialise(rows).where(F.forall("\0x", lambda v: v.isNotNull()))
    names = rows.groupBy(F.col("\0code").alias("own")).agg(F.first(cluster).alias(cluster))
    return rows, names


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances; small ones by differences, where products would cancel."""
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)
    scale = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
    a, b = np.nonzero(square <= 1e-6 * scale)
    for first in range(0, len(a), 50_000):
        i, j = a[first : first + 50_000], b[first : first + 50_000]
        square[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(square, 0.0))


def silhouette_euclidean(
    df: DataFrame, features: Sequence[str], cluster: str, queries: Column | None = None
) -> DataFrame:
    """(cluster, rows, silhouette) under Euclidean distance, exact.

    ``queries`` says for which rows; all rows count as their neighbours. The work is the
    number of query rows times all rows, so a large table wants a stated query set. Rows
    with a missing feature take no part; a cluster of one row has silhouette zero, and so
    has a table of one cluster.
    """
    width = len(features)
    rows, names = _coded(df, features, cluster, queries)
    points = _packed(rows.select("\0code", "\0x"), width, "p")
    asked = _packed(rows.where("`\0asked`").select("\0code", "\0x"), width, "q")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ["block", "place", "own", "other", "n", "total"]
        for batch in batches:
            for block, q_own, q, p_own, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(q).reshape(-1, width)
                away = _distances(x, np.frombuffer(p).reshape(-1, width))
                codes, at = np.unique(np.array(p_own), return_inverse=True)
                member = np.zeros((len(at), len(codes)))
                member[np.arange(len(at)), at] = 1.0
                total, n = away @ member, member.sum(axis=0)
                k, c = np.indices(total.shape).reshape(2, -1)
                made = [np.full(len(k), block), k, np.array(q_own)[k], codes[c], n[c], total[k, c]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in made], kinds)

    tiles = asked.join(points.hint("shuffle_replicate_nl"))
    tiles = tiles.select("q_block", "q_clusters", "q_data", "p_clusters", "p_data")
    found = tiles.mapInArrow(sums, "block long, place long, own long, other long, n double, total double")
    per = found.groupBy("block", "place", "own", "other").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    mine = F.col("own") == F.col("other")
    score = per.groupBy("block", "place", "own").agg(
        F.max(F.when(mine, F.try_divide("total", F.col("n") - 1))).alias("a"),
        F.max(F.when(mine, F.col("n"))).alias("n"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"),
    )
    return _by_cluster(score, names, cluster)


def _by_cluster(score: DataFrame, names: DataFrame, cluster: str) -> DataFrame:
    """Means per cluster from (own, n, a, b) of each row."""
    a, b = F.col("a"), F.col("b")
    s = F.when(F.col("n") > 1, F.try_divide(b - a, F.greatest(a, b)))
    per = score.groupBy("own").agg(
        F.count("*").alias("rows"), F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette")
    )
    return per.join(names, "own").select(cluster, "rows", "silhouette")


def silhouette_of_many_clusters(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """(cluster, rows, silhouette) under squared Euclidean distance for any number of clusters.

    Centres are packed in blocks as points are; a tile gives each point its distance to its
    own centre, if it is there, and the least one to another.
    """
    width = len(features)
    rows, names = _coded(df, features, cluster)
    points = _packed(rows.select("\0code", "\0x"), width, "p")
    norm = F.aggregate("\0x", F.lit(0.0), lambda s, v: s + v * v)
    centres = rows.groupBy("\0code").agg(
        F.concat(
            F.array(*[F.avg(F.get("\0x", i)) for i in range(width)]),
            F.array(F.avg(norm), F.count("*").cast("double")),
        ).alias("\0x")
    )
    centres = _packed(centres, width + 2, "c")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ["block", "place", "own", "n", "mine", "b"]
        for batch in batches:
            for block, p_own, p, codes, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                x, own = np.frombuffer(p).reshape(-1, width), np.array(p_own)
                table = np.frombuffer(c).reshape(-1, width + 2)
                means, square, n = table[:, :-2], table[:, -2], table[:, -1]
                away = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ means.T + square, 0.0)
                same = own[:, None] == np.array(codes)
                place = np.arange(len(x))
                here = same.any(axis=1)
                at = same.argmax(axis=1)
                mine = np.where(here, away[place, at], np.nan)
                other = np.where(same, np.inf, away).min(axis=1)
                made = [np.full(len(x), block), place, own, np.where(here, n[at], np.nan), mine, other]
                arrays = [pa.array(v) for v in made[:3]] + [pa.array(v, mask=np.isnan(v)) for v in made[3:5]]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(other, mask=np.isinf(other))], kinds)

    tiles = points.join(centres.hint("shuffle_replicate_nl"))
    tiles = tiles.select("p_block", "p_clusters", "p_data", "c_clusters", "c_data")
    found = tiles.mapInArrow(nearest, "block long, place long, own long, n double, mine double, b double")
    score = found.groupBy("block", "place", "own").agg(
        F.max("n").alias("n"), F.max("mine").alias("mine"), F.min("b").alias("b")
    )
    score = score.withColumn("a", F.try_divide(F.col("mine") * F.col("n"), F.col("n") - 1))
    return _by_cluster(score, names, cluster)
