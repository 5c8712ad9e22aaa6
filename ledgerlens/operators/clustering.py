"""K-means with elbow selection, silhouettes and cluster profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.stats import long_form, percent, sample_std
from ledgerlens.operators import kmeans
from ledgerlens.operators.sampling import SEED
from ledgerlens.operators.silhouettes import silhouette_of_many_clusters
from ledgerlens.roles import as_double
from ledgerlens.session import materialise

SILHOUETTE_UP_TO = 8
FEW_CLUSTERS = 1_000  # whose centres are broadcast
STARTS = 10  # of which the best is kept


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes zero."""
    row = df.agg(
        *[
            f(as_double(df, c)).alias(f"{k}_{i}")
            for i, c in enumerate(cols)
            for k, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    ).head()
    scaled = {
        c: (as_double(df, c) - F.lit(row[f"mean_{i}"])) / F.lit(row[f"std_{i}"] or 1.0)
        for i, c in enumerate(cols)
    }
    return df.withColumns(scaled)


def _standard_vectors(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Complete rows with their standardised values as the array ``kmeans.VECTOR``."""
    x = [as_double(rows, c) for c in features]
    stats = rows.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).head()
    means = F.array(*[F.lit(v) for v in stats[: len(x)]])
    scales = F.array(*[F.lit(v or 1.0) for v in stats[len(x) :]])
    moved = F.zip_with(F.array(*x), means, lambda a, m: a - m)
    return rows.withColumn(kmeans.VECTOR, F.zip_with(moved, scales, lambda a, s: a / s))


def complete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows in which every feature is present."""
    present = F.lit(True)
    for c in features:
        present = present & as_double(df, c).isNotNull()
    return df.where(present)


def silhouette_by_cluster(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """(cluster, rows, silhouette) under squared Euclidean distance.

    The mean squared distance of x to a cluster is |x|² − 2x·m + q with m the mean and
    q the mean squared norm, so only (clusters × features) means travel to the tasks. More
    than ``FEW_CLUSTERS`` clusters are compared block by block instead.
    """
    if df.select(cluster).distinct().limit(FEW_CLUSTERS + 1).count() > FEW_CLUSTERS:
        return silhouette_of_many_clusters(df, features, cluster)
    x = F.array(*[as_double(df, c) for c in features])
    rows = complete_rows(df, features).select(F.col(cluster).alias("own"), x.alias("x"))
    size = len(features)
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    centre = rows.groupBy("own").agg(
        F.count("*").cast("double").alias("n"),
        F.avg(norm).alias("q"),
        F.array(*[F.avg(F.get("x", i)) for i in range(size)]).alias("m"),
    )
    centre = materialise(centre)
    def distance(c: Column) -> Column:
        dot = F.aggregate(
            F.zip_with("x", c["m"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v
        )
        return norm - 2 * dot + c["q"]

    # One row per cluster; as one array it meets every row without pairs being written out.
    table = centre.agg(F.collect_list(F.struct("own", "n", "q", "m")).alias("centres"))
    placed = rows.join(F.broadcast(table), F.lit(True), "left").withColumn("d", F.transform(
        "centres", lambda c: F.struct(c["own"].alias("own"), c["n"].alias("n"), distance(c).alias("d"))
    ))
    own = F.get(F.filter("d", lambda c: c["own"] == F.col("own")), 0)
    other = F.array_min(
        F.transform(F.filter("d", lambda c: c["own"] != F.col("own")), lambda c: c["d"])
    )
    a = F.try_divide(own["d"] * own["n"], own["n"] - 1)
    score = F.when(own["n"] == 1, F.lit(0.0)).otherwise(
        F.try_divide(other - a, F.greatest(a, other))
    )
    return placed.groupBy(F.col("own").alias(cluster)).agg(
        F.count("*").alias("rows"), F.avg(F.coalesce(score, F.lit(0.0))).alias("silhouette")
    )


def elbow_k(curve: DataFrame) -> DataFrame:
    """(optimal_k) from (k, inertia): the sharpest bend, 3 when there are too few points.

    The curve has one row per k, nine at most by default.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("k")
    before = F.lag("inertia").over(order) - F.col("inertia")
    after = F.col("inertia") - F.lead("inertia").over(order)
    bends = curve.withColumn("bend", F.try_divide(before, after))
    best = F.max_by("k", F.when(F.col("bend").isNotNull(), F.struct("bend", -F.col("k"))))
    found = F.when(F.count("*") >= 3, best)
    return bends.agg(F.coalesce(found, F.lit(3)).cast("int").alias("optimal_k"))


def cluster_profile(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """(cluster, column, size, percentage, mean, std) of the raw features."""
    total = df.agg(F.count("*")).scalar()
    x = F.col("x")
    pairs = long_form(df, {c: as_double(df, c) for c in features}, [cluster], keep_null=True)
    out = pairs.groupBy(cluster, "column").agg(
        F.count("*").alias("size"), F.avg(x).alias("mean"), sample_std(x).alias("std")
    )
    return out.withColumn("percentage", percent(F.col("size"), total))


def label_by_cluster(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """(cluster, rate, positives, negatives)."""
    return df.where(F.col(label).isNotNull()).groupBy(cluster).agg(
        F.avg(F.col(label).cast("double")).alias("rate"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    )


def cluster_separation(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """Overall rate, the cluster with the highest rate, and whether it doubles overall."""
    per = label_by_cluster(df, label, cluster)
    ones, zeros = F.sum("positives").cast("double"), F.sum("negatives")
    top = F.max_by(cluster, F.struct("rate", -F.col(cluster)))
    row = per.agg(
        F.try_divide(ones, ones + zeros).alias("overall_rate"),
        top.alias("highest_cluster"),
        F.max("rate").alias("highest_rate"),
    )
    return row.withColumn("separates", F.col("highest_rate") > 2 * F.col("overall_rate"))


@dataclass
class Clustering:
    """Result of :func:`analyse_clusters`; ``reason`` is set when nothing was fitted."""

    reason: str | None = None
    curve: DataFrame | None = None
    optimal_k: int | None = None
    centres: DataFrame | None = None
    summary: DataFrame | None = None
    assigned: DataFrame | None = None


def kmeans_sweep(
    data: DataFrame, ks: Sequence[int], n: int, d: int, n_init: int = STARTS, seed: int = SEED
) -> dict[int, kmeans.Model]:
    """The best model of each k with its inertia, and its silhouette for k ≤ 8.

    ``data`` has ``n`` rows with ``d`` standardised values as ``kmeans.VECTOR``. All models move in the same
    scans; one more finds the silhouettes.
    """
    models = kmeans.fit_many(data, ks, n, d, n_init, seed)
    kmeans.add_silhouettes(data, [m for k, m in models.items() if k <= SILHOUETTE_UP_TO], d)
    return models


def analyse_clusters(
    df: DataFrame, features: Sequence[str], n_init: int = STARTS, seed: int = SEED,
    max_k: int = 10,
) -> Clustering:
    """Sweep k, pick the elbow, and assign every complete row by that k's model."""
    if len(features) < 2:
        return Clustering("fewer than two features")
    data = materialise(_standard_vectors(complete_rows(df, features), features))
    n, d = data.count(), len(features)
    if n < 10:
        return Clustering("fewer than ten complete rows")
    spark = df.sparkSession
    models = kmeans_sweep(data, range(2, max(2, min(max_k, n // 10)) + 1), n, d, n_init, seed)
    sweep = [(k, m.inertia, m.silhouette) for k, m in models.items()]
    curve = spark.createDataFrame(sweep, "k int, inertia double, silhouette double")
    best = elbow_k(curve).head().optimal_k
    if best not in models:
        models |= kmeans.fit_many(data, [best], n, d, n_init, seed)
    model = models[best]
    if model.silhouette is None:
        kmeans.add_silhouettes(data, [model], d)
    placed = kmeans.with_cluster(data, model).drop(kmeans.VECTOR)
    centres = [(i, [float(v) for v in c]) for i, c in enumerate(model.centres)]
    return Clustering(
        curve=curve,
        optimal_k=best,
        centres=spark.createDataFrame(centres, "cluster int, centre array<double>"),
        summary=spark.createDataFrame(
            [(best, model.inertia, model.silhouette)], "optimal_k int, inertia double, silhouette double"
        ),
        assigned=placed,
    )
