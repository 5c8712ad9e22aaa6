"""Sampling and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalogue.registry import (
    EMB, EMB_FEATURES, TX, emb, r, register, rounded, table, tx, union_all, with_views,
)
from ledgerlens.operators import charts, clustering, sampling, silhouettes

# fmt: off

HASHED = "hashed AS (SELECT *, ('0x' || substring(md5(event_id || ':42'), 1, 8))::BIGINT AS h FROM tx)"


def _quota_sql(cols: str, ones: str, n: int) -> str:
    return f"""SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, event_id) AS k FROM hashed),
  (SELECT *, least(n1, {ones}) AS take FROM (SELECT count(*) AS n, count(*) FILTER (label = 1) AS n1 FROM tx))
WHERE n <= {n} OR (label = 1 AND k <= take) OR (label = 0 AND k <= {n} - take)"""


@register("stratified_sample", with_views(_quota_sql("event_id, label", "CAST(floor(500 * (n1 * 1.0 / n)) AS BIGINT)", 500), TX, HASHED))
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(tx(spark, sf_dir), 500, "label", "event_id").select("event_id", "label")


@register("boosted_sample", with_views(_quota_sql("event_id, label", "50", 500), TX, HASHED))
def boosted_sample(spark, sf_dir):
    return sampling.boosted_sample(tx(spark, sf_dir), 500, "label", "event_id").select("event_id", "label")


@register("simple_sample", with_views("SELECT event_id FROM hashed ORDER BY h, event_id LIMIT 500", TX, HASHED))
def simple_sample(spark, sf_dir):
    return sampling.simple_sample(tx(spark, sf_dir), 500, "event_id").select("event_id")


@register("scatter_points", with_views(
    f"SELECT event_id, 'scatter_time_amount' AS chart, {r('time')} AS x, amount AS y, label FROM ({_quota_sql('event_id, time, amount, label', '50', 500)})", TX, HASHED))
def scatter_points(spark, sf_dir):
    return rounded(charts.scatter_points(tx(spark, sf_dir), [("time", "amount")], "label", "event_id", 500))


@register("sampling_info", "SELECT count(*) AS original_size, least(count(*), 50000) AS analyzed_size, count(*) > 50000 AS sampling_applied FROM lineitem")
def sampling_info(spark, sf_dir):
    return sampling.sampling_info(table(spark, sf_dir, "lineitem"), 50_000)


@register("head_sample", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100")
def head_sample(spark, sf_dir):
    return sampling.head_sample(table(spark, sf_dir, "events"), 100, "event_id").select("event_id", "event_type")


# -- clustering -----------------------------------------------------------------------

@register("standardise", with_views(
    f"SELECT event_id, {r('(amount - m) / s', 6)} AS amount FROM tx, (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM tx)", TX))
def standardise(spark, sf_dir):
    return rounded(clustering.standardise(tx(spark, sf_dir), ["amount"]).select("event_id", "amount"), 6)


@register("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    """(k, inertia, silhouette) and the chosen k; initialisation depends on partitioning."""
    found = clustering.analyse_clusters(emb(spark, sf_dir), EMB_FEATURES)
    return found.curve.withColumn("optimal_k", F.lit(found.optimal_k))


# Event types lie so far apart that the best five clusters are the types.
_APART = "apart AS (SELECT " + ", ".join(
    f"({{kind}}) * 1000000 + {e} AS {c}" for c, e in (("a", "value"), ("b", "user_id % 100"))) + " FROM events)"


@register("final_clustering", with_views(
    f"SELECT count(*) AS size, {r('avg(a)', 4)} AS a, {r('avg(b)', 4)} AS b FROM apart GROUP BY floor(b / 1000000)",
    _APART.format(kind="dense_rank() OVER (ORDER BY event_type)")))
def final_clustering(spark, sf_dir):
    """Size and centre of every cluster with the elbow's k."""
    events = table(spark, sf_dir, "events")
    kinds = [x.event_type for x in events.select("event_type").distinct().orderBy("event_type").collect()]
    kind = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")) * 1_000_000
    apart = events.select((kind + F.col("value")).alias("a"), (kind + F.col("user_id") % 100).cast("double").alias("b"))
    found = clustering.analyse_clusters(apart, ["a", "b"], n_init=3)
    sizes = found.assigned.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    return rounded(sizes.drop("cluster"), 4)


# nested groupings of the given clusters: a deterministic falling inertia curve
_MEANS = ", ".join(f"var_pop({c}) * count(*)" for c in EMB_FEATURES)
_CURVE = union_all(
    f"SELECT {k} AS k, sum(w) AS inertia FROM (SELECT list_sum([{_MEANS}]) AS w FROM emb GROUP BY least(cluster, {k - 1}))" for k in range(2, 9))


def _curve(spark, sf_dir):
    df = emb(spark, sf_dir)
    inside = sum((F.var_pop(c) * F.count("*") for c in EMB_FEATURES[1:]), F.var_pop("V1") * F.count("*"))
    out = None
    for k in range(2, 9):
        part = df.groupBy(F.least("cluster", F.lit(k - 1)).alias("g")).agg(inside.alias("w"))
        part = part.agg(F.sum("w").alias("inertia")).select(F.lit(k).alias("k"), "inertia")
        out = part if out is None else out.unionByName(part)
    return out


@register("elbow_k", with_views(
    "SELECT CAST(coalesce(arg_max(k, (bend, -k)), 3) AS INTEGER) AS optimal_k FROM (SELECT k, (lag(inertia) OVER (ORDER BY k) - inertia) / "
    "nullif(inertia - lead(inertia) OVER (ORDER BY k), 0) AS bend FROM curve) WHERE bend IS NOT NULL", EMB, f"curve AS ({_CURVE})"))
def elbow_k(spark, sf_dir):
    return clustering.elbow_k(_curve(spark, sf_dir))


@register("elbow_curve", with_views(f"SELECT k, {r('inertia')} AS inertia FROM curve", EMB, f"curve AS ({_CURVE})"))
def elbow_curve(spark, sf_dir):
    return rounded(_curve(spark, sf_dir))


_PAIRS = """points AS (SELECT vec_id, label AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pairs AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS other, avg_d, total, n FROM points a,
  LATERAL (SELECT cluster, avg(DIST) AS avg_d, sum(DIST) AS total, count(*) AS n FROM (SELECT cluster, list_distance(a.x, p.x) AS d FROM points p) GROUP BY cluster) b),
scored AS (SELECT vec_id, own, max(total / nullif(n - 1, 0)) FILTER (own = other) AS a, min(avg_d) FILTER (own <> other) AS b FROM pairs GROUP BY vec_id, own)"""


@register("silhouette_by_cluster", with_views(
    f"SELECT own AS cluster, count(*) AS rows, {r('avg(coalesce((b - a) / greatest(a, b), 0))')} AS silhouette FROM scored GROUP BY own", _PAIRS.replace("DIST", "d * d")))
def silhouette_by_cluster(spark, sf_dir):
    return rounded(clustering.silhouette_by_cluster(emb(spark, sf_dir), EMB_FEATURES, "cluster"))


@register("silhouette_many_clusters", with_views(
    f"SELECT own AS cluster, count(*) AS rows, {r('avg(coalesce((b - a) / greatest(a, b), 0))')} AS silhouette FROM scored GROUP BY own", _PAIRS.replace("DIST", "d * d")))
def silhouette_many_clusters(spark, sf_dir):
    """The form for any number of clusters, with centres in blocks."""
    return rounded(silhouettes.silhouette_of_many_clusters(emb(spark, sf_dir), EMB_FEATURES, "cluster"))


@register("silhouette_euclidean", with_views(
    f"SELECT own AS cluster, count(*) AS rows, {r('avg(coalesce((b - a) / greatest(a, b), 0))')} AS silhouette FROM scored WHERE vec_id % 100 = 0 GROUP BY own", _PAIRS.replace("DIST", "d")))
def silhouette_euclidean(spark, sf_dir):
    """Every row whose id is divisible by 100, against all rows."""
    rows = emb(spark, sf_dir)
    return rounded(silhouettes.silhouette_euclidean(rows, EMB_FEATURES, "cluster", F.col("vec_id") % 100 == 0))


@register("cluster_profile", with_views(union_all(
    f"SELECT cluster, '{c}' AS \"column\", count(*) AS size, {r('100.0 * count(*) / (SELECT count(*) FROM emb)')} AS percentage, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std "
    "FROM emb GROUP BY cluster" for c in EMB_FEATURES), EMB))
def cluster_profile(spark, sf_dir):
    return rounded(clustering.cluster_profile(emb(spark, sf_dir), EMB_FEATURES, "cluster"))


BY_TYPE = "typed AS (SELECT *, user_id % 7 AS cluster FROM tx)"


def _typed(spark, sf_dir):
    return tx(spark, sf_dir).withColumn("cluster", F.col("user_id") % 7)


@register("label_by_cluster", with_views(
    f"SELECT cluster, {r('avg(label)')} AS rate, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM typed GROUP BY cluster", TX, BY_TYPE))
def label_by_cluster(spark, sf_dir):
    return rounded(clustering.label_by_cluster(_typed(spark, sf_dir), "label", "cluster"))


@register("cluster_separation", with_views(
    f"SELECT {r('any_value(o)')} AS overall_rate, arg_max(cluster, (rate, -cluster)) AS highest_cluster, {r('max(rate)')} AS highest_rate, max(rate) > 2 * any_value(o) AS separates "
    "FROM (SELECT cluster, avg(label) AS rate FROM typed GROUP BY cluster), (SELECT avg(label) AS o FROM typed)", TX, BY_TYPE))
def cluster_separation(spark, sf_dir):
    return rounded(clustering.cluster_separation(_typed(spark, sf_dir), "label", "cluster"))
