"""Correlation queries: a narrow table (aggregate path) and a wide one (block path)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalogue.registry import (
    DOC, EMB, EMB_FEATURES, FEAT, FEATURES, doc, emb, feat, r, register, rounded, table, union_all,
    with_views,
)
from ledgerlens.operators import correlation

# fmt: off

NARROW = [*FEATURES, "label"]
ORDERED = ["quantity", "price", "mixed"]


def pair_sql(source: str, cols) -> str:
    """All i < j pairs; one scan with a list of correlations."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    values = ", ".join(
        f"{{'i': {i}, 'j': {j}, 'var1': '{cols[i]}', 'var2': '{cols[j]}', 'r': corr({cols[i]}, {cols[j]})}}" for i, j in pairs)
    return f"SELECT unnest([{values}], recursive := true) FROM {source}"


@register("correlation_pairs", with_views(f"SELECT var1, var2, {r('r')} AS r FROM ({pair_sql('feat', NARROW)})", FEAT))
def correlation_pairs(spark, sf_dir):
    return rounded(correlation.correlation_pairs(feat(spark, sf_dir), NARROW).select("var1", "var2", "r"))


@register("correlation_with_missing", with_views(union_all(
    f"SELECT '{a}' AS var1, '{b}' AS var2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, {r(f'corr({a}, {b})')} AS r FROM doc"
    for a, b in (("n_chars", "quality"), ("n_chars", "toxic"), ("quality", "toxic"))), DOC))
def correlation_with_missing(spark, sf_dir):
    found = correlation.correlation_pairs(doc(spark, sf_dir), ["n_chars", "quality", "toxic"])
    return rounded(found.select("var1", "var2", "n", "r"))


_MATRIX = (f"SELECT var1, var2, r FROM ({pair_sql('feat', NARROW)}) UNION ALL SELECT var2, var1, r FROM ({pair_sql('feat', NARROW)}) "
           "UNION ALL " + union_all(f"SELECT '{c}', '{c}', 1.0 FROM feat HAVING stddev_pop({c}) > 0" for c in NARROW))


@register("correlation_matrix", with_views(f"SELECT var1, var2, {r('r')} AS r FROM ({_MATRIX})", FEAT))
def correlation_matrix(spark, sf_dir):
    return rounded(correlation.correlation_matrix(feat(spark, sf_dir), NARROW))


@register("correlation_wide", with_views(f"SELECT var1, var2, {r('r')} AS r FROM ({pair_sql('emb', EMB_FEATURES)})", EMB))
def correlation_wide(spark, sf_dir):
    return rounded(correlation.correlation_pairs(emb(spark, sf_dir), EMB_FEATURES).select("var1", "var2", "r"))


def _related(spark, sf_dir):
    """lineitem with columns that depend on each other, so that high pairs exist."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        (F.col("l_quantity") * 3 + F.col("l_discount") * 10).alias("near"),
        (F.col("l_quantity") * 1000 + F.col("l_extendedprice")).alias("mixed"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"))


RELATED = """related AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_quantity * 3 + l_discount * 10 AS near,
  l_quantity * 1000 + l_extendedprice AS mixed, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"""
REL = ["quantity", "price", "near", "mixed", "label"]


@register("high_correlations", with_views(
    f"SELECT var1, var2, {r('r')} AS r, CASE WHEN abs(r) > 0.8 THEN 'very_high' ELSE 'high' END AS strength FROM ({pair_sql('related', REL)}) "
    "WHERE abs(r) > 0.5 ORDER BY i, j LIMIT 20", RELATED))
def high_correlations(spark, sf_dir):
    found = correlation.high_correlations(_related(spark, sf_dir), REL, limit=20)
    return rounded(found.select("var1", "var2", "r", "strength"))


@register("strong_correlations", with_views(
    f"SELECT var1, var2, {r('r')} AS r, 'very_high' AS strength FROM ({pair_sql('related', REL)}) WHERE abs(r) > 0.8", RELATED))
def strong_correlations(spark, sf_dir):
    return rounded(correlation.strong_correlations(_related(spark, sf_dir), REL).select("var1", "var2", "r", "strength"))


@register("feature_pairs", with_views(
    f"SELECT var1, var2, {r('r')} AS r FROM ({pair_sql('emb', EMB_FEATURES)}) WHERE abs(r) > 0.3 ORDER BY abs(r) DESC, i, j LIMIT 10", EMB))
def feature_pairs(spark, sf_dir):
    return rounded(correlation.feature_pairs(emb(spark, sf_dir), EMB_FEATURES))


_TARGET = union_all(f"SELECT '{c}' AS variable, corr({c}, label) AS r FROM emb" for c in EMB_FEATURES)


@register("target_correlation", with_views(f"SELECT variable, {r('r')} AS r FROM ({_TARGET})", EMB))
def target_correlation(spark, sf_dir):
    return rounded(correlation.target_correlation(emb(spark, sf_dir), "label", EMB_FEATURES))


@register("target_top", with_views(f"SELECT variable, {r('r')} AS r FROM ({_TARGET}) ORDER BY abs(r) DESC, variable LIMIT 10", EMB))
def target_top(spark, sf_dir):
    return rounded(correlation.target_top(emb(spark, sf_dir), "label", 10, EMB_FEATURES))


@register("target_extremes", with_views(
    f"SELECT arg_max(variable, r) AS strongest_positive, {r('max(r)')} AS positive_r, arg_min(variable, r) AS strongest_negative, {r('min(r)')} AS negative_r "
    f"FROM ({_TARGET})", EMB))
def target_extremes(spark, sf_dir):
    return rounded(correlation.target_extremes(emb(spark, sf_dir), "label", EMB_FEATURES))


@register("correlation_summary", with_views(
    f"SELECT {r('avg(abs(r))')} AS mean_correlation, {r('max(abs(r))')} AS max_correlation, count(*) FILTER (abs(r) > 0.5) AS correlations_over_05, "
    f"count(*) FILTER (abs(r) > 0.8) AS correlations_over_08, count(*) AS total_pairs, count(*) FILTER (r IS NULL) AS undefined_pairs "
    f"FROM ({pair_sql('related', REL)})", RELATED))
def correlation_summary(spark, sf_dir):
    return rounded(correlation.correlation_summary(_related(spark, sf_dir), REL))


@register("heatmap", with_views(f"SELECT var2 AS var1, var1 AS var2, {r('r')} AS r FROM ({pair_sql('emb', EMB_FEATURES)})", EMB))
def heatmap(spark, sf_dir):
    return rounded(correlation.heatmap(emb(spark, sf_dir), EMB_FEATURES))
