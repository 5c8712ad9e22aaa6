"""Segment profiles beyond the summary, and frequent values by sketch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.catalogue.profiles import TOP_K, _hist, histogram_sql, value_table_sql
from ledgerlens.catalogue.registry import FEAT, TX, feat, r, register, rounded, table, tx, union_all, with_views
from ledgerlens.operators import profile
from ledgerlens.plans import segments

# fmt: off

_PROBS = (0.01, 0.05, 0.1, 0.9, 0.95, 0.99)


@register("segment_percentiles", with_views(union_all(
    f"SELECT event_type, '{c}' AS \"column\", " + ", ".join(f"{r(f'quantile_cont({c}, {p})')} AS p{round(p * 100)}" for p in _PROBS) + " FROM tx GROUP BY event_type"
    for c in ("amount", "user_id")), TX))
def segment_percentiles(spark, sf_dir):
    return rounded(segments.segment_sections(tx(spark, sf_dir), ["event_type"], ["amount", "user_id"])["percentiles"])


@register("segment_histogram", with_views(histogram_sql("tx", ["amount"], 20, "event_type"), TX))
def segment_histogram(spark, sf_dir):
    """Every segment over its own range."""
    return _hist(segments.segment_sections(tx(spark, sf_dir), ["event_type"], ["amount"])["histogram"])


def _outliers_sql(source: str, by: str, cols) -> str:
    return union_all(
        f"""SELECT {by}, '{c}' AS "column", count({c}) AS rows, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers_iqr,
{r(f'100.0 * count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c})', 7)} AS percentage_iqr, count(*) FILTER (abs({c} - m) / s > 3) AS outliers_zscore,
{r(f'max(abs({c} - m) / s)', 7)} AS max_zscore, {r(f'avg(abs({c} - m) / s)', 7)} AS mean_zscore,
CASE WHEN any_value(md) > 0 THEN count(*) FILTER (abs(0.6745 * ({c} - med) / nullif(md, 0)) > 3.5) END AS outliers_modified_z
FROM {source} JOIN (SELECT {by} AS g, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_pop({c}) AS s, mad({c}) AS md
FROM {source} GROUP BY {by}) ON g = {by} GROUP BY {by}""" for c in cols)


@register("segment_outliers", with_views(_outliers_sql("tx", "event_type", ("amount", "user_id", "time")), TX))
def segment_outliers(spark, sf_dir):
    return rounded(segments.segment_outliers(tx(spark, sf_dir), ["event_type"], ["amount", "user_id", "time"]), 7)


@register("segment_outliers_users", with_views(_outliers_sql("tx", "user_id", ("amount",)), TX))
def segment_outliers_users(spark, sf_dir):
    """Many small segments, by the method for many groups."""
    return rounded(segments.segment_outliers(tx(spark, sf_dir), ["user_id"], ["amount"], method="ordered"), 7)


_PAIR_COLUMNS = ("quantity", "price", "discount", "tax")


@register("segment_pairs", with_views(union_all(
    f"SELECT l_linestatus, '{a}' AS var1, '{b}' AS var2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, {r(f'corr({a}, {b})')} AS r FROM feat GROUP BY l_linestatus"
    for i, a in enumerate(_PAIR_COLUMNS) for b in _PAIR_COLUMNS[i + 1:]), FEAT))
def segment_pairs(spark, sf_dir):
    return rounded(segments.segment_pairs(feat(spark, sf_dir), ["l_linestatus"], _PAIR_COLUMNS))


@register("frequent_values", with_views(TOP_K.replace("20", "10") , "v AS (" + value_table_sql("part", ["p_brand", "p_type"]) + ")"))
def frequent_values(spark, sf_dir):
    """The most frequent values from a sketch's candidates, counted exactly."""
    found = profile.frequent_values(table(spark, sf_dir, "part"), 10, ["p_brand", "p_type"])
    return found.select("column", "value", "count", F.col("rank").cast("int").alias("rank"))
