"""Profile and pattern bundles, by the values of every section, and clustering by value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlens.catalogue.classes import _fence, _modified, _running, _T, _z
from ledgerlens.catalogue.correlations import pair_sql
from ledgerlens.catalogue.profiles import TOP_K, _hist, histogram_sql, percentile_sql, summary_sql, value_table_sql
from ledgerlens.catalogue.registry import TX, register, table, tx, union_all, with_views
from ledgerlens.catalogue.times import _STATS, GAPS, HOURS, cycle_sql
from ledgerlens.operators import clustering, insight
from ledgerlens.plans.bundles import analyse_patterns, profile_bundle, shared_input
from ledgerlens.roles import Roles

# fmt: off

#: Doubles keep five digits, and eight below one, where rates and densities lie.
_ROUND = "CASE WHEN abs(value) < 1 THEN round(value, 8) ELSE round(value, 5) END + 0.0"


def _values(sections: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """(section, item, metric, value) of all numbers and flags; p-values have queries of their own."""
    parts = []
    for name, rows in sections.items():
        named = keys.get(name, [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)])
        metrics = [f.name for f in rows.schema if f.name not in named and f.name not in ("p_value", "significant")
                   and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
        item = F.concat_ws("|", *[F.col(k).cast("string") for k in named])
        parts.append(rows.select(F.lit(name).alias("section"), item.alias("item"), pairs))
    found = reduce(DataFrame.unionByName, parts).where("value IS NOT NULL")
    return found.withColumn("value", F.expr(_ROUND))


def _section(name: str, sql: str, keys: Sequence[str], metrics: Sequence[str]) -> str:
    item = "concat_ws('|', " + ", ".join(f'CAST("{k}" AS VARCHAR)' for k in keys) + ")" if keys else "''"
    pairs = ", ".join(f"{{'metric': '{m}', 'value': CAST(\"{m}\" AS DOUBLE)}}" for m in metrics)
    return f"SELECT '{name}' AS section, {item} AS item, unnest([{pairs}], recursive := true) FROM ({sql})"


def _bundle_sql(*sections: str) -> str:
    return f"SELECT section, item, metric, {_ROUND} AS value FROM ({union_all(sections)}) WHERE value IS NOT NULL"


_SUMMARY = ("count", "mean", "std", "min", "max", "skewness", "kurtosis", "q1", "median", "q3")
_PERCENTILES = ("p1", "p5", "p10", "p90", "p95", "p99")
_GAP = ("gaps", "mean_gap", "median_gap", "std_gap", "min_gap", "max_gap", "gaps_over_1hour", "gaps_over_1day")
_BALANCE = ("total", "positive_count", "negative_count", "positive_pct", "positive_ratio", "imbalance", "imbalance_ratio")
_BALANCE_SQL = """SELECT count(*) AS total, sum(label) AS positive_count, sum(1 - label) AS negative_count, 100.0 * avg(label) AS positive_pct,
avg(label) AS positive_ratio, sum(1 - label) / greatest(sum(label), 1) AS imbalance, sum(1 - label) / nullif(sum(label), 0) AS imbalance_ratio FROM tx"""
_COLUMNS = ("time", "amount", "user_id", "label")
_KINDS = {"event_id": 1, "time": 1, "amount": 1, "user_id": 1, "event_type": 0, "label": 1}


def _matrix(source: str, cols: Sequence[str]) -> str:
    pairs = pair_sql(source, cols)
    return (f"SELECT var1, var2, r FROM ({pairs}) UNION ALL SELECT var2, var1, r FROM ({pairs}) UNION ALL "
            + union_all(f"SELECT '{c}', '{c}', 1.0 FROM {source} HAVING stddev_pop({c}) > 0" for c in cols))


_PROFILE = _bundle_sql(
    _section("file_info", "SELECT count(*) AS total_rows, 6 AS total_columns, count(*) * 48 / 1048576.0 AS estimated_size_mb FROM tx", [], ("total_rows", "total_columns", "estimated_size_mb")),
    _section("data_types", union_all(
        f"SELECT '{c}' AS \"column\", {k} AS is_numeric, {1 - k} AS is_categorical, count(DISTINCT {c}) AS unique_values, 1.0 * count(DISTINCT {c}) / count(*) AS unique_ratio FROM tx"
        for c, k in _KINDS.items()), ["column"], ("is_numeric", "is_categorical", "unique_values", "unique_ratio")),
    _section("numeric_statistics", summary_sql("tx", _COLUMNS, digits=10), ["column"], _SUMMARY),
    _section("histograms", histogram_sql("tx", _COLUMNS, 20), ["column", "bin"], ("left", "right", "center", "count", "density")),
    _section("percentiles", percentile_sql("tx", _COLUMNS), ["column"], _PERCENTILES),
    _section("missing_by_column", union_all(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, 100.0 * (count(*) - count({c})) / count(*) AS missing_percentage FROM tx" for c in _KINDS),
             ["column"], ("missing_count", "missing_percentage")),
    _section("missing_summary", "SELECT n AS total_missing_values, 100.0 * n / (6 * rows) AS percentage_of_total_values FROM (SELECT count(*) AS rows, " + " + ".join(
        f"(count(*) - count({c}))" for c in _KINDS) + " AS n FROM tx)", [], ("total_missing_values", "percentage_of_total_values")),
    _section("categorical_statistics", "SELECT \"column\", count(*) AS unique_count, arg_min(value, (-count, value)) AS most_frequent, max(count) AS most_frequent_count FROM v GROUP BY \"column\"",
             ["column", "most_frequent"], ("unique_count", "most_frequent_count")),
    _section("value_counts", TOP_K, ["column", "value"], ("count", "rank")),
    _section("time_analysis", f"SELECT {_STATS} FROM gaps", [], _GAP),
    _section("amount_analysis", "SELECT count(*) FILTER (amount = 0) AS zero_count, 100.0 * count(*) FILTER (amount = 0) / count(*) AS zero_percentage, " + ", ".join(
        f"count(*) FILTER (amount > {k}) AS over_{k}" for k in (1000, 5000, 10000)) + " FROM tx", [], ("zero_count", "zero_percentage", "over_1000", "over_5000", "over_10000")),
    _section("class_analysis", _BALANCE_SQL, [], _BALANCE),
    _section("amount_by_class", summary_sql("tx", ["amount"], "label", 10), ["label", "column"], _SUMMARY),
    _section("correlation_matrix", _matrix("tx", _COLUMNS), ["var1", "var2"], ("r",)),
    _section("high_correlations", f"SELECT * FROM ({pair_sql('tx', _COLUMNS)}) WHERE abs(r) > 0.5", ["var1", "var2"], ("r",)),
)


@register("profile_bundle", with_views(_PROFILE, TX, GAPS, "v AS (" + value_table_sql("tx", ["event_type"]) + ")"))
def profile_bundle_query(spark, sf_dir):
    """All sections of the profile by value, from one set of passes."""
    roles = Roles("time", "amount", "label")
    with shared_input(tx(spark, sf_dir)) as rows:
        sections = profile_bundle(rows, roles, exclude=["event_id"])
        sections["high_correlations"] = sections["high_correlations"].select("var1", "var2", "r")
        sections["histograms"] = _hist(sections["histograms"])
        return _values(sections, {"histograms": ["column", "bin"], "amount_by_class": ["label", "column"], "data_types": ["column"]})


# Kinds of events lie so far apart in ``a`` and ``b`` that the best five clusters are the
# kinds, and the best fewer ones join neighbours; a mask says after which kinds to cut.
_APART = """SELECT *, kind * 1000000 + amount AS a, kind * 1000000 + user_id % 100 AS b
  FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY event_type) AS DOUBLE) AS kind FROM source)"""
_SCALED = """scaled AS (SELECT kind, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS sa, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS sb FROM apart),
parts AS (SELECT kind, count(*) AS n, sum(sa) AS a, sum(sb) AS b, sum(sa * sa + sb * sb) AS q FROM scaled GROUP BY kind),
cuts AS (SELECT m, kind, n, a, b, q, CAST(list_sum([CASE WHEN kind > j + 1 THEN (m >> j) & 1 ELSE 0 END for j in range(0, 4)]) AS INTEGER) AS part FROM parts, range(16) t(m)),
joined AS (SELECT m, max(part) OVER (PARTITION BY m) + 1 AS k, w FROM (SELECT m, part, sum(q) - (sum(a) ** 2 + sum(b) ** 2) / sum(n) AS w FROM cuts GROUP BY m, part)),
curve AS (SELECT k, min(inertia) AS inertia FROM (SELECT m, any_value(k) AS k, sum(w) AS inertia FROM joined GROUP BY m) WHERE k >= 2 GROUP BY k)"""


def _apart(df: DataFrame) -> DataFrame:
    kinds = [x.event_type for x in df.select("event_type").distinct().orderBy("event_type").collect()]
    kind = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("double") * 1_000_000
    return df.withColumns({"a": kind + F.col("amount"), "b": kind + F.col("user_id") % 100})


@register("kmeans_sweep_apart", with_views(
    "SELECT k, round(inertia, 5) + 0.0 AS inertia FROM curve", TX, f"apart AS ({_APART.replace('source', 'tx')})", _SCALED))
def kmeans_sweep_apart(spark, sf_dir):
    """The best inertia of two to five clusters, over all starts."""
    found = clustering.analyse_clusters(_apart(tx(spark, sf_dir)), ["a", "b"])
    return found.curve.where("k <= 5").select("k", (F.round("inertia", 5) + 0.0).alias("inertia"))


_ODD = """odd AS (SELECT *, CAST(event_id % 50 AS INTEGER) AS spot, CASE event_id % 50 WHEN 0 THEN 5000 WHEN 1 THEN 9000 WHEN 2 THEN -9000 ELSE 0 END + user_id % 10 / 1000.0 AS x,
  CASE event_id % 50 WHEN 0 THEN 5000 WHEN 1 THEN -9000 WHEN 2 THEN -9000 ELSE 0 END + user_id / 1000.0 AS z FROM tx)"""


@register("anomaly_clusters", with_views(
    "SELECT spot, count(*) AS size, round(avg(x), 4) AS x, round(avg(z), 4) AS z FROM odd WHERE spot < 3 GROUP BY spot", TX, _ODD))
def anomaly_clusters(spark, sf_dir):
    """Rows far out in three places: only they are clustered, and the places are the clusters."""
    rows = tx(spark, sf_dir).withColumn("spot", (F.col("event_id") % 50).cast("int"))
    far = lambda *at: F.coalesce(F.get(F.array(*[F.lit(v) for v in at]), F.col("spot")), F.lit(0.0))
    rows = rows.withColumns({"x": far(5000.0, 9000.0, -9000.0) + F.col("user_id") % 10 / 1000, "z": far(5000.0, -9000.0, -9000.0) + F.col("user_id") / 1000})
    found = insight.anomaly_clusters(rows, ["x", "z"], max_k=3)
    sizes = found.assigned.groupBy("cluster").agg(F.min("spot").alias("spot"), F.count("*").alias("size"), F.avg("x").alias("x"), F.avg("z").alias("z"))
    return sizes.select("spot", "size", F.round("x", 4).alias("x"), F.round("z", 4).alias("z"))


_SIX = ("time", "amount", "user_id", "label", "a", "b")
_D = "max(abs(cum1 / n1 - cum0 / n0))"
_FAR = "abs({c} - m) / s > 3"


def _class_stat(c: str, label: int) -> str:
    return f"count({c}) FILTER (label = {label}) AS n{label}, avg({c}) FILTER (label = {label}) AS m{label}, var_samp({c}) FILTER (label = {label}) AS v{label}"


_TESTS = union_all(
    f"SELECT '{c}' AS \"column\", {i} AS position, m1 AS positive_mean, m0 AS negative_mean, sqrt(v1) AS positive_std, sqrt(v0) AS negative_std, "
    f"m1 - m0 AS mean_difference, {_T} AS t_statistic, n1 + n0 - 2 AS degrees_of_freedom FROM (SELECT {_class_stat(c, 1)}, {_class_stat(c, 0)} FROM source)"
    for i, c in enumerate(("a", "b"))).replace("source", "apart")
_OUTLIERS = union_all(
    f"SELECT '{c}' AS col, {i} AS i, count(*) FILTER ({c} < lo OR {c} > hi) AS iqr, count(*) FILTER ({_FAR.format(c=c)}) AS z FROM apart, {_fence('apart', c)}, {_z('apart', c)}"
    for i, c in enumerate(_SIX))
_TARGET = union_all(f"SELECT '{c}' AS variable, corr({c}, label) AS r FROM apart" for c in _SIX if c != "label")
_HIGH = " + ".join(f"CAST(abs(r) > {t} AS INTEGER)" for t in (0.5,))

_PATTERNS = _bundle_sql(
    _section("dataset_info", "SELECT count(*) AS original_size, count(*) AS analyzed_size, FALSE AS sampling_applied FROM tx", [], ("original_size", "analyzed_size", "sampling_applied")),
    _section("duration", "SELECT max(time) - min(time) AS duration_seconds, (max(time) - min(time)) / 3600 AS duration_hours, (max(time) - min(time)) / 86400 AS duration_days, "
             "avg(time) AS mean_time, quantile_cont(time, 0.5) AS median_time FROM tx", [], ("duration_seconds", "duration_hours", "duration_days", "mean_time", "median_time")),
    _section("time_gaps", f"SELECT {_STATS} FROM gaps", [], _GAP),
    _section("hourly_pattern", HOURS, ["hour"], ("count",)),
    _section("weekly_pattern", cycle_sql("floor((time / 86400) % 7)", "day", 7) + " WHERE (SELECT max(time) - min(time) > 7 * 86400 FROM tx)", ["day"], ("count",)),
    _section("time_by_class", "SELECT avg(time) FILTER (label = 1) AS positive_mean_time, avg(time) FILTER (label = 0) AS negative_mean_time, quantile_cont(time, 0.5) FILTER (label = 1) AS positive_median_time, "
             f"quantile_cont(time, 0.5) FILTER (label = 0) AS negative_median_time, any_value(d) AS statistic FROM tx, (SELECT {_D} AS d FROM {_running('tx', 'time')})",
             [], ("positive_mean_time", "negative_mean_time", "positive_median_time", "negative_median_time", "statistic")),
    _section("time_test", f"SELECT col AS \"column\", any_value(n1) AS n1, any_value(n0) AS n0, {_D} AS statistic FROM {_running('tx', 'time')} GROUP BY col", ["column"], ("n1", "n0", "statistic")),
    _section("outliers_iqr", union_all(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count, 100.0 * count(*) FILTER ({c} < lo OR {c} > hi) / count({c}) AS outlier_percentage, any_value(lo) AS lower_bound, "
        f"any_value(hi) AS upper_bound FROM apart, {_fence('apart', c)}" for c in _SIX), ["column"], ("outlier_count", "outlier_percentage", "lower_bound", "upper_bound")),
    _section("outliers_zscore", union_all(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({_FAR.format(c=c)}) AS outlier_count, 100.0 * count(*) FILTER ({_FAR.format(c=c)}) / count({c}) AS outlier_percentage, "
        f"max(abs({c} - m) / s) AS max_zscore, avg(abs({c} - m) / s) AS mean_zscore FROM apart, {_z('apart', c)}" for c in _SIX),
        ["column"], ("outlier_count", "outlier_percentage", "max_zscore", "mean_zscore")),
    _section("outliers_modified_zscore", union_all(_modified("apart", c) for c in _SIX), ["column"], ("outlier_count", "outlier_percentage", "median", "mad")),
    _section("outlier_summary", f"SELECT sum(iqr) AS total_outliers_iqr, sum(z) AS total_outliers_zscore, count(*) AS columns_analyzed, arg_max(col, (iqr, -i)) AS most_outliers_column FROM ({_OUTLIERS})",
             ["most_outliers_column"], ("total_outliers_iqr", "total_outliers_zscore", "columns_analyzed")),
    _section("outlier_label_rate", union_all(
        f"SELECT '{c}' AS \"column\", avg(label) AS overall_rate, coalesce(avg(label) FILTER ({c} < lo OR {c} > hi), 0) AS outlier_rate, "
        f"coalesce(avg(label) FILTER ({c} < lo OR {c} > hi), 0) > avg(label) AS more_likely FROM apart, {_fence('apart', c)}" for c in _SIX),
        ["column"], ("overall_rate", "outlier_rate", "more_likely")),
    _section("elbow", "SELECT * FROM curve", ["k"], ("inertia",)),
    _section("optimal_clustering", "SELECT k AS optimal_k, inertia FROM curve WHERE k = 5", [], ("optimal_k", "inertia")),
    _section("cluster_profile", union_all(
        f"SELECT '{c}' AS \"column\", CAST(kind AS INTEGER) AS place, count(*) AS size, avg({c}) AS mean, stddev_samp({c}) AS std, 100.0 * count(*) / any_value(n) AS percentage "
        "FROM apart, (SELECT count(*) AS n FROM apart) GROUP BY kind" for c in ("a", "b")), ["column", "place"], ("size", "mean", "std", "percentage")),
    _section("cluster_separation", "SELECT avg(label) AS overall_rate, 1.0 AS highest_rate, TRUE AS separates FROM apart", [], ("overall_rate", "highest_rate", "separates")),
    _section("correlation_summary", "SELECT avg(abs(r)) AS mean_correlation, max(abs(r)) AS max_correlation, count(*) FILTER (abs(r) > 0.5) AS correlations_over_05, "
             f"count(*) FILTER (abs(r) > 0.8) AS correlations_over_08, count(*) AS total_pairs, 0 AS undefined_pairs FROM ({pair_sql('apart', _SIX)})",
             [], ("mean_correlation", "max_correlation", "correlations_over_05", "correlations_over_08", "total_pairs", "undefined_pairs")),
    *(_section(name, f"SELECT * FROM ({pair_sql('apart', _SIX)}) WHERE abs(r) > {least}", ["var1", "var2"], ("r",)) for name, least in (("high_correlations", 0.5), ("strong_correlations", 0.8))),
    _section("target_top", _TARGET, ["variable"], ("r",)),
    _section("target_extremes", f"SELECT arg_max(variable, r) AS strongest_positive, arg_min(variable, r) AS strongest_negative, max(r) AS positive_r, min(r) AS negative_r FROM ({_TARGET})",
             ["strongest_positive", "strongest_negative"], ("positive_r", "negative_r")),
    _section("class_balance", _BALANCE_SQL, [], _BALANCE),
    _section("amount_by_class", summary_sql("tx", ["amount"], "label", 10), ["label", "column"], ("mean", "median", "std", "min", "max")),
    _section("amount_test", "SELECT col AS \"column\", any_value(n1) AS n1, any_value(n0) AS n0, CAST(sum(c1 * (cum1 + cum0 - (c1 + c0) + (c1 + c0 + 1) / 2.0)) - any_value(n1) * (any_value(n1) + 1) / 2.0 AS DOUBLE) AS statistic, "
             f"CAST(sum(CAST(c1 + c0 AS DOUBLE) ** 3 - (c1 + c0)) AS DOUBLE) AS tie_term FROM {_running('tx', 'amount')} GROUP BY col", ["column"], ("n1", "n0", "statistic", "tie_term")),
    _section("zero_amounts", "SELECT label, count(*) FILTER (amount = 0) AS zero_count, 100.0 * count(*) FILTER (amount = 0) / count(*) AS zero_percentage FROM tx GROUP BY label", ["label"], ("zero_count", "zero_percentage")),
    _section("feature_tests", _TESTS, ["column"], ("position", "positive_mean", "negative_mean", "positive_std", "negative_std", "mean_difference", "t_statistic", "degrees_of_freedom")),
    _section("key_findings", f"""SELECT 2 AS rule, printf('Detected %d outliers across all features', CAST(n AS BIGINT)) AS finding FROM (SELECT sum(iqr) AS n FROM ({_OUTLIERS}))
UNION ALL SELECT 3, 'Clustering effectively separates fraud from normal transactions'
UNION ALL SELECT 4, printf('Found %d high correlations between variables', count(*)) FROM ({pair_sql('apart', _SIX)}) WHERE abs(r) > 0.5
UNION ALL SELECT 5, printf('Dataset has %.2f%% fraud rate', 100.0 * avg(label)) FROM tx""", ["finding"], ("rule",)),
)


@register("pattern_bundle", with_views(_PATTERNS, TX, GAPS, f"apart AS ({_APART.replace('source', 'tx')})", _SCALED))
def pattern_bundle(spark, sf_dir):
    """All modules of the patterns by value, clustering included, from one set of passes."""
    roles = Roles("time", "amount", "label", ("a", "b"))
    with shared_input(_apart(tx(spark, sf_dir))) as rows:
        found = analyse_patterns(rows, roles, exclude=["event_id"])
        found["elbow"] = found["elbow"].where("k <= 5").select("k", "inertia")
        found["optimal_clustering"] = found["optimal_clustering"].select("optimal_k", "inertia")
        place = F.row_number().over(Window.partitionBy("column").orderBy("mean"))  # ten rows
        found["cluster_profile"] = found["cluster_profile"].withColumn("place", place).drop("cluster")
        found["cluster_separation"] = found["cluster_separation"].drop("highest_cluster")
        for name in ("high_correlations", "strong_correlations"):
            found[name] = found[name].select("var1", "var2", "r")
        # The centres are those of the cluster profile, standardised; the five best features
        # are rows of the tests.
        for name in ("cluster_centres", "significant_features"):
            del found[name]
        keys = {"hourly_pattern": ["hour"], "weekly_pattern": ["day"], "elbow": ["k"], "cluster_profile": ["column", "place"],
                "amount_by_class": ["label", "column"], "zero_amounts": ["label"], "feature_tests": ["column"]}
        return _values(found, keys)


@register("distinct_counts_within_error", "SELECT 'o_custkey' AS \"column\", TRUE AS within UNION ALL SELECT 'o_orderkey', TRUE UNION ALL SELECT 'o_orderpriority', TRUE")
def distinct_counts_within_error(spark, sf_dir):
    """The sketch is within three of its standard deviations (5 %) of the exact count."""
    from ledgerlens.operators.profile import distinct_counts

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    near = distinct_counts(orders, approx=True).withColumnRenamed("unique_values", "near")
    off = F.abs(F.col("near") - F.col("unique_values")) <= 0.15 * F.col("unique_values")
    return near.join(distinct_counts(orders), "column").select("column", off.alias("within"))
