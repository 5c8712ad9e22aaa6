"""Hand-computed tables: constants, missing values, ties, edges, tiny inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import tails
from ledgerlens.operators import (
    charts,
    classes,
    clustering,
    correlation,
    error_log,
    lookup,
    outliers,
    profile,
    responses,
    sampling,
    temporal,
    two_sample,
)
from ledgerlens.operators import quantiles as quantile_module
from ledgerlens.operators.histogram import histogram
from ledgerlens.operators.ordered import ordered_quantiles, ordered_sums
from ledgerlens.plans.bundles import key_findings, segment_profile
from ledgerlens.roles import (
    Roles,
    detect_roles,
    is_labelled_format,
    normalise_missing,
    prepare,
)
from ledgerlens.streaming.incremental import finish_profile, merge_partials, partial_profile


def frame(spark, values, name="x", kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# -- profile -------------------------------------------------------------------------


def test_constant_column_has_no_shape(spark):
    row = one(profile.numeric_summary(frame(spark, [3.0] * 6)))
    assert (row["count"], row.mean, row["std"], row.q1, row.skewness, row.kurtosis) == (
        6, 3.0, 0.0, 3.0, None, None,
    )


@pytest.mark.parametrize("values", [[], [None, None], [5.0], [1.0, 2.0]])
def test_small_inputs(spark, values):
    row = one(profile.numeric_summary(frame(spark, values)))
    known = [v for v in values if v is not None]
    assert row["count"] == len(known)
    assert row["std"] == (pd.Series(known).std() if len(known) > 1 else None)
    assert row.median == (float(np.median(known)) if known else None)
    assert row.skewness is None and row.kurtosis is None


def test_wide_tables_keep_empty_columns(spark):
    names = [f"V{i}" for i in range(1, 16)]
    rows = [tuple(None if i == 3 else float(i * r) for i in range(15)) for r in range(5)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    found = {r["column"]: r for r in profile.moments(df).collect()}
    assert len(found) == 15
    assert found["V4"]["count"] == 0 and found["V4"].mean is None
    assert found["V15"].mean == 28.0


def test_nan_and_null_are_both_missing(spark):
    df = frame(spark, [1.0, float("nan"), None, 3.0])
    row = one(profile.missing_by_column(df))
    assert (row.missing_count, row.missing_percentage) == (2, 50.0)
    assert one(profile.numeric_summary(df)).max == 3.0
    assert [r.x for r in normalise_missing(df).collect()].count(None) == 2


def test_na_tokens(spark):
    df = frame(spark, ["a", "NA", " ", "null", None, "Nan"], kind="string")
    assert [r.x for r in normalise_missing(df).collect()] == ["a", None, None, None, None, "Nan"]


def test_top_value_tie_takes_the_smallest(spark):
    row = one(profile.categorical_summary(frame(spark, ["b", "a", "b", "a", "c"], kind="string")))
    assert (row.unique_count, row.most_frequent, row.most_frequent_count) == (3, "a", 2)


def test_narrow_types(spark):
    df = spark.createDataFrame([(127, 128, 1.5, 0.1), (-128, 0, 2.5, 0.2)], "a bigint, b bigint, c double, d double")
    plan = {r["column"]: r.suggested for r in profile.suggest_narrow_types(df).collect()}
    assert plan == {"a": "tinyint", "b": "smallint", "c": "float", "d": "double"}
    assert [t for _, t in profile.narrow_types(df).dtypes] == ["tinyint", "smallint", "float", "double"]


# -- quantiles and ordered sums -------------------------------------------------------


@pytest.mark.parametrize("method", ["builtin", "select", "ordered", "auto"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantile_methods_agree_with_numpy(spark, monkeypatch, method, by):
    monkeypatch.setattr(quantile_module, "MAX_DISTINCT", 50)
    monkeypatch.setattr(quantile_module, "MAX_INSIDE", 20)
    rng = np.random.default_rng(1)
    x = np.where(rng.random(6000) < 0.35, 7.0, np.exp(rng.normal(size=6000) * 3))
    g = rng.integers(0, 3, 6000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": g, "y": np.round(x)})).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.637, 0.99, 1.0]
    for row in quantile_module.quantiles(df, ["x", "y"], probs, by, method).collect():
        chosen = (x if row["column"] == "x" else np.round(x))[g == row.g if by else slice(None)]
        assert np.allclose(row.q, np.quantile(chosen, probs), rtol=1e-12)


def test_select_with_missing_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("b", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    found = quantile_module.quantiles(df, ["x"], [0.5], ["g"], "select").collect()
    assert {r.g: r.q[0] for r in found} == {None: 2.0, "a": None, "b": 5.0}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_ordered_sums_do_not_depend_on_partitions(spark, parts):
    values = [(float(v % 37), v % 2) for v in range(500)]
    df = spark.createDataFrame(values, "x double, y int").repartition(parts)
    rows = ordered_sums(df, F.col("x"), {"n": F.lit(1), "y": F.col("y")}).orderBy("x").collect()
    ref = pd.DataFrame(values, columns=["x", "y"]).groupby("x").agg(n=("y", "size"), y=("y", "sum"))
    assert [r.cum_n for r in rows] == ref.n.cumsum().tolist()
    assert [r.cum_y for r in rows] == ref.y.cumsum().tolist()
    assert [r.prev_x for r in rows] == [None, *[float(i) for i in range(36)]]
    assert {r.tot_n for r in rows} == {500}


def test_weighted_quantile_counts_each_row(spark):
    df = spark.createDataFrame([(1.0, 3), (10.0, 1)], "x double, w int")
    assert one(ordered_quantiles(df, F.col("x"), [0.5, 0.75, 1.0], weight=F.col("w"))).q == [1.0, 3.25, 10.0]


# -- histograms -----------------------------------------------------------------------


@pytest.mark.parametrize("bins", [3, 20, 50])
def test_histogram_equals_numpy(spark, bins):
    values = [round(i * 0.01, 2) for i in range(11)] * 3 + [0.07, 0.1]
    rows = histogram(frame(spark, values), bins=bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=bins)
    assert [r["count"] for r in rows] == counts.tolist()
    assert np.allclose([r.left for r in rows], edges[:-1])
    assert sum(r["count"] for r in rows) == len(values)


def test_histogram_of_a_constant(spark):
    rows = histogram(frame(spark, [1.0] * 4), bins=20).orderBy("bin").collect()
    counts, edges = np.histogram([1.0] * 4, bins=20)
    assert [r["count"] for r in rows] == counts.tolist()
    assert (rows[0].left, rows[-1].right) == (edges[0], edges[-1])


def test_histogram_by_class_has_own_ranges(spark):
    df = spark.createDataFrame([(0.0, 0), (10.0, 0), (4.0, 1), (6.0, 1), (5.0, 2)], "x double, y int")
    own = charts.histogram_by_class(df, ["x"], "y", bins=2).orderBy("y", "bin").collect()
    assert [(r.y, r.left, r["count"]) for r in own] == [(0, 0.0, 1), (0, 5.0, 1), (1, 4.0, 1), (1, 5.0, 1)]
    shared = charts.histogram_by_class(df, ["x"], "y", 2, shared_bins=True).orderBy("y", "bin").collect()
    assert [r.left for r in shared] == [0.0, 5.0, 0.0, 5.0]


# -- classes and tests ------------------------------------------------------------------


def test_missing_class_gives_null_ratio(spark):
    row = one(classes.class_balance(frame(spark, [0, 0, None, 2], "y", "int"), "y"))
    assert (row.total, row.positive_count, row.negative_count) == (4, 0, 2)
    assert row.positive_pct == 0.0 and row.imbalance == 2.0 and row.imbalance_ratio is None


def test_all_tied_samples(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, y int")
    assert one(two_sample.ks_two_sample(df, ["x"], "y")).statistic == 0.0
    row = one(two_sample.mann_whitney_u(df, ["x"], "y"))
    assert row.statistic == 1.0 and row.p_value is None


def test_two_sample_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=400), 1), rng.integers(0, 2, 400)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(7)
    a, b = x[y == 1], x[y == 0]
    grid = np.unique(x)
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    u = sum((a > v).sum() + 0.5 * (a == v).sum() for v in b)
    assert math.isclose(one(two_sample.ks_two_sample(df, ["x"], "y")).statistic, d)
    assert one(two_sample.mann_whitney_u(df, ["x"], "y")).statistic == u
    best = max((((a >= v).mean() - (b >= v).mean()), -v) for v in grid)
    row = one(two_sample.best_threshold(df, "x", "y"))
    assert math.isclose(row.j_statistic, best[0]) and row.threshold == -best[1]


def test_tail_probabilities():
    # published tables: normal 5 %, t 5 % at 10 degrees, Kolmogorov 5 % and 1 %
    assert math.isclose(tails.normal_two_sided(1.959964), 0.05, rel_tol=1e-5)
    assert math.isclose(tails.student_two_sided(2.228139, 10), 0.05, rel_tol=1e-5)
    assert math.isclose(tails.student_two_sided(1.0, 1), 0.5, rel_tol=1e-9)
    assert math.isclose(tails.kolmogorov_tail(1.3581), 0.05, rel_tol=1e-3)
    assert math.isclose(tails.kolmogorov_tail(1.6276), 0.01, rel_tol=1e-3)
    assert math.isclose(tails.kolmogorov_tail(0.8276), 0.5, rel_tol=1e-3)


def test_chi_square_counts_absent_cells(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] * 3, "p string, q string")
    row = one(classes.chi_square(df, "p", "q"))
    assert math.isclose(row.chi_square, 6.0) and row.degrees_of_freedom == 1


# -- correlation ------------------------------------------------------------------------


def test_correlation_paths_agree_with_pandas(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(300, 7)) + 1e6, columns=[f"V{i}" for i in range(1, 8)])
    pdf.loc[::7, "V2"] = np.nan
    pdf.loc[3:50, "V3"] = np.nan
    pdf["V7"] = 5.0
    df = spark.createDataFrame(pdf).repartition(6)
    ref = pdf.corr()
    for few in (100, 0):
        monkeypatch.setattr(correlation, "FEW_PAIRS", few)
        rows = correlation.correlation_pairs(df).collect()
        assert len(rows) == 21
        for r in rows:
            want = ref.loc[r.var1, r.var2]
            assert r.r is None if math.isnan(want) else math.isclose(r.r, want, abs_tol=1e-7)
    assert one(correlation.correlation_summary(df)).undefined_pairs == 6


# -- outliers ---------------------------------------------------------------------------


def test_outlier_methods_on_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, None)] * 9 + [(1.0, 2.0)], "x double, e double")
    iqr = {r["column"]: r for r in outliers.outliers_iqr(df).collect()}
    assert iqr["x"].outlier_count == 0 and iqr["e"].outlier_percentage == 0.0
    z = {r["column"]: r for r in outliers.outliers_zscore(df).collect()}
    assert z["x"].outlier_count == 0 and z["x"].max_zscore is None
    assert outliers.outliers_modified_z(df).count() == 0


def test_fence_is_strict(spark):
    values = [float(v) for v in (1, 2, 3, 4, 5, 9, 20)]
    q1, q3 = np.quantile(values, [0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    edge = frame(spark, [*values])
    row = one(outliers.outliers_iqr(edge))
    assert row.outlier_count == sum(v < low or v > high for v in values)
    assert outliers.iqr_fence_filter(edge, "x").count() == sum(low <= v <= high for v in values)
    assert one(outliers.outlier_samples(edge, methods=["iqr"]))["values"] == [20.0]


# -- time -------------------------------------------------------------------------------


def test_gap_statistics_count_ties(spark):
    t = [0.0, 0.0, 10.0, 10.0, 10.0, 4000.0, 100000.0]
    row = one(temporal.gap_stats(frame(spark, t, "t"), "t"))
    gaps = pd.Series(t).diff().dropna()
    assert (row.gaps, row.min_gap, row.max_gap) == (6, 0.0, 96000.0)
    assert math.isclose(row.mean_gap, gaps.mean()) and math.isclose(row.std_gap, gaps.std())
    assert row.median_gap == gaps.median()
    assert (row.gaps_over_1hour, row.gaps_over_1day) == (2, 1)


@pytest.mark.parametrize("t", [[], [5.0]])
def test_gap_statistics_of_tiny_tables(spark, t):
    row = one(temporal.gap_stats(frame(spark, t, "t"), "t"))
    assert row.mean_gap is None and row.std_gap is None and row.median_gap is None


def test_equal_width_hours_equal_pandas_cut(spark):
    rng = np.random.default_rng(2)
    t = [*np.round(rng.uniform(0, 80000, 300)), 0.0, 79200.0]
    rows = temporal.hourly_pattern(frame(spark, [float(v) for v in t], "t"), "t", "equal_width")
    hours = pd.Series(t) % 86400 / 3600
    want = pd.cut(hours, bins=24, labels=range(24)).value_counts().sort_index().tolist()
    assert [r["count"] for r in rows.orderBy("hour").collect()] == want


def test_weekly_pattern_needs_more_than_a_week(spark):
    assert temporal.weekly_pattern(frame(spark, [0.0, 7 * 86400.0], "t"), "t").count() == 0
    assert temporal.weekly_pattern(frame(spark, [0.0, 7 * 86400.0 + 1], "t"), "t").count() == 7


def test_peak_prefers_the_first(spark):
    df = spark.createDataFrame([(0, 2), (1, 5), (2, 5), (3, 2)], "hour int, count bigint")
    row = one(temporal.peak_and_lowest(df, "hour"))
    assert (row.peak_hour, row.lowest_hour) == (1, 0)


# -- sampling and clustering --------------------------------------------------------------


def test_samples_have_exact_sizes_and_repeat(spark):
    df = spark.range(20000).select("id", (F.col("id") % 50 == 0).cast("int").alias("y"))
    first = {r.id for r in sampling.stratified_sample(df, 1000, "y", "id").collect()}
    again = {r.id for r in sampling.stratified_sample(df.repartition(13), 1000, "y", "id").collect()}
    assert first == again and len(first) == 1000
    assert sum(i % 50 == 0 for i in first) == 20
    assert sampling.boosted_sample(df, 1000, "y", "id").where("y = 1").count() == 100
    assert sampling.stratified_sample(df, 20000, "y", "id").count() == 20000


def test_sample_survives_one_hot_key(spark):
    df = spark.range(3000).select(F.lit(7).cast("bigint").alias("id"), F.col("id").alias("n"))
    assert sampling.simple_sample(df, 1000, "id").count() == 1000


def test_elbow(spark):
    curve = spark.createDataFrame([(2, 100.0), (3, 50.0), (4, 40.0), (5, 38.0)], "k int, inertia double")
    assert one(clustering.elbow_k(curve)).optimal_k == 3
    flat = spark.createDataFrame([(2, 5.0), (3, 5.0), (4, 5.0)], "k int, inertia double")
    assert one(clustering.elbow_k(flat)).optimal_k == 3
    assert one(clustering.elbow_k(curve.limit(2))).optimal_k == 3


def test_clusters_are_found(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(np.concatenate([rng.normal(c, 0.1, size=(40, 2)) for c in (0, 5, 10)]), columns=["V1", "V2"])
    found = clustering.analyse_clusters(spark.createDataFrame(pdf), ["V1", "V2"], n_init=2, max_k=5)
    curve = [r.inertia for r in found.curve.orderBy("k").collect()]
    assert found.optimal_k == 3 and curve[1] < curve[0]
    assert sorted(r["count"] for r in found.assigned.groupBy("cluster").count().collect()) == [40, 40, 40]
    assert found.assigned.select("V1").agg(F.max("V1")).head()[0] > 9
    assert clustering.analyse_clusters(spark.createDataFrame(pdf[:5]), ["V1", "V2"]).reason
    assert clustering.analyse_clusters(spark.createDataFrame(pdf), ["V1"]).reason


# -- rules and responses --------------------------------------------------------------------


def test_error_rules(spark):
    log = spark.createDataFrame(
        [
            ("test.csv not found", "FileNotFoundError"), ("Failed to connect to OpenAI API", None),
            ("Connection timeout", None), ("division by zero", "ZeroDivisionError"),
            ("boom", "MemoryError"), ("bad", "ValueError"), ("API configuration missing", None),
        ],
        "message string, kind string",
    )
    rows = error_log.classify_errors(log, error_type="kind")
    found = [(r.category, r.severity) for r in rows.collect()]
    assert found == [
        ("file_processing", "high"), ("llm_api", "medium"), ("network", "medium"),
        ("system", "medium"), ("system", "critical"), ("validation", "medium"), ("llm_api", "high"),
    ]
    full = error_log.enrich_errors(log).collect()
    assert [r.retry_possible for r in full[:4]] == [False, True, True, True]
    assert full[3].user_message == "A system error occurred. Please try again."
    assert all(len(r.recovery_suggestions) == 3 for r in full)


def test_json_extraction(spark):
    texts = {
        "```json\n{\"a\": {\"b\": 1}}\n```\ntail }": '{"a": {"b": 1}}',
        '{"a": 1} and {"b": 2}': '{"a": 1}',
        "x {\"a\":\n 1} y": '{"a":\n 1}',
        "none": None,
        '{"broken": [': '{"broken": [',
        "```\n```\n{\"c\": 1}": '{"c": 1}',
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "response string")
    assert {r.response: r.json for r in responses.extract_json(df).collect()} == texts


def test_scores(spark):
    docs = [
        ('{"analysis_summary": {"key_findings": ["a"]}, "recommendations": {"x": []}}', 2 / 3 + 0.2, 2 / 3 + 0.2),
        ('{"analysis_summary": 1, "fraud_specific_analysis": 1, "recommendations": {"x": 1}}', 1.0, 1.0),
        ('{"confidence_scores": {"analysis_confidence": 0.9}}', 0.0, (0.9 + 0.5 + 0.5) / 3),
        ("broken {", 0.0, 0.0),
        (None, 0.0, 0.0),
    ]
    df = spark.createDataFrame([(j,) for j, _, _ in docs], "json string")
    rows = responses.confidence_score(responses.completeness_score(df)).collect()
    for row, (_, complete, confident) in zip(rows, docs, strict=True):
        assert math.isclose(row.completeness, complete) and math.isclose(row.confidence, confident)


# -- bundles and state ------------------------------------------------------------------------


def test_roles(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0, float("nan"), 1, "k")], "Time double, V1 double, V2 double, Amount double, Class int, Vendor string")
    roles = detect_roles(df)
    assert roles == Roles("Time", "Amount", "Class", ("V1", "V2"))
    assert is_labelled_format(df.columns) and not is_labelled_format(["Time", "Amount", "V1"])
    assert one(prepare(df, roles)).Amount is None


def test_default_finding(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert [r.finding for r in key_findings(df, Roles()).collect()] == ["No significant patterns detected in the analysis"]


def test_segments_with_null_key(spark):
    rows = [(None, 1.0, 0), (None, 3.0, 1), ("a", 2.0, 0)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    found = {r.g: r for r in segment_profile(df, ["g"], ["x"], "y").collect()}
    assert found[None].mean == 2.0 and math.isclose(found[None].label_r, 1.0) and found["a"].label_r is None


@pytest.mark.parametrize("few", [1000, 0])
def test_salted_lookups_change_nothing(spark, monkeypatch, few):
    monkeypatch.setattr(lookup, "FEW_GROUPS", few)
    rows = [(None if i % 5 == 0 else f"k{i % 3 if i % 2 else 0}", float(i % 17), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, y int").repartition(9)
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    for row in segment_profile(df, ["g"], ["x"], "y").collect():
        x = pdf.x[pdf.g.isna() if row.g is None else pdf.g == row.g]
        assert row["count"] == len(x) and math.isclose(row.median, x.median())
    counted = histogram(df, ["x"], 4, ["g"]).groupBy("g").agg(F.sum("count").alias("n")).collect()
    assert sum(r.n for r in counted) == 400
    for r in counted:
        assert r.n == (pdf.g.isna() if r.g is None else pdf.g == r.g).sum()


def test_partials_merge_to_the_whole(spark):
    rng = np.random.default_rng(9)
    x = np.exp(rng.normal(size=900))
    pieces = [frame(spark, [float(v) for v in part]) for part in (x[:10], x[10:700], x[700:], [])]
    parts = [partial_profile(p, ["x"]) for p in pieces]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    row, s = one(finish_profile(merge_partials(both))), pd.Series(x)
    assert row.n == 900
    for got, want in ((row.mean, s.mean()), (row["std"], s.std()), (row.skewness, s.skew()), (row.kurtosis, s.kurt())):
        assert math.isclose(got, want, rel_tol=1e-9)
    assert np.allclose(row.approx_quantiles, s.quantile([0.25, 0.5, 0.75]), rtol=0.05)
