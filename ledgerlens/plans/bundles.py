"""Profile and pattern bundles, segment profiles and findings."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ledgerlens.functions.stats import percent, tidy
from ledgerlens.operators import classes, clustering, correlation, outliers, profile
from ledgerlens.operators.lookup import hot_groups, lookup_join
from ledgerlens.operators.two_sample import ks_two_sample, largest_differences
from ledgerlens.plans.shared import SharedPasses
from ledgerlens.roles import Roles, as_double, numeric_cols
from ledgerlens.session import materialise


@contextmanager
def shared_input(df: DataFrame):
    """Keep the projected input between the passes of a bundle; spills to disk."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def profile_bundle(
    df: DataFrame, roles: Roles, bins: int = 20, exclude: Sequence[str] = (),
    passes: SharedPasses | None = None,
) -> dict[str, DataFrame]:
    """The seven sections of a profile, from shared passes; wrap ``df`` in
    :func:`shared_input` to read its source once.

    ``passes`` are those of an earlier bundle of the same input, columns and bins.
    """
    p = passes or SharedPasses(df, roles, bins, exclude)
    out = {
        "file_info": p.file_info(),
        "data_types": p.data_types(),
        "numeric_statistics": p.numeric_statistics(),
        "histograms": p.histograms(),
        "percentiles": p.percentiles(),
        **p.missing_sections(),
    }
    if p.flat:
        out["categorical_statistics"] = profile.categorical_summary_of(p.values, p.flat)
        out["value_counts"] = profile.top_values(p.values)
    if roles.time:
        out["time_analysis"] = p.gaps()
    if roles.amount:
        out["amount_analysis"] = p.amount_flags()
    if roles.label:
        out["class_analysis"] = classes.class_balance_of(p.balance())
        if roles.amount:
            out["amount_by_class"] = p.by_class(roles.amount)
    if len(p.cols) > 1:
        out["correlation_matrix"] = correlation.matrix_of(p.pairs, p.diagonal())
        out["high_correlations"] = correlation.high_correlations(df, p.cols, pairs=p.pairs)
    return out


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One tidy row per numeric column: describe table, tails and missing share."""
    cols = list(cols if cols is not None else numeric_cols(df))
    probs = (0.25, 0.5, 0.75, *profile.PERCENTILES)
    names = ("q1", "median", "q3", "p1", "p5", "p10", "p90", "p95", "p99")
    rows = df.agg(F.count("*")).scalar()
    stats = profile.moments(df, cols).withColumn(
        "missing_percentage", percent(rows - F.col("count"), rows)
    )
    return profile.with_quantiles(stats, profile.quantiles(df, cols, probs), names, ())


def analyse_patterns(
    df: DataFrame, roles: Roles, n_init: int = clustering.STARTS, max_k: int = 10,
    exclude: Sequence[str] = (), passes: SharedPasses | None = None,
) -> dict[str, DataFrame]:
    """Every pattern module the roles allow, over all rows, from shared passes.

    ``passes`` are those of an earlier bundle of the same input and columns.
    """
    p = passes or SharedPasses(df, roles, exclude=exclude)
    cols, rows = p.cols, p.totals.rows
    # Every row is analysed; no sample is taken.
    info = "original_size long, analyzed_size long, sampling_applied boolean"
    out = {"dataset_info": p.local([(rows, rows, False)], info)}
    if roles.time:
        out["duration"] = p.duration()
        out["time_gaps"] = p.gaps()
        out["hourly_pattern"] = p.cycle("hour", 24)
        out["weekly_pattern"] = p.cycle("day", 7)
        if roles.label:
            out["time_by_class"] = p.time_by_class()
            out["time_test"] = p.test_of(0, roles.time)
    out |= p.outlier_sections()
    if len(roles.features) > 1:
        found = clustering.analyse_clusters(df, roles.features, n_init, max_k=max_k)
        if found.reason is None:
            out["elbow"] = found.curve
            out["optimal_clustering"] = found.summary
            out["cluster_centres"] = found.centres
            out["cluster_profile"] = clustering.cluster_profile(
                found.assigned, roles.features, "cluster"
            )
            if roles.label:
                out["cluster_separation"] = clustering.cluster_separation(
                    found.assigned, roles.label, "cluster"
                )
    if len(cols) > 1:
        out["correlation_summary"] = correlation.correlation_summary(df, cols, p.pairs)
        out["high_correlations"] = correlation.high_correlations(df, cols, pairs=p.pairs)
        out["strong_correlations"] = correlation.strong_correlations(df, cols, p.pairs)
        if roles.label:
            out["target_top"] = correlation.strongest(p.target())
            out["target_extremes"] = correlation.extremes(p.target())
    if roles.label:
        out["class_balance"] = classes.class_balance_of(p.balance())
        if roles.amount:
            compared = p.by_class(roles.amount)
            out["amount_by_class"] = compared.select(
                roles.label, "column", "mean", "median", "std", "min", "max"
            )
            out["amount_test"] = p.test_of(1, roles.amount)
            out["zero_amounts"] = p.zero_amounts()
        if roles.features:
            out["feature_tests"] = p.feature_tests()
            out["significant_features"] = largest_differences(out["feature_tests"])
    out["key_findings"] = key_findings(
        df, roles, cols, out.get("cluster_separation"), out.get("time_test"), out["outlier_summary"],
        out.get("correlation_summary"), out.get("class_balance"),
    )
    return out


def key_findings(
    df: DataFrame, roles: Roles, cols: Sequence[str] | None = None,
    separation: DataFrame | None = None, timing: DataFrame | None = None,
    outlier_table: DataFrame | None = None, correlations: DataFrame | None = None,
    balance: DataFrame | None = None,
) -> DataFrame:
    """(rule, finding): the sentences whose rule holds, or the default sentence.

    The arguments after ``cols`` are the tables of those rules where they are ready.
    """
    cols = list(cols if cols is not None else numeric_cols(df))
    found: list[DataFrame] = []

    def add(rule: int, table: DataFrame, holds: Column, text: Column) -> None:
        found.append(table.where(holds).select(F.lit(rule).alias("rule"), text.alias("finding")))

    # The sentences of the findings list.
    if roles.time and roles.label:
        if timing is None:
            timing = ks_two_sample(df, [roles.time], roles.label)
        text = "Fraud transactions have significantly different timing patterns"
        add(1, timing, F.col("significant"), F.lit(text))
    if cols:
        total = F.col("total_outliers_iqr")
        text = F.format_string("Detected %d outliers across all features", total)
        if outlier_table is None:
            outlier_table = outliers.outlier_summary(df, cols)
        add(2, outlier_table, total > 0, text)
    if separation is not None:
        text = "Clustering effectively separates fraud from normal transactions"
        add(3, separation, F.col("separates"), F.lit(text))
    if len(cols) > 1:
        high = F.col("correlations_over_05")
        text = F.format_string("Found %d high correlations between variables", high)
        if correlations is None:
            correlations = correlation.correlation_summary(df, cols)
        add(4, correlations, high > 0, text)
    if roles.label:
        both = (F.col("positive_count") > 0) & (F.col("negative_count") > 0)
        text = F.format_string("Dataset has %.2f%% fraud rate", F.col("positive_pct"))
        balance = classes.class_balance(df, roles.label) if balance is None else balance
        add(5, balance, both, text)
    default = F.struct(
        F.lit(0).alias("rule"),
        F.lit("No significant patterns detected in the analysis").alias("finding"),
    )
    if not found:
        return df.sparkSession.range(1).select(F.inline(F.array(default)))
    table = found[0]
    for more in found[1:]:
        table = table.unionByName(more)
    # five rows at most
    listed = F.array_sort(F.collect_list(F.struct("rule", "finding")))
    chosen = F.when(F.size("all") > 0, F.col("all")).otherwise(F.array(default))
    return table.agg(listed.alias("all")).select(F.inline(chosen))


def segment_profile(
    df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None,
    label: str | None = None, method: str = "auto",
) -> DataFrame:
    """Summary, fence outliers and label correlation per segment and column.

    Skewed segments are safe: moments combine map-side, quantiles choose a bounded
    method, and the fences join back broadcast or salted.
    """
    keys = list(by)
    cols = list(cols if cols is not None else numeric_cols(df, [*keys, label] if label else keys))
    # one row per segment and column, read twice below
    summary = materialise(profile.numeric_summary(df, cols, keys, method))
    bounds = summary.groupBy(*[F.col(k).alias(f"b_{k}") for k in keys]).agg(
        F.map_from_entries(
            F.collect_list(F.struct("column", F.struct("q1", "q3").alias("q")))
        ).alias("q")
    )  # one entry per column
    hot = hot_groups(df, keys)
    joined = lookup_join(df, bounds, [(k, f"b_{k}") for k in keys], hot)
    aggs, fields = [], {}
    y = as_double(df, label) if label else None
    for i, c in enumerate(cols):
        q = F.col("q")[c]
        width = outliers.FENCE * (q["q3"] - q["q1"])
        x = as_double(df, c)
        aggs.append(F.count_if((x < q["q1"] - width) | (x > q["q3"] + width)).alias(f"o_{i}"))
        fields[c] = {"outlier_count": f"o_{i}"}
        if label:
            aggs += [
                F.covar_pop(x, y).alias(f"c_{i}"),
                F.stddev_pop(F.when(y.isNotNull(), x)).alias(f"a_{i}"),
                F.stddev_pop(F.when(x.isNotNull(), y)).alias(f"b_{i}"),
            ]
            spread = F.col(f"a_{i}") * F.col(f"b_{i}")
            fields[c]["label_r"] = F.try_divide(F.col(f"c_{i}"), spread)
    extra = tidy(joined.groupBy(*keys).agg(*aggs), fields, keys)
    renamed = extra.select(
        *[F.col(k).alias(f"e_{k}") for k in keys],
        F.col("column").alias("e_column"),
        *[c for c in extra.columns if c not in (*keys, "column")],
    )
    on = F.col("column") == F.col("e_column")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    renamed = renamed if hot is None else renamed.hint("merge")
    return summary.join(renamed, on).drop("e_column", *[f"e_{k}" for k in keys])
