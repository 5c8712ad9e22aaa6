"""Derived insights: importance, risk, interaction, anomaly clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.clustering import STARTS, Clustering, analyse_clusters
from ledgerlens.operators.correlation import target_correlation
from ledgerlens.operators.outliers import METHODS, bounds, flag_outliers
from ledgerlens.operators.quantiles import quantile_values
from ledgerlens.operators.two_sample import t_test_by_class
from ledgerlens.roles import as_double


def feature_importance(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(column, abs_r, abs_t, rank) by |correlation with the label|."""
    r = target_correlation(df, label, features)
    t = t_test_by_class(df, features, label)
    both = r.join(t, r["variable"] == t["column"]).select(
        "column", F.abs("r").alias("abs_r"), F.abs("t_statistic").alias("abs_t")
    )
    # one row per feature
    place = F.array_sort(
        F.collect_list(F.struct((-F.col("abs_r")).alias("k"), "column", "abs_r", "abs_t"))
    )
    return both.agg(place.alias("all")).select(F.posexplode("all").alias("i", "e")).select(
        "e.column", "e.abs_r", "e.abs_t", (F.col("i") + 1).alias("rank")
    )


def risk_score(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Add ``risk``: mean z-score of the features, each signed towards the positives.

    Every feature is signed by its class mean difference; a missing value counts as
    average.
    """
    tests = t_test_by_class(df, features, label).select("column", "mean_difference").collect()
    sign = {r["column"]: -1.0 if (r["mean_difference"] or 0) < 0 else 1.0 for r in tests}
    found = bounds(df, features, ["zscore"])
    total = F.lit(0.0)
    for c in features:
        b = found[c]
        z = F.try_divide(as_double(df, c) - F.lit(b.mean), F.lit(b.std)).cast("double")
        total = total + F.coalesce(z, F.lit(0.0)) * F.lit(sign[c])
    return df.withColumn("risk", total / F.lit(float(max(len(features), 1))))


def _quantile_bin(x: Column, cuts: Sequence[float]) -> Column:
    slot = F.lit(0)
    for cut in cuts:
        slot = slot + (x > F.lit(cut)).cast("int")
    return slot


def interaction(df: DataFrame, a: str, b: str, label: str, bins: int = 4) -> DataFrame:
    """(bin_a, bin_b, rows, rate): label rate over quantile bins of two columns."""
    cuts = quantile_values(df, [a, b], [i / bins for i in range(1, bins)])
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    y = as_double(df, label)
    return rows.groupBy(
        _quantile_bin(as_double(df, a), cuts[a]).alias("bin_a"),
        _quantile_bin(as_double(df, b), cuts[b]).alias("bin_b"),
    ).agg(F.count("*").alias("rows"), F.avg(y).alias("rate"))


def anomaly_clusters(
    df: DataFrame, features: Sequence[str], method: str = "iqr", n_init: int = STARTS,
    max_k: int = 10,
) -> Clustering:
    """Cluster only the rows that are an outlier in some feature."""
    if method not in METHODS:
        raise ValueError(f"unknown outlier method {method!r}")
    flagged = flag_outliers(df, features, [method])
    some = F.lit(False)
    for c in features:
        some = some | F.col(f"{c}_{method}")
    return analyse_clusters(flagged.where(some).select(*df.columns), features, n_init, max_k=max_k)
