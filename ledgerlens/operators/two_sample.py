"""Two-sample tests of label 1 against label 0, several columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.stats import long_form
from ledgerlens.functions.tails import d_p, kolmogorov_p, normal_p, student_p, u_p
from ledgerlens.operators.classes import labelled
from ledgerlens.operators.ordered import ordered_sums
from ledgerlens.operators.quantiles import expressions

ALPHA = 0.05


def class_counts_in_order(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Running class counts over the distinct values of every column."""
    pairs = long_form(labelled(df, label), expressions(df, cols), [label])
    ones = F.when(F.col(label) == 1, 1).otherwise(0)
    return ordered_sums(pairs, F.col("x"), {"c1": ones, "c0": 1 - ones}, ["column"])


def ks_two_sample(
    df: DataFrame, cols: Sequence[str], label: str, exact: bool = True
) -> DataFrame:
    """Kolmogorov–Smirnov D and p per column; p is exact for small samples unless ``exact``
    is off (see :mod:`ledgerlens.functions.tails`)."""
    return ks_of(class_counts_in_order(df, cols, label), exact)


def ks_of(o: DataFrame, exact: bool = True) -> DataFrame:
    """:func:`ks_two_sample` from running class counts."""
    gap = F.abs(
        F.try_divide(F.col("cum_c1").cast("double"), "tot_c1")
        - F.try_divide(F.col("cum_c0").cast("double"), "tot_c0")
    )
    found = o.groupBy("column").agg(
        F.max("tot_c1").alias("n1"), F.max("tot_c0").alias("n0"), F.max(gap).alias("statistic")
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    scaled = F.sqrt(F.try_divide(n1 * n0, n1 + n0)) * F.col("statistic")
    both = (n1 > 0) & (n0 > 0)
    p = d_p("statistic", F.when(both, n1), F.when(both, n0)) if exact else kolmogorov_p(scaled)
    return found.withColumn("p_value", p).withColumn(
        "significant", F.col("p_value") < ALPHA
    )


def mann_whitney_u(
    df: DataFrame, cols: Sequence[str], label: str, exact: bool = True
) -> DataFrame:
    """U of the positive class and p per column: exact for small samples without ties unless
    ``exact`` is off, else normal with tie and continuity correction."""
    return mann_whitney_of(class_counts_in_order(df, cols, label), exact)


def mann_whitney_of(o: DataFrame, exact: bool = True) -> DataFrame:
    """:func:`mann_whitney_u` from running class counts."""
    ties = (F.col("c1") + F.col("c0")).cast("double")
    upto = (F.col("cum_c1") + F.col("cum_c0")).cast("double")
    rank = upto - ties + (ties + 1) / 2
    found = o.groupBy("column").agg(
        F.max("tot_c1").cast("double").alias("n1"),
        F.max("tot_c0").cast("double").alias("n0"),
        F.sum(F.col("c1") * rank).alias("rank_sum"),
        F.sum(ties * ties * ties - ties).alias("tie_term"),
    )
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    found = found.withColumn(
        "statistic", F.when((n1 > 0) & (n0 > 0), F.col("rank_sum") - n1 * (n1 + 1) / 2)
    )
    spread = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    off = F.greatest(F.abs(F.col("statistic") - n1 * n0 / 2) - 0.5, F.lit(0.0))
    z = F.try_divide(off, spread)
    # One value on either side has no spread without ties, but an exact p.
    z = F.coalesce(z, F.when(F.col("tie_term") == 0, 0.0))
    p = u_p("statistic", n1, n0, "tie_term", z) if exact else normal_p(z)
    found = found.withColumn("p_value", p)
    return found.select(
        "column", n1.cast("bigint").alias("n1"), n0.cast("bigint").alias("n0"),
        "statistic", "tie_term", "p_value", (F.col("p_value") < ALPHA).alias("significant"),
    )


def t_test_by_class(
    df: DataFrame, cols: Sequence[str], label: str, limit: int | None = None
) -> DataFrame:
    """Pooled-variance t, p, mean difference and class moments, in column order.

    ``limit`` keeps the first columns of the list, as a report of ten features does.
    """
    cols = list(cols)[:limit] if limit else list(cols)
    aggs = []
    for k in (1, 0):
        x = F.when(F.col(label) == k, F.col("x"))
        aggs += [
            F.count(x).cast("double").alias(f"n{k}"),
            F.avg(x).alias(f"m{k}"),
            F.when(F.count(x) >= 2, F.var_samp(x)).alias(f"v{k}"),
        ]
    pairs = long_form(labelled(df, label), expressions(df, cols), [label])
    return t_test_of(pairs.groupBy("column").agg(*aggs), cols)


def t_test_of(row: DataFrame, cols: Sequence[str]) -> DataFrame:
    """:func:`t_test_by_class` from (column, n1, m1, v1, n0, m0, v0): rows, means, variances."""
    names = F.array(*[F.lit(c) for c in cols])
    row = row.withColumn("position", F.array_position(names, F.col("column")).cast("int") - 1)
    n1, n0 = F.col("n1"), F.col("n0")
    freedom = n1 + n0 - 2
    pooled = F.try_divide((n1 - 1) * F.col("v1") + (n0 - 1) * F.col("v0"), freedom)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)))
    difference = F.col("m1") - F.col("m0")
    out = row.select(
        "column", "position",
        F.col("m1").alias("positive_mean"), F.col("m0").alias("negative_mean"),
        F.sqrt("v1").alias("positive_std"), F.sqrt("v0").alias("negative_std"),
        difference.alias("mean_difference"),
        F.try_divide(difference, error).alias("t_statistic"),
        freedom.alias("degrees_of_freedom"),
    )
    p = student_p(F.col("t_statistic"), F.col("degrees_of_freedom"))
    return out.withColumn("p_value", p).withColumn("significant", F.col("p_value") < ALPHA)


def significant_features(
    df: DataFrame, cols: Sequence[str], label: str, k: int = 5, limit: int | None = None
) -> DataFrame:
    """The k significant columns with the largest absolute mean difference."""
    return largest_differences(t_test_by_class(df, cols, label, limit), k)


def largest_differences(tests: DataFrame, k: int = 5) -> DataFrame:
    """:func:`significant_features` from ready tests."""
    tests = tests.where("significant")
    size = F.abs("mean_difference")
    return (
        tests.orderBy(size.desc(), "position")
        .limit(k)
        .select("column", "mean_difference", "p_value")
    )


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The cut ``score >= threshold`` with the largest TPR − FPR (smallest cut on a tie)."""
    o = class_counts_in_order(df, [score], label)
    # values below x stay negative: the classes' running counts before x
    tpr = 1 - F.try_divide((F.col("cum_c1") - F.col("c1")).cast("double"), "tot_c1")
    fpr = 1 - F.try_divide((F.col("cum_c0") - F.col("c0")).cast("double"), "tot_c0")
    best = F.max(F.struct((tpr - fpr).alias("j"), (-F.col("x")).alias("cut"),
                          tpr.alias("tpr"), fpr.alias("fpr")))
    return o.agg(best.alias("best")).select(
        (-F.col("best.cut")).alias("threshold"),
        F.col("best.j").alias("j_statistic"),
        "best.tpr",
        "best.fpr",
    )
