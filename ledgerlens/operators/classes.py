"""Class balance and per-class comparisons; label 1 is positive, 0 is negative."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.stats import percent, tidy
from ledgerlens.operators.profile import numeric_summary
from ledgerlens.roles import as_double


def labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is 0 or 1."""
    return df.where(F.col(label).isin(0, 1))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Counts of both classes, share of all rows, and the imbalance ratios."""
    wide = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(label) == 1).alias("positive_count"),
        F.count_if(F.col(label) == 0).alias("negative_count"),
    )
    return class_balance_of(wide)


def class_balance_of(wide: DataFrame) -> DataFrame:
    """:func:`class_balance` from one row of ``total, positive_count, negative_count``."""
    ones, zeros = F.col("positive_count"), F.col("negative_count")
    return wide.select(
        "total",
        "positive_count",
        "negative_count",
        percent(ones, F.col("total")).alias("positive_pct"),
        F.try_divide(ones.cast("double"), F.col("total")).alias("positive_ratio"),
        (zeros / F.greatest(ones, F.lit(1))).alias("imbalance"),
        F.try_divide(zeros.cast("double"), ones).alias("imbalance_ratio"),
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """count and share per label value, keyed by the value itself."""
    total = df.agg(F.count("*")).scalar()
    return (
        df.groupBy(label)
        .agg(F.count("*").alias("count"))
        .withColumn("share", F.try_divide(F.col("count").cast("double"), total))
    )


def split_by_label(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Rows and means of both classes side by side, in one pass: (column, …)."""
    aggs, fields = [], {}
    for i, c in enumerate(cols):
        fields[c] = {}
        for k, value in (("negative", 0), ("positive", 1)):
            x = F.when(F.col(label) == value, as_double(df, c))
            aggs += [F.count(x).alias(f"n_{k}_{i}"), F.avg(x).alias(f"m_{k}_{i}")]
            fields[c] |= {f"{k}_rows": f"n_{k}_{i}", f"{k}_mean": f"m_{k}_{i}"}
    return tidy(df.agg(*aggs), fields)


def amount_flags(
    df: DataFrame, amount: str, thresholds: Sequence[float] = (1000, 5000, 10000)
) -> DataFrame:
    """Zero amounts (count, %) and amounts over each threshold (0.5 gives over_0_5)."""
    names = [f"over_{t:g}".replace(".", "_") for t in thresholds]
    wide = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(amount) == 0).alias("zero_count"),
        *[F.count_if(F.col(amount) > t).alias(n) for t, n in zip(thresholds, names, strict=True)],
    )
    return wide.select(
        "zero_count",
        percent(F.col("zero_count"), F.col("n")).alias("zero_percentage"),
        *names,
    )


def describe_by_class(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Full describe row per (label, column)."""
    return numeric_summary(labelled(df, label), cols, [label])


def compare_by_class(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """mean, median, std, min, max per (label, column)."""
    table = describe_by_class(df, cols, label)
    return table.select(label, "column", "mean", "median", "std", "min", "max")


def zero_amounts_by_class(df: DataFrame, amount: str, label: str) -> DataFrame:
    """Count and percentage of zero amounts per class."""
    zero = F.count_if(F.col(amount) == 0)
    return (
        labelled(df, label)
        .groupBy(label)
        .agg(zero.alias("zero_count"), percent(zero, F.count("*")).alias("zero_percentage"))
    )


def rate_by(df: DataFrame, label: str, period: Column, name: str = "period") -> DataFrame:
    """Rows, positives and positive rate per value of ``period``."""
    y = F.col(label).cast("double")
    return df.groupBy(period.alias(name)).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.avg(y).alias("positive_rate"),
    )


def cross_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts and expected counts of two categorical columns in long form."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b)
    counts = counts.agg(F.count("*").alias("count"))
    rows = counts.groupBy(a).agg(F.sum("count").alias("row_total"))
    cols = counts.groupBy(b).agg(F.sum("count").alias("column_total"))
    total = counts.agg(F.sum("count")).scalar()
    share = F.col("column_total").cast("double") / total
    return (
        counts.join(rows, a)
        .join(cols, b)
        .select(a, b, "count", (F.col("row_total") * share).alias("expected"))
    )


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square of the full cross table, absent cells included."""
    cells = cross_table(df, a, b)
    n = F.sum("count").cast("double")
    # absent cells add their expectation: sum(o^2/e) - n covers them
    ratio = F.sum(F.col("count").cast("double") * F.col("count") / F.col("expected"))
    freedom = (F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)
    return cells.agg((ratio - n).alias("chi_square"), freedom.alias("degrees_of_freedom"))
