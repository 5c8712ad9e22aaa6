"""Outliers by quartile fence, z-score and modified z-score.

Thresholds are a handful of numbers per column; once known they are literals, so the
counting pass and the row flags are map-side expressions over the original rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.stats import percent, tidy
from ledgerlens.operators.quantiles import quantile_values
from ledgerlens.roles import as_double, numeric_cols

FENCE = 1.5
Z_LIMIT = 3.0
MODIFIED_Z_LIMIT = 3.5
MAD_SCALE = 0.6745
METHODS = ("iqr", "zscore", "modified_zscore")


@dataclass(frozen=True)
class Bounds:
    """Thresholds of one column; None where the method does not apply."""

    lower: float | None = None
    upper: float | None = None
    mean: float | None = None
    std: float | None = None
    median: float | None = None
    mad: float | None = None


def fences(df: DataFrame, cols: Sequence[str]) -> dict[str, Bounds]:
    """Q1 − 1.5·IQR and Q3 + 1.5·IQR per column."""
    out = {}
    for c, (q1, q3) in quantile_values(df, cols, (0.25, 0.75)).items():
        width = FENCE * (q3 - q1) if q1 is not None else None
        out[c] = Bounds(lower=q1 - width, upper=q3 + width) if width is not None else Bounds()
    return out


def bounds(
    df: DataFrame, cols: Sequence[str], methods: Sequence[str] = METHODS
) -> dict[str, Bounds]:
    """All thresholds the given methods need, from one to three passes."""
    parts: dict[str, dict] = {c: {} for c in cols}
    if "iqr" in methods:
        for c, b in fences(df, cols).items():
            parts[c] |= {"lower": b.lower, "upper": b.upper}
    if "zscore" in methods:
        row = df.agg(
            *[
                f(as_double(df, c)).alias(f"{k}_{i}")
                for i, c in enumerate(cols)
                for k, f in (("mean", F.avg), ("std", F.stddev_pop))
            ]
        ).head()
        for i, c in enumerate(cols):
            parts[c] |= {"mean": row[f"mean_{i}"], "std": row[f"std_{i}"] or None}
    if "modified_zscore" in methods:
        median = {c: q[0] for c, q in quantile_values(df, cols, (0.5,)).items()}
        away = {c: F.abs(as_double(df, c) - F.lit(m)) for c, m in median.items() if m is not None}
        mad = {c: q[0] for c, q in quantile_values(df, away, (0.5,)).items()} if away else {}
        for c in cols:
            parts[c] |= {"median": median[c], "mad": mad.get(c) or None}
    return {c: Bounds(**p) for c, p in parts.items()}


def z_score(x: Column, b: Bounds) -> Column:
    return F.abs(F.try_divide(x - F.lit(b.mean), F.lit(b.std))).cast("double")


def modified_z(x: Column, b: Bounds) -> Column:
    return F.try_divide(F.lit(MAD_SCALE) * (x - F.lit(b.median)), F.lit(b.mad)).cast("double")


def is_outlier(x: Column, b: Bounds, method: str) -> Column:
    """Strict test; false for missing values and inapplicable methods."""
    if method == "iqr":
        test = (x < F.lit(b.lower)) | (x > F.lit(b.upper))
    elif method == "zscore":
        test = z_score(x, b) > Z_LIMIT
    else:
        test = F.abs(modified_z(x, b)) > MODIFIED_Z_LIMIT
    return F.coalesce(test, F.lit(False))


def _columns(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(cols if cols is not None else numeric_cols(df))


def outliers_iqr(
    df: DataFrame, cols: Sequence[str] | None = None, found: dict | None = None
) -> DataFrame:
    """Count, percentage and fence per column.

    ``found``, here and below, are ready :func:`bounds` of the same columns.
    """
    found = found or bounds(df, _columns(df, cols), ["iqr"])
    aggs, fields = [], {}
    for i, (c, b) in enumerate(found.items()):
        x = as_double(df, c)
        aggs += [F.count(x).alias(f"n_{i}"), F.count_if(is_outlier(x, b, "iqr")).alias(f"o_{i}")]
        fields[c] = {
            "outlier_count": f"o_{i}",
            "outlier_percentage": percent(F.col(f"o_{i}"), F.col(f"n_{i}")),
            "lower_bound": F.lit(b.lower).cast("double"),
            "upper_bound": F.lit(b.upper).cast("double"),
        }
    return tidy(df.agg(*aggs), fields)


def outliers_zscore(
    df: DataFrame, cols: Sequence[str] | None = None, found: dict | None = None
) -> DataFrame:
    """Count, percentage, largest and mean |z| per column (population σ)."""
    found = found or bounds(df, _columns(df, cols), ["zscore"])
    aggs, fields = [], {}
    for i, (c, b) in enumerate(found.items()):
        x = as_double(df, c)
        z = z_score(x, b)
        aggs += [
            F.count(x).alias(f"n_{i}"),
            F.count_if(z > Z_LIMIT).alias(f"o_{i}"),
            F.max(z).alias(f"m_{i}"),
            F.avg(z).alias(f"a_{i}"),
        ]
        fields[c] = {
            "outlier_count": f"o_{i}",
            "outlier_percentage": percent(F.col(f"o_{i}"), F.col(f"n_{i}")),
            "max_zscore": f"m_{i}",
            "mean_zscore": f"a_{i}",
        }
    return tidy(df.agg(*aggs), fields)


def outliers_modified_z(
    df: DataFrame, cols: Sequence[str] | None = None, found: dict | None = None
) -> DataFrame:
    """Count and percentage per column; columns with MAD 0 are left out."""
    found = found or bounds(df, _columns(df, cols), ["modified_zscore"])
    aggs, fields = [F.count("*").alias("rows")], {}
    for i, (c, b) in enumerate(found.items()):
        if not b.mad:
            continue
        x = as_double(df, c)
        test = is_outlier(x, b, "modified_zscore")
        aggs += [F.count(x).alias(f"n_{i}"), F.count_if(test).alias(f"o_{i}")]
        fields[c] = {
            "outlier_count": f"o_{i}",
            "outlier_percentage": percent(F.col(f"o_{i}"), F.col(f"n_{i}")),
            "median": F.lit(b.median),
            "mad": F.lit(b.mad),
        }
    if not fields:
        return df.sparkSession.createDataFrame(
            [], "column string, outlier_count bigint, outlier_percentage double, "
            "median double, mad double",
        )
    return tidy(df.agg(*aggs), fields)


def outlier_label_rate(
    df: DataFrame, label: str, cols: Sequence[str] | None = None, found: dict | None = None
) -> DataFrame:
    """Label rate overall and among fence outliers of each column, from the same rows."""
    found = found or bounds(df, _columns(df, cols), ["iqr"])
    y = as_double(df, label)
    aggs, fields = [F.avg(y).alias("overall")], {}
    for i, (c, b) in enumerate(found.items()):
        flag = is_outlier(as_double(df, c), b, "iqr")
        aggs.append(F.avg(F.when(flag, y)).alias(f"r_{i}"))
        rate = F.coalesce(F.col(f"r_{i}"), F.lit(0.0))
        fields[c] = {
            "overall_rate": "overall",
            "outlier_rate": rate,
            "more_likely": rate > F.col("overall"),
        }
    return tidy(df.agg(*aggs), fields)


def outlier_summary(
    df: DataFrame, cols: Sequence[str] | None = None, found: dict | None = None
) -> DataFrame:
    """Totals per method, columns analysed, and the first column with most fence outliers."""
    names = _columns(df, cols)
    found = found or bounds(df, names, ["iqr", "zscore"])
    aggs, fields = [], {}
    for i, (c, b) in enumerate(found.items()):
        x = as_double(df, c)
        for m in ("iqr", "zscore"):
            aggs.append(F.count_if(is_outlier(x, b, m)).alias(f"{m}_{i}"))
        aggs.append(F.count(x).alias(f"n_{i}"))
        fields[c] = {"i": F.lit(i), "n": f"n_{i}", "iqr": f"iqr_{i}", "zscore": f"zscore_{i}"}
    per_column = tidy(df.agg(*aggs), fields).where(F.col("n") > 0)
    return per_column.agg(
        F.sum("iqr").alias("total_outliers_iqr"),
        F.sum("zscore").alias("total_outliers_zscore"),
        F.count("*").alias("columns_analyzed"),
        F.max_by("column", F.struct("iqr", -F.col("i"))).alias("most_outliers_column"),
    )


def flag_outliers(
    df: DataFrame, cols: Sequence[str] | None = None, methods: Sequence[str] = METHODS
) -> DataFrame:
    """Every row with a boolean ``<column>_<method>`` per test."""
    found = bounds(df, _columns(df, cols), methods)
    return df.withColumns(
        {f"{c}_{m}": is_outlier(as_double(df, c), b, m) for c, b in found.items() for m in methods}
    )


def outlier_samples(
    df: DataFrame, cols: Sequence[str] | None = None, k: int = 10,
    methods: Sequence[str] = METHODS,
) -> DataFrame:
    """(column, method, values): the k most extreme outliers, most extreme first.

    Extreme means far from the fence middle, the mean or the median; repeated values
    count once each, the larger value first on a tie.
    """
    found = bounds(df, _columns(df, cols), methods)
    rows = []
    for c, b in found.items():
        x = as_double(df, c)
        centre = {"iqr": (b.lower + b.upper) / 2 if b.lower is not None else None,
                  "zscore": b.mean, "modified_zscore": b.median}
        for m in methods:
            away = F.abs(x - F.lit(centre[m]))
            rows.append(
                F.when(
                    is_outlier(x, b, m),
                    F.struct(F.lit(c).alias("column"), F.lit(m).alias("method"),
                             away.alias("away"), x.alias("x")),
                )
            )
    hits = df.select(F.inline(F.array_compact(F.array(*rows))))
    order = Window.partitionBy("column", "method").orderBy(F.desc("away"), F.desc("x"))
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "x")))
    return top.groupBy("column", "method").agg(F.transform(ordered, lambda s: s["x"]).alias("values"))


def iqr_fence_filter(df: DataFrame, col: str) -> DataFrame:
    """Rows within the fence of ``col``, ends included; the bounds reach the scan."""
    b = fences(df, [col])[col]
    if b.lower is None:
        return df.where(F.lit(False))
    return df.where(F.col(col).between(b.lower, b.upper))
