"""Per-column profile: summaries, percentiles, missing values, top values, types."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlens.functions.stats import (
    WIDE_COLUMNS,
    every_column,
    long_form,
    percent,
    sample_kurtosis,
    sample_skewness,
    sample_std,
    tidy,
)
from ledgerlens.operators.quantiles import quantiles
from ledgerlens.roles import as_double, categorical_cols, not_nan, numeric_cols
from ledgerlens.session import materialise

PERCENTILES = (0.01, 0.05, 0.10, 0.90, 0.95, 0.99)
_NUMPY_NAMES = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64",
    "float": "float32", "double": "float64", "string": "object", "boolean": "bool",
}


def moments(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, max, skewness, kurtosis per column in one pass.

    A few columns are one wide aggregate; many are grouped by column name, which keeps
    the generated code small.  Both combine map-side.
    """
    cols = list(cols if cols is not None else numeric_cols(df, by))
    makers = {
        "count": F.count,
        "mean": F.avg,
        "std": sample_std,
        "min": F.min,
        "max": F.max,
        "skewness": sample_skewness,
        "kurtosis": sample_kurtosis,
    }
    exprs = {c: as_double(df, c) for c in cols}
    if len(cols) > WIDE_COLUMNS:
        pairs = long_form(df, exprs, by, keep_null=True)
        aggs = [make(F.col("x")).alias(k) for k, make in makers.items()]
        found = pairs.groupBy(*by, "column").agg(*aggs)
        if by:
            return found
        return every_column(found, cols).withColumn("count", F.coalesce("count", F.lit(0)))
    base = df.select(*by, *[e.alias(f"x_{i}") for i, e in enumerate(exprs.values())])
    aggs, fields = [], {}
    for i, c in enumerate(cols):
        aggs += [make(F.col(f"x_{i}")).alias(f"{k}_{i}") for k, make in makers.items()]
        fields[c] = {k: f"{k}_{i}" for k in makers}
    return tidy(base.groupBy(*by).agg(*aggs), fields, by)


def with_quantiles(
    stats: DataFrame, q: DataFrame, names: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """Add quantile columns to a (by…, column) table; both sides have one row per pair."""
    q = q.select(
        *[F.col(k).alias(f"q_{k}") for k in by],
        F.col("column").alias("q_column"),
        *[F.get("q", i).alias(n) for i, n in enumerate(names)],
    )
    on = F.col("column") == F.col("q_column")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"q_{k}"))
    return stats.join(q, on, "left").drop("q_column", *[f"q_{k}" for k in by])


def numeric_summary(
    df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (),
    method: str = "auto",
) -> DataFrame:
    """The describe table plus skewness and kurtosis, one row per (by…, column)."""
    cols = list(cols if cols is not None else numeric_cols(df, by))
    q = quantiles(df, cols, (0.25, 0.5, 0.75), by, method)
    out = with_quantiles(moments(df, cols, by), q, ("q1", "median", "q3"), by)
    order = ("count", "mean", "std", "min", "q1", "median", "q3", "max", "skewness", "kurtosis")
    return out.select(*by, "column", *order)


def percentiles(
    df: DataFrame, cols: Sequence[str] | None = None, probs: Sequence[float] = PERCENTILES,
    by: Sequence[str] = (), method: str = "auto",
) -> DataFrame:
    """(by…, column, p1, p5, …)."""
    cols = list(cols if cols is not None else numeric_cols(df, by))
    q = quantiles(df, cols, probs, by, method)
    named = [F.get("q", i).alias(f"p{round(p * 100):d}") for i, p in enumerate(probs)]
    return q.select(*by, "column", *named)


def variability(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Sample variance and coefficient of variation per column."""
    stats = moments(df, cols)
    return stats.select(
        "column",
        (F.col("std") * F.col("std")).alias("variance"),
        F.try_divide("std", "mean").alias("variation"),
    )


# -- missing values ---------------------------------------------------------------


def missing_by_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage for every column."""
    cols = list(cols or df.columns)
    aggs = [F.count_if(not_nan(df, c).isNull()).alias(f"m_{i}") for i, c in enumerate(cols)]
    wide = df.agg(F.count("*").alias("n"), *aggs)
    return tidy(
        wide,
        {
            c: {
                "missing_count": f"m_{i}",
                "missing_percentage": percent(F.col(f"m_{i}"), F.col("n")),
            }
            for i, c in enumerate(cols)
        },
    )


def missing_only(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns that have missing values, percentage to two digits."""
    table = missing_by_column(df, cols).where(F.col("missing_count") > 0)
    return table.withColumn("missing_percentage", F.round("missing_percentage", 2))


def missing_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Total missing cells, share of all cells, and the affected columns in order."""
    cols = list(cols or df.columns)
    aggs = [F.count_if(not_nan(df, c).isNull()).alias(f"m_{i}") for i, c in enumerate(cols)]
    wide = df.agg(F.count("*").alias("n"), *aggs)
    total = F.lit(0)
    affected = []
    for i, c in enumerate(cols):
        total = total + F.col(f"m_{i}")
        affected.append(F.when(F.col(f"m_{i}") > 0, F.lit(c)))
    return wide.select(
        total.cast("bigint").alias("total_missing_values"),
        percent(total, F.col("n") * len(cols)).alias("percentage_of_total_values"),
        F.array_compact(F.array(*affected)).alias("columns_with_missing"),
    )


# -- values -----------------------------------------------------------------------


def value_table(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """(column, value, count); hot values are combined before the shuffle."""
    rows = df if where is None else df.where(where)
    pairs = long_form(rows, {c: F.col(c).cast("string") for c in cols})
    return pairs.groupBy("column", F.col("x").alias("value")).agg(F.count("*").alias("count"))


def value_counts(
    df: DataFrame, k: int = 20, cols: Sequence[str] | None = None, where: Column | None = None,
    least: bool = False,
) -> DataFrame:
    """The k most (or least) frequent values per column, ties by value."""
    return top_values(value_table(df, list(cols or categorical_cols(df)), where), k, least)


def top_values(table: DataFrame, k: int = 20, least: bool = False) -> DataFrame:
    """:func:`value_counts` from a ready (column, value, count) table."""
    count = F.col("count").asc() if least else F.col("count").desc()
    by_count = Window.partitionBy("column").orderBy(count, "value")
    return table.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k)


def _merged_sketches(level: DataFrame, tracked: int) -> DataFrame:
    """(column, sketch) from (column, part, sketch), merged in a tree of three levels."""
    merge = F.call_function("approx_top_k_combine", F.col("sketch"), F.lit(tracked)).alias("sketch")
    for _ in range(2):
        level = level.groupBy("column", F.floor(F.col("part") / 64).alias("part")).agg(merge)
    return level.groupBy("column").agg(merge)


def frequent_values(
    df: DataFrame, k: int = 20, cols: Sequence[str] | None = None, tracked: int = 10_000
) -> DataFrame:
    """(column, value, count, rank, certain): the k most frequent values without a shuffle of
    all values.

    A heavy-hitter sketch of ``tracked`` values per task and column finds the candidates,
    merged in a tree; a second pass counts them exactly, broadcast as ``tracked`` rows a
    column. A value left out occurs in at most ``3.5 / size`` of the column's rows, ``size``
    the power of two above ``tracked / 0.75``; ``certain`` rows are more frequent than that,
    so they are exactly what :func:`value_counts` gives.
    """
    cols = list(cols or categorical_cols(df))
    pairs = long_form(df, {c: F.col(c).cast("string") for c in cols})
    sketch = F.call_function("approx_top_k_accumulate", F.col("x"), F.lit(tracked)).alias("sketch")
    parts = pairs.groupBy("column", F.spark_partition_id().alias("part")).agg(sketch)
    found = F.call_function("approx_top_k_estimate", F.col("sketch"), F.lit(tracked))
    merged = _merged_sketches(parts, tracked)
    listed = merged.select("column", F.explode(F.transform(found, lambda e: e["item"])).alias("x"))
    listed = materialise(listed)
    held = pairs.join(F.broadcast(listed), ["column", "x"], "left_semi")
    counted = held.groupBy("column", F.col("x").alias("value")).agg(F.count("*").alias("count"))
    rows = df.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)])
    totals = tidy(rows, {c: {"total": f"n_{i}"} for i, c in enumerate(cols)})
    size = 2 ** math.ceil(math.log2(math.ceil(tracked / 0.75)))
    top = top_values(counted, k).join(F.broadcast(totals), "column")  # one row per column
    return top.withColumn("certain", F.col("count") > F.col("total") * 3.5 / size).drop("total")


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """unique_count, most frequent value and its count per categorical column."""
    cols = list(cols or categorical_cols(df))
    return categorical_summary_of(value_table(df, cols), cols)


def categorical_summary_of(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """:func:`categorical_summary` from a ready (column, value, count) table."""
    best = F.min(F.struct((-F.col("count")).alias("rank"), F.col("value")))
    found = table.groupBy("column").agg(F.count("*").alias("unique_count"), best.alias("best"))
    names = table.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(found, "column", "left").select(
        "column",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.col("best.value").alias("most_frequent"),
        F.coalesce(-F.col("best.rank"), F.lit(0)).alias("most_frequent_count"),
    )


def mode_by_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value of every column as text, the smallest value on a tie."""
    parts = []
    for group in _by_type(df, list(cols or df.columns)):
        exprs = {c: not_nan(df, c) for c in group}
        best = F.min(F.struct((-F.col("count")).alias("rank"), F.col("x")))
        counted = long_form(df, exprs).groupBy("column", "x").agg(F.count("*").alias("count"))
        top = counted.groupBy("column").agg(best.alias("best"))
        parts.append(
            top.select(
                "column",
                F.col("best.x").cast("string").alias("mode"),
                (-F.col("best.rank")).alias("mode_count"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _by_type(df: DataFrame, cols: Sequence[str]) -> list[list[str]]:
    """The columns grouped by type, so that values are compared as what they are."""
    groups: dict[str, list[str]] = {}
    for c in cols:
        groups.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    return list(groups.values())


def distinct_counts(
    df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """Distinct non-missing values per column.

    Exact counts group (column, value) pairs so a hot value is one row after the
    map-side combine; ``approx`` keeps only a sketch per column.
    """
    cols = list(cols or df.columns)
    if approx:
        aggs = [F.approx_count_distinct(not_nan(df, c)).alias(f"d_{i}") for i, c in enumerate(cols)]
        return tidy(df.agg(*aggs), {c: {"unique_values": f"d_{i}"} for i, c in enumerate(cols)})
    parts = [
        long_form(df, {c: not_nan(df, c) for c in group}).groupBy("column", "x")
        .agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("unique_values"))
        for group in _by_type(df, cols)
    ]
    found = reduce(DataFrame.unionByName, parts)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(found, "column", "left").select(
        "column", F.coalesce("unique_values", F.lit(0)).alias("unique_values")
    )


# -- schema -----------------------------------------------------------------------


def column_types(
    df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """dtype, numeric / categorical flags, distinct values and their ratio to all rows."""
    cols = list(cols or df.columns)
    rows = df.agg(F.count("*")).scalar()
    return column_types_of(df, cols, distinct_counts(df, cols, approx), rows)


def column_types_of(
    df: DataFrame, cols: Sequence[str], unique: DataFrame, rows: Column | int
) -> DataFrame:
    """:func:`column_types` from ready (column, unique_values) and the number of rows."""
    numeric = set(numeric_cols(df))
    facts = []
    for c in cols:
        kind = df.schema[c].dataType.simpleString()
        flat = isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))
        facts.append((c, kind, _NUMPY_NAMES.get(kind, kind), c in numeric, flat))
    known = df.sparkSession.createDataFrame(
        facts, "column string, dtype string, numpy_dtype string, "
        "is_numeric boolean, is_categorical boolean",
    )
    rows = F.lit(rows) if isinstance(rows, int) else rows
    return known.join(unique, "column").withColumn(
        "unique_ratio", F.try_divide(F.col("unique_values").cast("double"), rows)
    )


def type_summary(df: DataFrame) -> DataFrame:
    """Columns per dtype with their names; metadata only."""
    facts = [(f.name, f.dataType.simpleString()) for f in df.schema]
    known = df.sparkSession.createDataFrame(facts, "column string, dtype string")
    return known.groupBy("dtype").agg(
        F.count("*").alias("columns"), F.sort_array(F.collect_list("column")).alias("names")
    )


_INTEGER_STEPS = (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64))


def suggest_narrow_types(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Smallest type that holds each numeric column: (column, dtype, suggested)."""
    cols = [
        f.name for f in df.schema
        if isinstance(f.dataType, (T.IntegralType, T.FloatType, T.DoubleType))
    ]
    aggs, fields = [], {}
    for i, c in enumerate(cols):
        kind = df.schema[c].dataType
        now = kind.simpleString()
        if isinstance(kind, T.IntegralType):
            aggs += [F.min(c).alias(f"a_{i}"), F.max(c).alias(f"b_{i}")]
            best = F.lit(now)
            for name, bits in reversed(_INTEGER_STEPS):
                low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
                fits = (F.col(f"a_{i}") >= low) & (F.col(f"b_{i}") <= high)
                best = F.when(fits, F.lit(name)).otherwise(best)
        else:
            exact = not_nan(df, c).cast("double")
            loss = F.abs(exact - exact.cast("float").cast("double"))
            aggs.append(F.max(loss).alias(f"a_{i}"))
            keeps = F.coalesce(F.col(f"a_{i}") <= tolerance, F.lit(False))
            best = F.when(keeps, F.lit("float")).otherwise(F.lit(now))
        fields[c] = {"dtype": F.lit(now), "suggested": best}
    return tidy(df.agg(*aggs), fields)


def narrow_types(df: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Cast every numeric column to its suggested type."""
    plan = {r["column"]: r["suggested"] for r in suggest_narrow_types(df, tolerance).collect()}
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else c for c in df.columns])
