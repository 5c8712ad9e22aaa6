"""Aggregate expressions with small-sample and zero-variance rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE_COLUMNS = 12  # beyond this many columns one grouped pass beats one wide aggregate


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness G1; NULL below three values or for a constant."""
    n = F.count(x).cast("double")
    factor = F.try_divide(F.sqrt(n * F.greatest(n - 1, F.lit(0.0))), n - 2)
    return F.when(n >= 3, F.skewness(x) * factor)


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis G2; NULL below four values or for a constant."""
    n = F.count(x).cast("double")
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n >= 4, factor * ((n + 1) * F.kurtosis(x) + 6))


def sample_std(x: Column) -> Column:
    return F.when(F.count(x) >= 2, F.stddev_samp(x))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, NULL when the whole is zero."""
    return F.try_divide(part * F.lit(100.0), whole)


def tidy(
    wide: DataFrame, fields: Mapping[str, Mapping[str, Column | str]], by: Sequence[str] = ()
) -> DataFrame:
    """Turn one wide aggregate row (per group) into a row per column.

    ``fields`` maps a column name to the named expressions of its row.
    """
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            *[(F.col(e) if isinstance(e, str) else e).alias(k) for k, e in exprs.items()],
        )
        for name, exprs in fields.items()
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def long_form(
    df: DataFrame, cols: Mapping[str, Column], by: Sequence[str] = (), keep_null: bool = False
) -> DataFrame:
    """Unpivot named expressions into (by…, column, x), NULL x dropped unless kept."""
    wide = df.select(*by, *[e.alias(f"x_{i}") for i, e in enumerate(cols.values())])
    names = F.array(*[F.lit(c) for c in cols])
    values = F.array(*[F.col(f"x_{i}") for i in range(len(cols))])
    pairs = wide.select(*by, F.inline(F.arrays_zip(names.alias("column"), values.alias("x"))))
    return pairs if keep_null else pairs.where(F.col("x").isNotNull())


def every_column(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """A per-column table with a row for every name, also when no row had a value."""
    listed = F.explode(F.array(*[F.lit(c) for c in names])).alias("column")
    return table.sparkSession.range(1).select(listed).join(F.broadcast(table), "column", "left")
