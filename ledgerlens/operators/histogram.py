"""Equal-width histograms with the edge rules of ``numpy.histogram``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.stats import long_form, tidy
from ledgerlens.operators.lookup import hot_groups, lookup_join
from ledgerlens.operators.quantiles import expressions
from ledgerlens.roles import numeric_cols


def bin_index(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Zero-based bin of x; the last bin is closed, values on an edge go right."""
    step = (high - low) / F.lit(float(bins))
    guess = F.floor((x - low) / (high - low) * F.lit(float(bins)))
    guess = F.least(guess, F.lit(bins - 1)).cast("int")
    return (
        F.when(x < guess * step + low, guess - 1)
        .when((guess < bins - 1) & (x >= (guess + 1) * step + low), guess + 1)
        .otherwise(guess)
    )


def bin_edges(
    df: DataFrame, cols: Sequence[str] | Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """(by…, column, low, high, n); a constant column is widened by one half each way."""
    exprs = expressions(df, cols)
    base = df.select(*by, *[e.alias(f"x_{i}") for i, e in enumerate(exprs.values())])
    aggs, fields = [], {}
    for i, c in enumerate(exprs):
        x = f"x_{i}"
        aggs += [F.min(x).alias(f"a_{i}"), F.max(x).alias(f"b_{i}"), F.count(x).alias(f"n_{i}")]
        a, b = F.col(f"a_{i}"), F.col(f"b_{i}")
        half = F.when(a == b, F.lit(0.5)).otherwise(F.lit(0.0))
        fields[c] = {"low": a - half, "high": b + half, "n": f"n_{i}"}
    return tidy(base.groupBy(*by).agg(*aggs), fields, by)


def histogram(
    df: DataFrame,
    cols: Sequence[str] | Mapping[str, Column] | None = None,
    bins: int = 20,
    by: Sequence[str] = (),
    shared_bins: bool = False,
) -> DataFrame:
    """(by…, column, bin, left, right, center, count, density), empty bins included.

    With ``by`` every group has its own range unless ``shared_bins``.
    """
    exprs = expressions(df, cols if cols is not None else numeric_cols(df, by))
    keys = list(by)
    edges = bin_edges(df, exprs, keys).where(F.col("n") > 0)
    if keys and shared_bins:
        span = bin_edges(df, exprs).select(
            F.col("column").alias("span"), F.col("low").alias("s_low"), F.col("high").alias("s_high")
        )
        edges = edges.join(F.broadcast(span), F.col("column") == F.col("span")).select(
            *keys, "column", F.col("s_low").alias("low"), F.col("s_high").alias("high"), "n"
        )
    lookup = edges.select(
        *[F.col(k).alias(f"e_{k}") for k in keys], F.col("column").alias("e_column"), "low", "high"
    )
    placed = lookup_join(
        long_form(df, exprs, keys), lookup, [(k, f"e_{k}") for k in keys],
        hot_groups(df, keys), F.col("column") == F.col("e_column"),
    )
    counts = (
        placed.groupBy(*keys, "column", bin_index(F.col("x"), F.col("low"), F.col("high"), bins).alias("bin"))
        .agg(F.count("*").alias("count"))
        .select(
            *[F.col(k).alias(f"c_{k}") for k in keys],
            F.col("column").alias("c_column"), F.col("bin").alias("c_bin"), "count",
        )
    )
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    on = (F.col("column") == F.col("c_column")) & (F.col("bin") == F.col("c_bin"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    step = (F.col("high") - F.col("low")) / F.lit(float(bins))
    count = F.coalesce("count", F.lit(0))
    left = F.col("bin") * step + F.col("low")
    last = F.col("bin") == bins - 1
    right = F.when(last, F.col("high")).otherwise((F.col("bin") + 1) * step + F.col("low"))
    return every.join(counts, on, "left").select(
        *keys, "column", "bin", left.alias("left"), right.alias("right"),
        ((left + right) / 2).alias("center"), count.alias("count"),
        F.try_divide(count.cast("double"), F.col("n") * step).alias("density"),
    )


def grid_counts(df: DataFrame, x: str, y: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Two-dimensional bin counts over the shared range: the scalable scatter plot."""
    exprs = expressions(df, [x, y])
    base = df.select(*by, *[e.alias(a) for e, a in zip(exprs.values(), "xy", strict=True)])
    base = base.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    limits = base.agg(*[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("a", F.min), ("b", F.max))])
    limits = limits.head()

    def cell(c: str) -> Column:
        low, high = limits[f"a{c}"], limits[f"b{c}"]
        half = 0.5 if low == high else 0.0
        if low is None:
            return F.lit(None).cast("int")
        return bin_index(F.col(c), F.lit(low - half), F.lit(high + half), bins)

    placed = base.select(*by, cell("x").alias("bin_x"), cell("y").alias("bin_y"))
    return placed.groupBy(*by, "bin_x", "bin_y").agg(F.count("*").alias("count"))
