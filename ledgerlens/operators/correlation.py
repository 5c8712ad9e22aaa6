"""Pearson correlation over pairwise-complete rows, tidy (var1, var2, r)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.stats import every_column, long_form, tidy
from ledgerlens.roles import as_double, numeric_cols

FEW_PAIRS = 15


def _indexed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[as_double(df, c).alias(f"x_{i}") for i, c in enumerate(cols)])


def _pairs_by_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Few pairs: every row gives its complete pairs to one grouped JVM aggregate."""
    pairs = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"),
            F.col(f"x_{i}").alias("x"), F.col(f"x_{j}").alias("y"),
        )
        for i in range(len(cols)) for j in range(i + 1, len(cols))
    ]
    rows = _indexed(df, cols).select(F.inline(F.array(*pairs)))
    complete = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return complete.groupBy("i", "j").agg(F.count("*").alias("n"), r.alias("r"))


def _block_moments(size: int):
    """Arrow task: co-moments of all pairs in a partition, one row per pair.

    Sums of a batch are taken about its column means and merged pairwise, so they do
    not cancel when a column is far from zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((size, size))
        mean_x = np.zeros((size, size))  # mean of i over rows complete in (i, j)
        mom_xx = np.zeros((size, size))
        mom_xy = np.zeros((size, size))
        for batch in batches:
            block = np.column_stack(
                [np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in batch.columns]
            )
            if not len(block):
                continue
            known = ~np.isnan(block)
            mask = known.astype(float)
            m = mask.T @ mask
            filled = np.where(known, block, 0.0)
            shift = filled.sum(axis=0) / np.maximum(mask.sum(axis=0), 1.0)
            z = np.where(known, block - shift, 0.0)
            s = z.T @ mask
            safe = np.maximum(m, 1.0)
            mean = s / safe
            xx = (z * z).T @ mask - s * mean
            xy = z.T @ z - s * mean.T
            mean = mean + shift[:, None]
            both = np.maximum(n + m, 1.0)
            delta = np.where(m > 0, mean - mean_x, 0.0)
            weight = n * m / both
            mom_xx += xx + delta * delta * weight
            mom_xy += xy + delta * delta.T * weight
            mean_x += delta * m / both
            n += m
        i, j = np.triu_indices(size, k=1)
        keep = n[i, j] > 0
        i, j = i[keep], j[keep]
        yield pa.RecordBatch.from_pydict(
            {
                "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                "n": pa.array(n[i, j]), "mx": pa.array(mean_x[i, j]), "my": pa.array(mean_x[j, i]),
                "sxx": pa.array(mom_xx[i, j]), "syy": pa.array(mom_xx[j, i]),
                "sxy": pa.array(mom_xy[i, j]),
            }
        )

    return run


def _pairs_by_blocks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Many pairs: partial co-moment matrices per task, merged per pair."""
    schema = "i int, j int, n double, mx double, my double, sxx double, syy double, sxy double"
    parts = _indexed(df, cols).mapInArrow(_block_moments(len(cols)), schema)
    # partials are moved to a common origin, the column means of all rows, and added
    means = df.agg(*[F.avg(as_double(df, c)).alias(f"m_{k}") for k, c in enumerate(cols)])
    origin = means.select(F.array(*[F.col(f"m_{k}") for k in range(len(cols))])).scalar()
    dx = F.col("mx") - F.get(origin, F.col("i"))
    dy = F.col("my") - F.get(origin, F.col("j"))
    n = F.col("n")
    merged = (
        parts.select("i", "j", "n", "sxx", "syy", "sxy", dx.alias("dx"), dy.alias("dy"))
        .groupBy("i", "j")
        .agg(
            F.sum(n).alias("n"),
            F.sum(n * F.col("dx")).alias("tx"),
            F.sum(n * F.col("dy")).alias("ty"),
            F.sum(F.col("sxx") + n * F.col("dx") * F.col("dx")).alias("qxx"),
            F.sum(F.col("syy") + n * F.col("dy") * F.col("dy")).alias("qyy"),
            F.sum(F.col("sxy") + n * F.col("dx") * F.col("dy")).alias("qxy"),
        )
    )
    n = F.col("n")
    cxx = F.col("qxx") - F.col("tx") * F.col("tx") / n
    cyy = F.col("qyy") - F.col("ty") * F.col("ty") / n
    cxy = F.col("qxy") - F.col("tx") * F.col("ty") / n
    flat = (cxx <= 1e-24 * F.col("qxx")) | (cyy <= 1e-24 * F.col("qyy"))
    r = F.when(~flat, F.try_divide(cxy, F.sqrt(F.greatest(cxx * cyy, F.lit(0.0)))))
    return merged.select("i", "j", n.cast("bigint").alias("n"), r.alias("r"))


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(i, j, var1, var2, n, r) for i < j; r is NULL when a side is constant."""
    cols = list(cols if cols is not None else numeric_cols(df))
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    few = len(cols) * (len(cols) - 1) // 2 <= FEW_PAIRS
    pairs = _pairs_by_rows(df, cols) if few else _pairs_by_blocks(df, cols)
    # pairs without a common row are listed too
    size, names = len(cols), F.array(*[F.lit(c) for c in cols])
    cells = df.sparkSession.range(size * size).select(
        F.floor(F.col("id") / size).cast("int").alias("i"), (F.col("id") % size).cast("int").alias("j")
    )
    listed = cells.where("i < j").select(
        "i", "j", F.get(names, F.col("i")).alias("var1"), F.get(names, F.col("j")).alias("var2")
    )
    return listed.join(pairs, ["i", "j"], "left").select(
        "i", "j", "var1", "var2", F.coalesce("n", F.lit(0)).alias("n"), "r"
    )


def correlation_matrix(
    df: DataFrame, cols: Sequence[str] | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """The full tidy matrix (var1, var2, r): both triangles and the diagonal.

    ``pairs``, here and below, is a ready :func:`correlation_pairs` of the same columns.
    """
    cols = list(cols if cols is not None else numeric_cols(df))
    pairs = correlation_pairs(df, cols) if pairs is None else pairs
    spread = df.agg(*[F.stddev_pop(as_double(df, c)).alias(f"s_{i}") for i, c in enumerate(cols)])
    own = tidy(
        spread,
        {
            c: {"var2": F.lit(c), "r": F.when(F.col(f"s_{i}") > 0, F.lit(1.0))}
            for i, c in enumerate(cols)
        },
    )
    return matrix_of(pairs, own.withColumnRenamed("column", "var1"))


def matrix_of(pairs: DataFrame, diagonal: DataFrame) -> DataFrame:
    """:func:`correlation_matrix` from the pairs and the rows of the diagonal."""
    both = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("var1"), F.col("var2"), F.col("r")),
                F.struct(F.col("var2").alias("var1"), F.col("var1").alias("var2"), F.col("r")),
            )
        )
    )
    return both.unionByName(diagonal)


def high_correlations(
    df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.5,
    limit: int | None = None, by_strength: bool = False, pairs: DataFrame | None = None,
) -> DataFrame:
    """Pairs with |r| above the threshold and their strength; optional first ``limit``."""
    strength = F.when(F.abs("r") > 0.8, "very_high").when(F.abs("r") > 0.5, "high")
    pairs = correlation_pairs(df, cols) if pairs is None else pairs
    table = pairs.where(F.abs("r") > threshold)
    table = table.withColumn("strength", strength)
    if limit is None:
        return table
    order = [F.abs("r").desc(), "i", "j"] if by_strength else ["i", "j"]
    return table.orderBy(*order).limit(limit)


def strong_correlations(
    df: DataFrame, cols: Sequence[str] | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Pairs with |r| > 0.8."""
    return high_correlations(df, cols, 0.8, pairs=pairs)


def feature_pairs(
    df: DataFrame, features: Sequence[str], threshold: float = 0.3, k: int = 10
) -> DataFrame:
    """The k strongest pairs among the features above the threshold."""
    table = high_correlations(df, features, threshold, k, by_strength=True)
    return table.select("var1", "var2", "r")


def target_correlation(df: DataFrame, label: str, cols: Sequence[str] | None = None) -> DataFrame:
    """(variable, r) of every other column with the label."""
    cols = [c for c in (cols if cols is not None else numeric_cols(df)) if c != label]
    exprs = {c: as_double(df, c) for c in cols}
    base = df.withColumn("_y", as_double(df, label))
    pairs = long_form(base, exprs, ["_y"]).where(F.col("_y").isNotNull())
    spread = F.stddev_pop("x") * F.stddev_pop("_y")
    r = F.try_divide(F.covar_pop("x", "_y"), spread)
    found = every_column(pairs.groupBy("column").agg(r.alias("r")), cols)
    return found.withColumnRenamed("column", "variable")


def target_top(
    df: DataFrame, label: str, k: int = 10, cols: Sequence[str] | None = None
) -> DataFrame:
    """The k columns most correlated with the label by |r|."""
    return strongest(target_correlation(df, label, cols), k)


def strongest(table: DataFrame, k: int = 10) -> DataFrame:
    """:func:`target_top` from ready (variable, r)."""
    table = table.where(F.col("r").isNotNull())
    return table.orderBy(F.abs("r").desc(), "variable").limit(k)


def target_extremes(df: DataFrame, label: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Strongest positive and strongest negative column."""
    return extremes(target_correlation(df, label, cols))


def extremes(table: DataFrame) -> DataFrame:
    """:func:`target_extremes` from ready (variable, r)."""
    return table.agg(
        F.max_by("variable", "r").alias("strongest_positive"),
        F.max("r").alias("positive_r"),
        F.min_by("variable", "r").alias("strongest_negative"),
        F.min("r").alias("negative_r"),
    )


def correlation_summary(
    df: DataFrame, cols: Sequence[str] | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Mean and maximum |r|, counts over 0.5 and 0.8, pairs, undefined pairs."""
    size = F.abs("r")
    pairs = correlation_pairs(df, cols) if pairs is None else pairs
    return pairs.agg(
        F.avg(size).alias("mean_correlation"),
        F.max(size).alias("max_correlation"),
        F.count_if(size > 0.5).alias("correlations_over_05"),
        F.count_if(size > 0.8).alias("correlations_over_08"),
        F.count("*").alias("total_pairs"),
        F.count_if(F.col("r").isNull()).alias("undefined_pairs"),
    )


def heatmap(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Heat-map cells: the lower triangle beyond ten variables, else the whole matrix."""
    cols = list(cols if cols is not None else numeric_cols(df))
    if len(cols) <= 10:
        return correlation_matrix(df, cols)
    pairs = correlation_pairs(df, cols)
    return pairs.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r")
