"""Chart-ready data sets: numbers only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.classes import labelled
from ledgerlens.operators.histogram import histogram
from ledgerlens.operators.outliers import FENCE, iqr_fence_filter
from ledgerlens.operators.quantiles import quantiles
from ledgerlens.operators.sampling import SEED, boosted_sample
from ledgerlens.roles import Roles

CLASS_BINS, GRID_BINS, GRID_COLUMNS = 50, 30, 16


def histogram_by_class(
    df: DataFrame, cols: Sequence[str], label: str, bins: int = CLASS_BINS,
    shared_bins: bool = False,
) -> DataFrame:
    """Density per class, each class over its own range unless ``shared_bins``."""
    return histogram(labelled(df, label), cols, bins, [label], shared_bins)


def histogram_grid(
    df: DataFrame, features: Sequence[str], bins: int = GRID_BINS
) -> DataFrame:
    """Histograms of all features in one job."""
    return histogram(df, list(features), bins)


def histogram_set(df: DataFrame, roles: Roles, bins: int = CLASS_BINS) -> DataFrame:
    """Time, amount and every feature by class (plain when there is no label)."""
    cols = [c for c in (roles.time, roles.amount, *roles.features) if c]
    if roles.label:
        return histogram_by_class(df, cols, roles.label, bins)
    return histogram(df, cols, bins)


def scatter_points(
    df: DataFrame, pairs: Sequence[tuple[str, str]], label: str, key: str,
    n: int, seed: int = SEED,
) -> DataFrame:
    """(chart, x, y, label) of the chart sample."""
    sample = boosted_sample(df, n, label, key, seed)
    charts = [
        F.struct(
            F.lit(f"scatter_{x}_{y}".lower()).alias("chart"),
            F.col(x).cast("double").alias("x"),
            F.col(y).cast("double").alias("y"),
            F.col(label).alias("label"),
        )
        for x, y in pairs
    ]
    return sample.select(key, F.inline(F.array(*charts)))


def boxplot_by_class(df: DataFrame, amount: str, label: str) -> DataFrame:
    """Quartiles, whiskers and flier count per class after the overall fence filter.

    A whisker ends at the last value within 1.5 box lengths of the box.
    """
    inside = labelled(iqr_fence_filter(df, amount), label).select(label, amount)
    box = quantiles(inside, [amount], (0.25, 0.5, 0.75), [label]).select(
        F.col(label).alias("box_label"),
        *[F.get("q", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))],
    )
    # one row per class
    rows = inside.join(F.broadcast(box), F.col(label) == F.col("box_label"))
    reach = FENCE * (F.col("q3") - F.col("q1"))
    x = F.col(amount)
    held = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(label, "q1", "median", "q3").agg(
        F.min(F.when(held, x)).alias("whisker_low"),
        F.max(F.when(held, x)).alias("whisker_high"),
        F.count_if(~held).alias("fliers"),
        F.count("*").alias("rows"),
    )
