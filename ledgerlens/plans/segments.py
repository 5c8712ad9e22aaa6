"""Profiles per segment: tails, histograms, outliers by three methods, and column pairs.

Every table has one row per segment and column, bin or pair. Rows of a segment are combined
map-side wherever they add up, quantiles choose a bounded method, and thresholds go back to
the rows broadcast for few segments and by a shuffle for many, where large ones are salted, so
one segment may hold any share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.stats import long_form, percent, tidy
from ledgerlens.operators import profile
from ledgerlens.operators.histogram import histogram
from ledgerlens.operators.lookup import hot_groups, lookup_join
from ledgerlens.operators.outliers import FENCE, MAD_SCALE, MODIFIED_Z_LIMIT, Z_LIMIT
from ledgerlens.operators.quantiles import quantiles
from ledgerlens.plans.bundles import segment_profile
from ledgerlens.roles import as_double, numeric_cols
from ledgerlens.session import materialise


def _with_thresholds(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], out: str, hot: DataFrame | None
) -> DataFrame:
    """Attach ``out``, a map from column to the struct ``t`` of (by…, column, t)."""
    entries = F.map_from_entries(F.collect_list(F.struct("column", "t")))  # one entry per column
    named = table.groupBy(*[F.col(k).alias(f"\0{out}_{k}") for k in keys]).agg(entries.alias(out))
    joined = lookup_join(rows, named, [(k, f"\0{out}_{k}") for k in keys], hot)
    return joined.drop(*[f"\0{out}_{k}" for k in keys])


def segment_outliers(
    df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None, method: str = "auto"
) -> DataFrame:
    """(by…, column, rows, and of each method the outliers), by the segment's own thresholds.

    Fence, z-score (population deviation) and modified z-score as for whole columns; the last
    is NULL where a segment's median distance is zero.
    """
    keys = list(by)
    cols = list(cols if cols is not None else numeric_cols(df, keys))
    hot = hot_groups(df, keys)
    base = df.select(*keys, *[as_double(df, c).alias(c) for c in cols])
    ranks = quantiles(base, cols, (0.25, 0.5, 0.75), keys, method)
    pairs = long_form(base, {c: F.col(c) for c in cols}, keys)
    spread = pairs.groupBy(*keys, "column").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
    spread = spread.select(
        *[F.col(k).alias(f"s_{k}") for k in keys], F.col("column").alias("s_column"), "mean", "spread"
    )
    on = F.col("column") == F.col("s_column")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    known = F.struct(
        F.get("q", 0).alias("q1"), F.get("q", 1).alias("median"), F.get("q", 2).alias("q3"), "mean", "spread"
    )
    spread = spread if hot is None else spread.hint("merge")
    table = materialise(ranks.join(spread, on, "left").select(*keys, "column", known.alias("t")))
    rows = _with_thresholds(base, table, keys, "\0t", hot)
    t = lambda c, name: F.col("\0t")[c][name]
    away = {c: F.abs(F.col(c) - t(c, "median")) for c in cols}
    mads = quantiles(rows, away, (0.5,), keys, method)
    mads = materialise(mads.select(*keys, "column", F.struct(F.get("q", 0).alias("mad")).alias("t")))
    rows = _with_thresholds(rows, mads, keys, "\0m", hot)
    aggs, fields = [], {}
    for i, c in enumerate(cols):
        x = F.col(c)
        width = FENCE * (t(c, "q3") - t(c, "q1"))
        z = F.abs(F.try_divide(x - t(c, "mean"), F.nullif(t(c, "spread"), F.lit(0.0))))
        mad = F.nullif(F.col("\0m")[c]["mad"], F.lit(0.0))
        modified = F.abs(F.try_divide(MAD_SCALE * (x - t(c, "median")), mad))
        aggs += [
            F.count(x).alias(f"n_{i}"),
            F.count_if((x < t(c, "q1") - width) | (x > t(c, "q3") + width)).alias(f"iqr_{i}"),
            F.count_if(z > Z_LIMIT).alias(f"z_{i}"), F.max(z).alias(f"most_{i}"), F.avg(z).alias(f"mean_{i}"),
            F.count_if(modified > MODIFIED_Z_LIMIT).alias(f"m_{i}"), F.count(modified).alias(f"with_{i}"),
        ]
        fields[c] = {
            "rows": f"n_{i}", "outliers_iqr": f"iqr_{i}",
            "percentage_iqr": percent(F.col(f"iqr_{i}"), F.col(f"n_{i}")),
            "outliers_zscore": f"z_{i}", "max_zscore": f"most_{i}", "mean_zscore": f"mean_{i}",
            "outliers_modified_z": F.when(F.col(f"with_{i}") > 0, F.col(f"m_{i}")),
        }
    return tidy(rows.groupBy(*keys).agg(*aggs), fields, keys)


def segment_pairs(
    df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None
) -> DataFrame:
    """(by…, var1, var2, n, r) over the pair-complete rows of each segment; r is NULL when a
    side is constant there. Co-moments are combined map-side, so a hot segment is one row of
    each task and pair."""
    keys = list(by)
    cols = list(cols if cols is not None else numeric_cols(df, keys))
    base = df.select(*keys, *[as_double(df, c).alias(f"x_{i}") for i, c in enumerate(cols)])
    pairs = [
        F.struct(F.lit(cols[i]).alias("var1"), F.lit(cols[j]).alias("var2"),
                 F.col(f"x_{i}").alias("x"), F.col(f"x_{j}").alias("y"))
        for i in range(len(cols)) for j in range(i + 1, len(cols))
    ]
    rows = base.select(*keys, F.inline(F.array(*pairs)))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()

    def held(c: str) -> Column:
        return F.when(both, F.col(c))

    spread = F.stddev_pop(held("x")) * F.stddev_pop(held("y"))
    r = F.try_divide(F.covar_pop("x", "y"), spread)
    return rows.groupBy(*keys, "var1", "var2").agg(F.count_if(both).alias("n"), r.alias("r"))


def segment_sections(
    df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None, label: str | None = None,
    bins: int = 20, method: str = "auto",
) -> dict[str, DataFrame]:
    """All sections of a profile per segment."""
    keys = list(by)
    cols = list(cols if cols is not None else numeric_cols(df, [*keys, label] if label else keys))
    out = {
        "summary": segment_profile(df, keys, cols, label, method),
        "percentiles": profile.percentiles(df, cols, by=keys, method=method),
        "histogram": histogram(df, cols, bins, keys),
        "outliers": segment_outliers(df, keys, cols, method),
    }
    if len(cols) > 1:
        out["pairs"] = segment_pairs(df, keys, cols)
    return out
