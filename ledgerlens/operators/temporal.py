"""Gaps, durations and time-of-day patterns.  Time columns are seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.classes import labelled
from ledgerlens.operators.ordered import ordered_quantiles, ordered_sums
from ledgerlens.operators.quantiles import MAX_DISTINCT, quantiles
from ledgerlens.operators.two_sample import ks_two_sample
from ledgerlens.roles import as_double
from ledgerlens.session import materialise

HOUR, DAY = 3600, 86400


def time_gaps(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """(by…, time, rows, gap) in time order, one row per distinct time.

    ``gap`` is the distance to the previous distinct time; the other rows at the same
    time have gap zero, which the ``rows`` count carries.
    """
    o = ordered_sums(df, as_double(df, time), {"rows": F.lit(1)}, by)
    return o.select(
        *by, F.col("x").alias("time"), "rows", (F.col("x") - F.col("prev_x")).alias("gap")
    )


def gap_stats(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, median, std, min, max gap and gaps over an hour and a day.

    The gap table costs a sort and is read three times, so it is written once.
    """
    return gap_stats_of(materialise(time_gaps(df, time, by)), by)


def gap_stats_of(gaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`gap_stats` of a written gap table (by…, time, rows, gap)."""
    keys = list(by)
    moved = F.col("gap")
    n = F.sum("rows").cast("double")
    stats = gaps.groupBy(*keys).agg(
        n.alias("rows"),
        F.count(moved).cast("double").alias("steps"),
        F.avg(moved).alias("step_mean"),
        F.var_pop(moved).alias("step_var"),
        F.min(moved).alias("step_min"),
        F.max(moved).alias("step_max"),
        (F.max("time") - F.min("time")).alias("span"),
        F.count_if(moved > HOUR).alias("gaps_over_1hour"),
        F.count_if(moved > DAY).alias("gaps_over_1day"),
    )
    weighted = gaps.select(
        *keys,
        F.inline(
            F.array(
                F.struct(moved.alias("g"), F.lit(1).cast("bigint").alias("w")),
                F.struct(F.lit(0.0).alias("g"), (F.col("rows") - 1).alias("w")),
            )
        ),
    ).where((F.col("w") > 0) & F.col("g").isNotNull())
    if gaps.limit(MAX_DISTINCT + 1).count() <= MAX_DISTINCT:  # all values fit a task
        middle = weighted.groupBy(*keys).agg(F.array(F.percentile("g", 0.5, F.col("w"))).alias("q"))
    else:
        middle = ordered_quantiles(weighted, F.col("g"), [0.5], keys, F.col("w"))
    middle = middle.select(
        *[F.col(k).alias(f"m_{k}") for k in keys], F.get("q", 0).alias("median_gap")
    )
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"m_{k}"))
    total = F.col("rows") - 1
    still = total - F.col("steps")
    square = F.coalesce(F.col("step_var") * F.col("steps"), F.lit(0.0)) + F.coalesce(
        F.try_divide(still * F.col("steps"), total) * F.col("step_mean") * F.col("step_mean"),
        F.lit(0.0),
    )
    some = F.when(total > 0, F.lit(True))
    table = stats.join(middle, on, "left") if keys else stats.withColumn(
        "median_gap", middle.select("median_gap").scalar()
    )
    return table.select(
        *keys,
        total.cast("bigint").alias("gaps"),
        F.try_divide("span", total).alias("mean_gap"),
        "median_gap",
        F.when(total > 1, F.sqrt(square / (F.greatest(total - 1, F.lit(1.0))))).alias("std_gap"),
        F.when(some, F.when(still > 0, 0.0).otherwise(F.col("step_min"))).alias("min_gap"),
        F.when(some, F.coalesce("step_max", F.lit(0.0))).alias("max_gap"),
        "gaps_over_1hour",
        "gaps_over_1day",
    )


def duration(df: DataFrame, time: str) -> DataFrame:
    """Length in seconds, hours and days with mean and median time."""
    middle = quantiles(df, [time], (0.5,)).select(F.get("q", 0)).scalar()
    span = F.max(as_double(df, time)) - F.min(as_double(df, time))
    row = df.agg(span.alias("duration_seconds"), F.avg(as_double(df, time)).alias("mean_time"))
    return row.select(
        "duration_seconds",
        (F.col("duration_seconds") / HOUR).alias("duration_hours"),
        (F.col("duration_seconds") / DAY).alias("duration_days"),
        "mean_time",
        middle.alias("median_time"),
    )


def _equal_width(df: DataFrame, value: Column, bins: int) -> Column:
    """Right-closed equal-width cut of min..max; a value on an edge goes left."""
    low, high = df.agg(F.min(value), F.max(value)).head()
    if low is None or low == high:
        return F.lit(bins // 2 - 1)  # a constant sits on the middle edge
    step = (high - low) / bins
    guess = F.ceil((value - low) * F.lit(float(bins)) / F.lit(high - low)) - 1
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1))
    return (
        F.when((guess > 0) & (value <= guess * step + low), guess - 1)
        .when((guess < bins - 1) & (value > (guess + 1) * step + low), guess + 1)
        .otherwise(guess)
    )


def _cycle(df: DataFrame, value: Column, bins: int, name: str, mode: str) -> DataFrame:
    if mode == "clock":
        slot = F.floor(value)
    elif mode == "equal_width":
        slot = _equal_width(df, value, bins)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    counts = df.where(value.isNotNull()).groupBy(slot.cast("int").alias("slot"))
    counts = counts.agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias(name))
    return every.join(counts, F.col(name) == F.col("slot"), "left").select(
        name, F.coalesce("n", F.lit(0)).alias("count")
    )


def hourly_pattern(df: DataFrame, time: str, mode: str = "clock") -> DataFrame:
    """(hour, count) for 24 hours; ``equal_width`` cuts the observed range instead."""
    return _cycle(df, F.pmod(as_double(df, time), F.lit(float(DAY))) / HOUR, 24, "hour", mode)


def weekly_pattern(df: DataFrame, time: str, mode: str = "clock") -> DataFrame:
    """(day, count) for 7 days; empty unless the data span more than seven days."""
    t = as_double(df, time)
    table = _cycle(df, F.pmod(t / DAY, F.lit(7.0)), 7, "day", mode)
    span = df.agg(F.max(t) - F.min(t)).scalar()
    return table.where(span > 7 * DAY)


def peak_and_lowest(pattern: DataFrame, slot: str) -> DataFrame:
    """Busiest and quietest slot with their counts; the first slot wins a tie."""
    rank = F.struct(F.col("count"), -F.col(slot))
    return pattern.agg(
        F.max_by(slot, rank).alias(f"peak_{slot}"),
        F.max("count").alias("peak_count"),
        F.min_by(slot, F.struct("count", slot)).alias(f"lowest_{slot}"),
        F.min("count").alias("lowest_count"),
    )


def time_by_class(df: DataFrame, time: str, label: str) -> DataFrame:
    """Mean and median time of both classes with the two-sample test."""
    both = labelled(df, label)
    mid = quantiles(both, [time], (0.5,), [label]).select(
        F.col(label).alias("m_label"), F.get("q", 0).alias("median_time")
    )
    per = both.groupBy(label).agg(F.avg(as_double(df, time)).alias("mean_time"))
    per = per.join(mid, F.col(label) == F.col("m_label"))

    def of(value: int, name: str) -> Column:
        return F.max(F.when(F.col(label) == value, F.col(name)))

    means = per.agg(
        of(1, "mean_time").alias("positive_mean_time"),
        of(0, "mean_time").alias("negative_mean_time"),
        of(1, "median_time").alias("positive_median_time"),
        of(0, "median_time").alias("negative_median_time"),
    )
    test = ks_two_sample(df, [time], label)
    named = means.withColumn("test_column", F.lit(time))
    return named.join(test, F.col("test_column") == F.col("column"), "left").select(
        *means.columns, "statistic", "p_value", "significant"
    )
