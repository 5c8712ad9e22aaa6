"""Gap, duration and time-of-day queries, streaming included."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.catalogue.registry import TX, r, register, rounded, table, tx, union_all, with_views
from ledgerlens.operators import temporal
from ledgerlens.roles import seconds_of
from ledgerlens.session import scratch_path
from ledgerlens.streaming import incremental

# fmt: off

GAPS = "gaps AS (SELECT time, gap FROM (SELECT time, time - lag(time) OVER (ORDER BY time) AS gap FROM tx))"


@register("time_gaps", with_views(
    f"SELECT {r('time')} AS time, count(*) AS rows, {r('time - lag(time) OVER (ORDER BY time)')} AS gap FROM tx GROUP BY time", TX))
def time_gaps(spark, sf_dir):
    return rounded(temporal.time_gaps(tx(spark, sf_dir), "time"))


@register("time_gaps_by_user", with_views(
    f"SELECT user_id, {r('time')} AS time, count(*) AS rows, {r('time - lag(time) OVER (PARTITION BY user_id ORDER BY time)')} AS gap FROM tx GROUP BY user_id, time", TX))
def time_gaps_by_user(spark, sf_dir):
    return rounded(temporal.time_gaps(tx(spark, sf_dir), "time", ["user_id"]))


_STATS = (f"count(gap) AS gaps, {r('avg(gap)')} AS mean_gap, {r('quantile_cont(gap, 0.5)')} AS median_gap, {r('stddev_samp(gap)', 5)} AS std_gap, "
          f"{r('min(gap)')} AS min_gap, {r('max(gap)')} AS max_gap, count(*) FILTER (gap > 3600) AS gaps_over_1hour, count(*) FILTER (gap > 86400) AS gaps_over_1day")


def _gap_round(df):
    return rounded(df.withColumn("std_gap", F.round("std_gap", 5)))


@register("gap_stats", with_views(f"SELECT {_STATS} FROM gaps", TX, GAPS))
def gap_stats(spark, sf_dir):
    return _gap_round(temporal.gap_stats(tx(spark, sf_dir), "time"))


@register("gap_stats_by_type", with_views(
    f"SELECT event_type, {_STATS} FROM (SELECT event_type, time - lag(time) OVER (PARTITION BY event_type ORDER BY time) AS gap FROM tx) GROUP BY event_type", TX))
def gap_stats_by_type(spark, sf_dir):
    return _gap_round(temporal.gap_stats(tx(spark, sf_dir), "time", ["event_type"]))


@register("gap_stats_ship_dates", f"SELECT {_STATS} FROM (SELECT t - lag(t) OVER (ORDER BY t) AS gap FROM (SELECT epoch(l_shipdate) AS t FROM lineitem))")
def gap_stats_ship_dates(spark, sf_dir):
    """Heavy ties: many rows share a ship date."""
    lines = table(spark, sf_dir, "lineitem")
    return _gap_round(temporal.gap_stats(lines.select(seconds_of(lines, "l_shipdate").alias("t")), "t"))


@register("duration", with_views(
    f"SELECT {r('max(time) - min(time)', 7)} AS duration_seconds, {r('(max(time) - min(time)) / 3600', 7)} AS duration_hours, {r('(max(time) - min(time)) / 86400', 7)} AS duration_days, "
    f"{r('avg(time)', 4)} AS mean_time, {r('quantile_cont(time, 0.5)', 7)} AS median_time FROM tx", TX))
def duration(spark, sf_dir):
    return rounded(temporal.duration(tx(spark, sf_dir), "time").withColumn("mean_time", F.round("mean_time", 4)), 7)


def cycle_sql(slot: str, name: str, bins: int) -> str:
    return (f"SELECT CAST(b AS INTEGER) AS {name}, coalesce(n, 0) AS count FROM range({bins}) t(b) LEFT JOIN "
            f"(SELECT CAST({slot} AS INTEGER) AS slot, count(*) AS n FROM tx GROUP BY slot) ON b = slot")


HOURS = cycle_sql("floor((time % 86400) / 3600)", "hour", 24)


@register("hourly_pattern", with_views(HOURS, TX))
def hourly_pattern(spark, sf_dir):
    return temporal.hourly_pattern(tx(spark, sf_dir), "time")


@register("hourly_pattern_clock", """SELECT CAST(b AS INTEGER) AS hour, coalesce(n, 0) AS count FROM range(24) t(b)
LEFT JOIN (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY h) ON b = h""")
def hourly_pattern_clock(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return temporal.hourly_pattern(events.select(seconds_of(events, "ts").alias("t")), "t")


_G = "least(greatest(ceil((v - lo) * 24 / (hi - lo)) - 1, 0), 23)"


@register("hourly_pattern_equal_width", with_views(
    "SELECT CAST(b AS INTEGER) AS hour, coalesce(n, 0) AS count FROM range(24) t(b) LEFT JOIN (SELECT CAST(CASE WHEN g > 0 AND v <= g * ((hi - lo) / 24) + lo THEN g - 1 "
    "WHEN g < 23 AND v > (g + 1) * ((hi - lo) / 24) + lo THEN g + 1 ELSE g END AS INTEGER) AS slot, count(*) AS n FROM "
    f"(SELECT *, {_G} AS g FROM (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (SELECT (time % 86400) / 3600 AS v FROM tx))) GROUP BY slot) ON b = slot", TX))
def hourly_pattern_equal_width(spark, sf_dir):
    return temporal.hourly_pattern(tx(spark, sf_dir), "time", "equal_width")


@register("weekly_pattern", with_views(
    cycle_sql("floor((time / 86400) % 7)", "day", 7) + " WHERE (SELECT max(time) - min(time) > 7 * 86400 FROM tx)", TX))
def weekly_pattern(spark, sf_dir):
    return temporal.weekly_pattern(tx(spark, sf_dir), "time")


@register("peak_hour", with_views(
    f"SELECT arg_max(hour, (count, -hour)) AS peak_hour, max(count) AS peak_count, arg_min(hour, (count, hour)) AS lowest_hour, min(count) AS lowest_count FROM ({HOURS})", TX))
def peak_hour(spark, sf_dir):
    return temporal.peak_and_lowest(temporal.hourly_pattern(tx(spark, sf_dir), "time"), "hour")


@register("time_by_class", with_views(
    f"SELECT {r('avg(time) FILTER (label = 1)', 4)} AS positive_mean_time, {r('avg(time) FILTER (label = 0)', 4)} AS negative_mean_time, "
    f"{r('quantile_cont(time, 0.5) FILTER (label = 1)', 4)} AS positive_median_time, {r('quantile_cont(time, 0.5) FILTER (label = 0)', 4)} AS negative_median_time, "
    f"any_value(d) AS statistic FROM tx, (SELECT {r('max(abs(cum1 / n1 - cum0 / n0))', 4)} AS d FROM (SELECT sum(label) OVER (ORDER BY time) AS cum1, "
    "sum(1 - label) OVER (ORDER BY time) AS cum0, sum(label) OVER () AS n1, sum(1 - label) OVER () AS n0 FROM tx))", TX))
def time_by_class(spark, sf_dir):
    return rounded(temporal.time_by_class(tx(spark, sf_dir), "time", "label").drop("p_value", "significant"), 4)


# -- incremental ------------------------------------------------------------------------

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _moments_sql(c: str) -> str:
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, {r(f'avg({c})', 7)} AS mean, {r(f'stddev_samp({c})', 7)} AS std, "
            f"{r(f'min({c})', 7)} AS min, {r(f'max({c})', 7)} AS max, {r(f'skewness({c})', 7)} AS skewness, {r(f'kurtosis({c})', 7)} AS kurtosis FROM lineitem")


@register("incremental_profile", union_all(_moments_sql(c) for c in LINE_NUMBERS))
def incremental_profile(spark, sf_dir):
    schema = table(spark, sf_dir, "lineitem").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    state = scratch_path(spark, "state")
    incremental.incremental_profile(stream, LINE_NUMBERS, state, scratch_path(spark, "offsets")).awaitTermination()
    return rounded(incremental.read_profile(spark, state).drop("approx_quantiles"), 7)


@register("incremental_folded", union_all(_moments_sql(c) for c in LINE_NUMBERS))
def incremental_folded(spark, sf_dir):
    """Two arrivals with a fold between them, and the first batch replayed after it."""
    lines = table(spark, sf_dir, "lineitem")
    state, early = scratch_path(spark, "state"), F.col("l_linenumber") <= 3
    incremental.save_partial(lines.where(early), LINE_NUMBERS, state, 0)
    incremental.fold_partials(spark, state)
    incremental.save_partial(lines.where(~early), LINE_NUMBERS, state, 1)
    incremental.save_partial(lines.where(early), LINE_NUMBERS, state, 0)
    return rounded(incremental.read_profile(spark, state).drop("approx_quantiles"), 7)


@register("merged_partials", union_all(_moments_sql(c) for c in LINE_NUMBERS))
def merged_partials(spark, sf_dir):
    """Partials per return flag merged into one profile."""
    lines = table(spark, sf_dir, "lineitem")
    flags = [x.l_returnflag for x in lines.select("l_returnflag").distinct().collect()]
    parts = [incremental.partial_profile(lines.where(F.col("l_returnflag").eqNullSafe(F.lit(flag))), LINE_NUMBERS) for flag in flags]
    both = reduce(DataFrame.unionByName, parts)
    return rounded(incremental.finish_profile(incremental.merge_partials(both)).drop("approx_quantiles"), 7)


def _sum_by_type(chunk: pd.DataFrame) -> pd.DataFrame:
    grouped = chunk.groupby("event_type", as_index=False)
    return grouped.agg(rows=("event_id", "size"), amount=("value", "sum"))


def _merge_sums(parts: pd.DataFrame) -> pd.DataFrame:
    return parts.groupby("event_type", as_index=False).agg(rows=("rows", "sum"), amount=("amount", "sum"))


@register("map_reduce_chunks", f"SELECT event_type, count(*) AS rows, {r('sum(value)', 4)} AS amount FROM events GROUP BY event_type")
def map_reduce_chunks(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rounded(incremental.map_reduce_chunks(events, _sum_by_type, _merge_sums, "event_type string, rows bigint, amount double"), 4)


@register("hourly_stream", """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(hour(w) AS INTEGER) AS hour, count(*) AS count
FROM (SELECT date_trunc('hour', ts) AS w FROM events) WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY w""")
def hourly_stream(spark, sf_dir):
    """Closed hourly windows; the last open ones stay in state until later data arrive."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = scratch_path(spark, "hours")
    counts = incremental.hourly_stream(stream, "ts")
    writer = counts.writeStream.format("parquet").option("path", out).outputMode("append")
    writer.option("checkpointLocation", scratch_path(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(counts.schema).parquet(out)
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
