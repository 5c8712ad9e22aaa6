"""Ordered running sums without a single-task sort.

Values are first reduced to one row per distinct value (so a value held by a third
of all rows costs one row), then cut into buckets at split points taken from quantile
sketches.  Buckets form a tree: every level cuts each bucket into at most ``FANOUT``
parts, so a bucket is named by a path of small numbers, and offsets are added up level
by level.  The driver and a broadcast hold ``FANOUT`` split points, or its square, however
many values there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.session import materialise

ROWS_PER_BUCKET = 1_000_000
FANOUT = 256  # parts of a bucket on the next level
_CHUNK = 16  # split points looked through at once
SKETCH_SIZE = 4_000
_MERGED = 64  # sketches of one merge


def sketched(
    base: DataFrame, values: Mapping[str, Column], probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys…, n_, d_, min_, max_, q_ for every name): counts, approximate distinct counts,
    extremes and approximate quantiles of named expressions.

    Sketches of the input partitions are merged in a tree of three levels, so no task
    gets more of them than a bounded share, however many tasks there are.
    """
    made, merged, read = [], [], []
    for name in values:
        x = F.col(f"value_{name}")
        # NaN never comes here, and a sketch of nothing is NULL.
        made += [
            F.count(x).alias(f"n_{name}"), F.min(x).alias(f"min_{name}"),
            F.max(x).alias(f"max_{name}"), F.hll_sketch_agg(x.cast("string")).alias(f"d_{name}"),
            F.kll_sketch_agg_double(x, F.lit(SKETCH_SIZE)).alias(f"q_{name}"),
        ]
        merged += [
            F.sum(f"n_{name}").alias(f"n_{name}"), F.min(f"min_{name}").alias(f"min_{name}"),
            F.max(f"max_{name}").alias(f"max_{name}"), F.hll_union_agg(f"d_{name}").alias(f"d_{name}"),
            F.kll_merge_agg_double(f"q_{name}").alias(f"q_{name}"),
        ]
        found = F.kll_sketch_get_quantile_double(
            f"q_{name}", F.array(*[F.lit(float(p)) for p in probs])
        )
        read += [
            F.col(f"n_{name}"), F.col(f"min_{name}"), F.col(f"max_{name}"),
            F.hll_sketch_estimate(f"d_{name}").alias(f"d_{name}"),
            F.when(F.col(f"n_{name}") > 0, found).alias(f"q_{name}"),
        ]
    rows = base.select(*keys, *[x.alias(f"value_{name}") for name, x in values.items()])
    level = rows.groupBy(*keys, F.spark_partition_id().alias("part")).agg(*made)
    for size in (_MERGED, _MERGED):
        level = level.groupBy(*keys, F.floor(F.col("part") / size).alias("part")).agg(*merged)
    return level.groupBy(*keys).agg(*merged).select(*keys, *read)


def _slot(points: Column, x: Column) -> Column:
    """How many of the sorted points are at most x; looks through chunks, then through one."""
    heads = F.filter(points["heads"], lambda p: p <= x)
    chunk = F.coalesce(F.get(points["chunks"], F.size(heads) - 1), F.array().cast("array<double>"))
    inside = F.size(F.filter(chunk, lambda p: p <= x))
    return F.greatest(F.size(heads) - 1, F.lit(0)) * _CHUNK + inside


def _with_buckets(counts: DataFrame, levels: int) -> tuple[DataFrame, list[str]]:
    """``counts`` with the path of every value through ``levels`` levels of buckets."""
    grid = [i / FANOUT for i in range(1, FANOUT)]
    path: list[str] = []
    for level in range(levels):
        name = f"bucket_{level}"
        found = sketched(counts, {"x": F.col("x")}, grid, path)
        if not path:
            points = sorted(set(found.head().q_x))  # FANOUT numbers
            splits = [float("-inf"), *points, float("inf")]
            counts = Bucketizer(splits=splits, inputCol="x", outputCol=name).transform(counts)
            counts = counts.withColumn(name, F.col(name).cast("int"))
        else:
            points = F.array_sort(F.array_distinct("q_x"))
            starts = F.sequence(F.lit(1), F.size(points), F.lit(_CHUNK))
            table = found.select(
                *[F.col(k).alias(f"of_{k}") for k in path],
                F.struct(
                    F.transform(starts, lambda i: F.get(points, i - 1)).alias("heads"),
                    F.transform(starts, lambda i: F.slice(points, i, F.lit(_CHUNK))).alias("chunks"),
                ).alias("points"),
            )
            on = F.lit(True)
            for k in path:
                on = on & (F.col(k) == F.col(f"of_{k}"))
            # The second level's split points are FANOUT rows; deeper ones are shuffled.
            table = F.broadcast(table) if level == 1 else table
            joined = counts.join(table, on)
            counts = joined.withColumn(name, _slot(F.col("points"), F.col("x")).cast("int"))
            counts = counts.drop("points", *[f"of_{k}" for k in path])
        path.append(name)
        if level + 1 < levels:
            counts = materialise(counts)
    return counts, path


def _offsets(totals: DataFrame, keys: list[str], path: list[str], sums: Sequence[str]) -> DataFrame:
    """(keys…, path…, last_x, off_, tot_) from the totals of buckets: what lies before each.

    Every level adds up at most FANOUT buckets of one parent; parents are a level of their own.
    """
    if not path:
        return totals.select(
            *keys, F.lit(None).cast("double").alias("last_x"),
            *[F.lit(0).cast("long").alias(f"off_{k}") for k in sums],
            *[F.col(f"sum_{k}").alias(f"tot_{k}") for k in sums],
        )
    parent = path[:-1]
    above = totals.groupBy(*keys, *parent).agg(
        F.max("last_x").alias("last_x"), *[F.sum(f"sum_{k}").alias(f"sum_{k}") for k in sums]
    )
    upper = _offsets(above, keys, parent, sums)
    upper = upper.select(
        *[F.col(k).alias(f"u_{k}") for k in (*keys, *parent)], F.col("last_x").alias("u_last_x"),
        *[F.col(f"{t}_{k}").alias(f"u_{t}_{k}") for k in sums for t in ("off", "tot")],
    )
    in_order = Window.partitionBy(*keys, *parent, F.lit(0)).orderBy(path[-1])
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    own = totals.select(
        *keys, *path, F.lag("last_x").over(in_order).alias("lag_x"),
        *[F.coalesce(F.sum(f"sum_{k}").over(before), F.lit(0)).alias(f"own_{k}") for k in sums],
    )
    on = F.lit(True)
    for k in (*keys, *parent):
        on = on & F.col(k).eqNullSafe(F.col(f"u_{k}"))
    return own.join(upper, on).select(
        *keys, *path, F.coalesce("lag_x", "u_last_x").alias("last_x"),
        *[(F.col(f"own_{k}") + F.col(f"u_off_{k}")).alias(f"off_{k}") for k in sums],
        *[F.col(f"u_tot_{k}").alias(f"tot_{k}") for k in sums],
    )


def ordered_sums(
    df: DataFrame, x: Column, sums: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """One row per (by…, distinct x) in order.

    Output: by…, x, prev_x (the next smaller distinct value), and for every name in
    ``sums`` the sum at x (``name``), the inclusive running sum (``cum_name``) and the
    group total (``tot_name``).  A bucket has about ``ROWS_PER_BUCKET`` rows.
    """
    keys = list(by)
    base = df.select(
        *keys, x.cast("double").alias("x"), *[e.alias(k) for k, e in sums.items()]
    ).where(F.col("x").isNotNull())
    counts = base.groupBy(*keys, "x").agg(*[F.sum(k).alias(k) for k in sums])
    levels = 0
    if base.count() > ROWS_PER_BUCKET:
        counts = materialise(counts)
        room, rows = ROWS_PER_BUCKET, counts.count()
        while room < rows:
            room, levels = room * FANOUT, levels + 1
    counts, path = _with_buckets(counts, levels)
    inside = Window.partitionBy(*keys, *path, F.lit(0)).orderBy("x")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = {k: F.sum(k).over(upto) for k in sums}
    if not path:  # one bucket for each group
        whole = Window.partitionBy(*keys, F.lit(0))
        return counts.select(
            *keys, "x", F.lag("x").over(inside).alias("prev_x"), *sums,
            *[cum[k].alias(f"cum_{k}") for k in sums],
            *[F.sum(k).over(whole).alias(f"tot_{k}") for k in sums],
        )
    totals = counts.groupBy(*keys, *path).agg(
        F.max("x").alias("last_x"), *[F.sum(k).alias(f"sum_{k}") for k in sums]
    )
    offsets = _offsets(materialise(totals), keys, path, list(sums))
    offsets = offsets.select(
        *[F.col(k).alias(f"o_{k}") for k in (*keys, *path)],
        "last_x", *[F.col(f"{t}_{k}") for k in sums for t in ("off", "tot")],
    )
    on = F.lit(True)
    for k in (*keys, *path):
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    return counts.join(offsets, on).select(
        *keys,
        "x",
        F.coalesce(F.lag("x").over(inside), F.col("last_x")).alias("prev_x"),
        *sums,
        *[(cum[k] + F.col(f"off_{k}")).alias(f"cum_{k}") for k in sums],
        *[F.col(f"tot_{k}") for k in sums],
    )


def ordered_quantiles(
    df: DataFrame,
    x: Column,
    probs: Sequence[float],
    by: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """Exact interpolated quantiles (by…, q) of x, each row counting ``weight`` times."""
    o = ordered_sums(df, x, {"n": weight if weight is not None else F.lit(1)}, by)
    picks = []
    for p in probs:
        h = F.lit(float(p)) * (F.col("tot_n") - 1)
        low = F.min(F.when(F.col("cum_n") > F.floor(h), F.col("x")))
        high = F.min(F.when(F.col("cum_n") > F.ceil(h), F.col("x")))
        share = F.max(h - F.floor(h))
        picks.append(low + (high - low) * share)
    return o.groupBy(*by).agg(F.array(*picks).alias("q"))
