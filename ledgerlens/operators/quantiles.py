"""Exact quantiles that stay bounded on high-cardinality columns.

``builtin``  Spark's ``percentile``: one pass, but its value→count map must fit one
             task, so it is used only when a sketch shows few distinct values.
``select``   narrowing: a sketch brackets each wanted order statistic, a count pass
             verifies the bracket, and only values inside it are ordered.  Scans
             instead of shuffles; for a small number of groups.
``ordered``  running counts over bucketed values; for many groups with hot ones.
``approx``   ``percentile_approx``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlens.functions.stats import every_column, long_form
from ledgerlens.operators.ordered import ordered_quantiles, sketched
from ledgerlens.roles import as_double

MAX_DISTINCT = 200_000  # values of one column and group that a task may hold
MAX_INSIDE = 250_000
MAX_GROUPS = 64
ACCURACY = 10_000  # of ``approx``
MARGIN = 0.002  # of the ranks around a wanted one; brackets are verified by counting
_GRID = [i / 1000 for i in range(1001)]
_DOUBLES = T.ArrayType(T.DoubleType())


def expressions(df: DataFrame, cols: Sequence[str] | Mapping[str, Column]) -> dict[str, Column]:
    """Named double expressions from column names or a ready mapping."""
    if isinstance(cols, Mapping):
        return {k: e.cast("double") for k, e in cols.items()}
    return {c: as_double(df, c) for c in cols}


def quantiles(
    df: DataFrame,
    cols: Sequence[str] | Mapping[str, Column],
    probs: Sequence[float],
    by: Sequence[str] = (),
    method: str = "auto",
    max_distinct: int = MAX_DISTINCT,
    max_groups: int = MAX_GROUPS,
    picked: Mapping[str, str] | None = None,
) -> DataFrame:
    """(by…, column, q) with q aligned to ``probs``, linear interpolation.

    A row for every group and column, whatever the method; q is NULL where a column has
    no value in a group. ``picked`` names the method of each column where it is known.
    """
    exprs = expressions(df, cols)
    names = list(exprs)
    keys = list(by)
    pairs = long_form(df, exprs, keys)
    if method == "auto":
        picked = picked or _choose(pairs, names, keys, max_distinct, max_groups)
        parts = [
            _found(df, {c: exprs[c] for c in names if picked[c] == m}, probs, keys, m)
            for m in dict.fromkeys(picked.values())
        ]
        many = "ordered" in picked.values()
        return _every_pair(df, reduce(DataFrame.unionByName, parts), names, keys, many)
    return _every_pair(df, _found(df, exprs, probs, keys, method), names, keys, method == "ordered")


def _every_pair(
    df: DataFrame, found: DataFrame, names: Sequence[str], keys: Sequence[str], many: bool
) -> DataFrame:
    """A row for every group of ``df`` and every column name; no broadcast of ``many`` groups."""
    if not keys:
        return every_column(found, names)
    listed = F.explode(F.array(*[F.lit(c) for c in names])).alias("column")
    pairs = df.select(*keys).distinct().select("*", listed)
    found = found.select(
        *[F.col(k).alias(f"found_{k}") for k in keys], F.col("column").alias("found_column"), "q"
    )
    on = F.col("column") == F.col("found_column")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"found_{k}"))
    found = found.hint("merge") if many else found
    return pairs.join(found, on, "left").select(*keys, "column", "q")


def _found(
    df: DataFrame, exprs: Mapping[str, Column], probs: Sequence[float], keys: list[str], method: str
) -> DataFrame:
    """Quantiles by one method; pairs without a value may be missing."""
    names, pairs = list(exprs), long_form(df, exprs, keys)
    if method == "builtin":
        # Counted first, so that a column's reducer sees each of its values once.
        pairs = pairs.groupBy(*keys, "column", "x").agg(F.count("*").alias("n"))
        found = F.percentile("x", _array(probs), F.col("n"))
    elif method == "approx":
        found = F.percentile_approx("x", list(probs), ACCURACY)
    elif method == "select":
        base = df.select(*keys, *[e.alias(f"x_{i}") for i, e in enumerate(exprs.values())])
        return _select(base, names, list(probs), keys)
    elif method == "ordered":
        return ordered_quantiles(pairs, F.col("x"), probs, [*keys, "column"])
    else:
        raise ValueError(f"unknown quantile method {method!r}")
    return pairs.groupBy(*keys, "column").agg(found.alias("q"))


def quantile_values(
    df: DataFrame, cols: Sequence[str] | Mapping[str, Column], probs: Sequence[float],
    method: str = "auto", picked: Mapping[str, str] | None = None,
) -> dict[str, list[float | None]]:
    """Collected quantiles per column: len(cols) × len(probs) numbers."""
    names = list(cols)
    rows = quantiles(df, cols, probs, method=method, picked=picked).collect()
    none = [None] * len(probs)
    return dict.fromkeys(names, none) | {r["column"]: list(r["q"] or none) for r in rows}


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _choose(
    pairs: DataFrame, names: list[str], keys: list[str], max_distinct: int, max_groups: int
) -> dict[str, str]:
    """``builtin`` for columns whose distinct values fit one task in every group."""
    sizes = pairs.groupBy(*keys, "column").agg(F.approx_count_distinct("x").alias("d"))
    rows = sizes.groupBy("column").agg(F.max("d").alias("d"), F.count("*").alias("groups"))
    picked = dict.fromkeys(names, "builtin")
    for row in rows.collect():  # one row per column
        if row.d > max_distinct:
            picked[row["column"]] = "select" if row.groups <= max_groups else "ordered"
    return picked


class _Target:
    """One wanted quantile of one column in one group while its bracket narrows."""

    def __init__(self, group: tuple, col: int, prob: float, n: int, low: float, high: float):
        self.group, self.col, self.low, self.high = group, col, low, high
        position = prob * (n - 1)
        self.k0, self.k1 = math.floor(position), math.ceil(position)
        self.share = position - self.k0
        self.below = self.inside = 0
        self.missed = self.settled = False

    def check(self, below: int, inside: int) -> bool:
        """Record the counts; True when the bracket is right and small enough."""
        self.below, self.inside = below, inside
        self.missed = below > self.k0 or below + inside <= self.k1
        self.settled = not self.missed and (
            self.settled or self.low == self.high or inside <= MAX_INSIDE
        )
        return self.settled

    def narrow(self, limits: tuple[float, float], grid: list[float] | None, distinct: int) -> None:
        """Take the grid cells around the wanted ranks, unless ties fill the bracket."""
        if self.missed:
            self.low, self.high = limits
        elif distinct <= MAX_INSIDE:
            self.settled = True
        else:
            last = len(grid) - 1
            first_cell = math.floor((self.k0 - self.below) / self.inside * last) - 1
            last_cell = math.ceil((self.k1 - self.below + 1) / self.inside * last) + 1
            self.low, self.high = grid[max(0, first_cell)], grid[min(last, last_cell)]


def _select(base: DataFrame, names: list[str], probs: list[float], keys: list[str]) -> DataFrame:
    around = [q for p in probs for q in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    first = sketched(base, {str(i): F.col(f"x_{i}") for i in range(len(names))}, around, keys)
    limits: dict[tuple, tuple[float, float]] = {}
    targets: dict[tuple, list[_Target]] = {}
    for row in first.collect():
        group = tuple(row[k] for k in keys)
        for i in range(len(names)):
            n, bracket = row[f"n_{i}"], row[f"q_{i}"]
            limits[(group, i)] = (row[f"min_{i}"], row[f"max_{i}"])
            targets[(group, i)] = [
                _Target(group, i, p, n, bracket[2 * j], bracket[2 * j + 1])
                for j, p in enumerate(probs)
                if n
            ]
    _narrow(base, targets, limits, len(names), len(probs), keys)
    found = _pick(base, targets, len(names), len(probs), keys)

    rows = []
    for (group, i), wanted in targets.items():
        q = [found[(group, i, j)] for j in range(len(wanted))] or [None] * len(probs)
        rows.append((*group, names[i], q))
    schema = base.select(*keys).schema.add("column", T.StringType()).add("q", _DOUBLES)
    return base.sparkSession.createDataFrame(rows, schema)


def _with_brackets(
    base: DataFrame, targets: dict[tuple, list[_Target]], width: int, depth: int, keys: list[str]
) -> DataFrame:
    """Attach lo_i / hi_i arrays: literals, or a broadcast row for each of few groups."""

    def bounds(group: tuple, i: int, side: str) -> list[float | None]:
        return [getattr(t, side) for t in targets[(group, i)]] or [None] * depth

    if not keys:
        literal = [
            _array(bounds((), i, s)).alias(f"{s}_{i}") if targets[((), i)] else
            F.lit(None).cast("array<double>").alias(f"{s}_{i}")
            for i in range(width) for s in ("low", "high")
        ]
        return base.select("*", *literal)
    groups = list(dict.fromkeys(g for g, _ in targets))
    schema = base.select(*keys).schema
    for i in range(width):
        schema = schema.add(f"low_{i}", _DOUBLES).add(f"high_{i}", _DOUBLES)
    rows = [(*g, *[bounds(g, i, s) for i in range(width) for s in ("low", "high")]) for g in groups]
    table = base.sparkSession.createDataFrame(rows, schema)
    table = table.select(*[F.col(k).alias(f"group_{k}") for k in keys], *schema.names[len(keys) :])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"group_{k}"))
    return base.join(F.broadcast(table), on).drop(*[f"group_{k}" for k in keys])


def _narrow(base, targets, limits, width: int, depth: int, keys: list[str]) -> None:
    """Shrink every bracket until it holds its ranks and few distinct values."""
    while True:
        ready = _with_brackets(base, targets, width, depth, keys)
        aggs = []
        for i in range(width):
            x = F.col(f"x_{i}")
            for j in range(depth):
                low, high = F.get(f"low_{i}", j), F.get(f"high_{i}", j)
                aggs += [
                    F.count_if(x < low).alias(f"below_{i}_{j}"),
                    F.count_if(x.between(low, high)).alias(f"in_{i}_{j}"),
                ]
        open_targets = set()
        for row in ready.groupBy(*keys).agg(*aggs).collect():
            group = tuple(row[k] for k in keys)
            for i in range(width):
                for j, t in enumerate(targets[(group, i)]):
                    tag = f"{i}_{j}"
                    if not t.check(row[f"below_{tag}"], row[f"in_{tag}"]):
                        open_targets.add((group, i, j))
        if not open_targets:
            return
        wanted = sorted({(i, j) for _, i, j in open_targets})
        sketches = {}
        for i, j in wanted:
            x = F.col(f"x_{i}")
            held = F.when(x.between(F.get(f"low_{i}", j), F.get(f"high_{i}", j)), x)
            sketches[f"{i}_{j}"] = held
        for row in sketched(ready, sketches, _GRID, keys).collect():
            group = tuple(row[k] for k in keys)
            for i, j in wanted:
                if (group, i, j) in open_targets:
                    t = targets[(group, i)][j]
                    t.narrow(limits[(group, i)], row[f"q_{i}_{j}"], row[f"d_{i}_{j}"])


def _pick(base, targets, width: int, depth: int, keys: list[str]) -> dict[tuple, float]:
    """Read the order statistics out of the bracketed values."""
    ready = _with_brackets(base, targets, width, depth, keys)
    hits, any_hit = [], F.lit(False)
    for i in range(width):
        x = F.col(f"x_{i}")
        for j in range(depth):
            held = x.between(F.get(f"low_{i}", j), F.get(f"high_{i}", j))
            any_hit = any_hit | F.coalesce(held, F.lit(False))
            hits.append(
                F.when(held, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x.alias("x")))
            )
    counts = (
        ready.where(any_hit)
        .select(*keys, F.inline(F.array_compact(F.array(*hits))))
        .groupBy(*keys, "i", "j", "x")
        .agg(F.count("*").alias("n"))
    )
    counts = _with_ranks(counts, base, targets, width, depth, keys)
    # each (group, i, j) holds at most MAX_INSIDE values
    running = F.sum("n").over(Window.partitionBy(*keys, "i", "j").orderBy("x"))
    picked = (
        counts.withColumn("cum", running)
        .groupBy(*keys, "i", "j")
        .agg(
            F.min(F.when(F.col("cum") > F.col("k0"), F.col("x"))).alias("v0"),
            F.min(F.when(F.col("cum") > F.col("k1"), F.col("x"))).alias("v1"),
        )
    )
    out = {}
    for row in picked.collect():
        group = tuple(row[k] for k in keys)
        t = targets[(group, row.i)][row.j]
        out[(group, row.i, row.j)] = row.v0 + (row.v1 - row.v0) * t.share
    return out


def _with_ranks(counts, base, targets, width: int, depth: int, keys: list[str]) -> DataFrame:
    """Attach k0, k1, the wanted ranks inside the bracket of each target."""
    if not keys:
        flat = [targets[((), i)] or [None] * depth for i in range(width)]
        at = F.col("i") * depth + F.col("j")
        for name in ("k0", "k1"):
            ranks = [F.lit(getattr(t, name) - t.below if t else None) for ts in flat for t in ts]
            counts = counts.withColumn(name, F.get(F.array(*ranks), at).cast("bigint"))
        return counts
    rows = [
        (*t.group, t.col, j, t.k0 - t.below, t.k1 - t.below)
        for ts in targets.values()
        for j, t in enumerate(ts)
    ]
    names = [f"key_{k}" for k in range(len(keys))]
    schema = base.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).schema
    schema = schema.add("ti", T.IntegerType()).add("tj", T.IntegerType())
    schema = schema.add("k0", T.LongType()).add("k1", T.LongType())
    table = base.sparkSession.createDataFrame(rows, schema)
    on = (F.col("i") == F.col("ti")) & (F.col("j") == F.col("tj"))
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    # groups × columns × quantiles rows
    return counts.join(F.broadcast(table), on).drop(*names, "ti", "tj")
