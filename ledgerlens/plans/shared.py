"""One set of passes over a table for all sections of its profile and its patterns.

Every section states what it needs of a pass; a pass runs once, when first needed, over all
columns and classes together, and gives a table whose size does not depend on the rows:

``facts``   moments, class moments and label co-moments of every column
``ranks``   quantiles of every column, and of time and amount for each class
``mads``    median distance from the median
``shape``   histogram counts and outlier counts, by the thresholds of the passes before
``order``   running class counts over the distinct times and amounts: gaps and rank tests
``cycles``  rows by hour and day
``values``  counted values of the categorical columns
``unique``  distinct values of the others
``pairs``   co-moments of pairs of columns
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlens.functions.stats import long_form
from ledgerlens.operators import correlation, outliers, profile
from ledgerlens.operators.histogram import bin_index
from ledgerlens.operators.ordered import ordered_sums
from ledgerlens.operators.quantiles import MAX_DISTINCT, quantile_values
from ledgerlens.operators.temporal import DAY, HOUR, gap_stats_of
from ledgerlens.operators.two_sample import ks_of, mann_whitney_of, t_test_of
from ledgerlens.roles import Roles, as_double, categorical_cols, numeric_cols
from ledgerlens.session import materialise

PROBS = (0.01, 0.05, 0.10, 0.25, 0.5, 0.75, 0.90, 0.95, 0.99)
OVER = (1000, 5000, 10000)
_AT = {p: i for i, p in enumerate(PROBS)}
_DESCRIBED = ("count", "mean", "std", "min", "max", "skewness", "kurtosis")


def _class_name(column: str, label: int) -> str:
    return f"{column}\0{label}"


def _moments(n: int, mean: float, m2: float, m3: float, m4: float) -> dict[str, float | None]:
    """Corrected deviation, skewness and kurtosis from central sums."""
    out = {"std": math.sqrt(m2 / (n - 1)) if n >= 2 else None, "spread": math.sqrt(m2 / n) if n else None}
    out |= {"skewness": None, "kurtosis": None}
    if n >= 3 and m2 > 0:
        out["skewness"] = math.sqrt(n) * m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2)
    if n >= 4 and m2 > 0:
        out["kurtosis"] = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / m2**2 - 3) + 6)
    return out | {"mean": mean if n else None}


def _central(p: dict) -> tuple:
    """Rows, mean and central sums of one part; a constant part has no shape."""
    n, mean, m2 = p["count"], p["mean"] or 0.0, p["count"] * (p["var"] or 0.0)
    if not n or not m2 or p["skewness"] is None:
        return n, mean, m2, 0.0, 0.0
    return n, mean, m2, p["skewness"] * m2**1.5 / math.sqrt(n), (p["kurtosis"] + 3) * m2**2 / n


def _merged(parts: dict[int, dict]) -> Row:
    """Facts of a column from those of its classes: 1, 0 and all other labels."""
    some = list(parts.values())
    add = lambda k: sum(p[k] or 0 for p in some)
    out = {k: add(k) for k in ("rows", "count", "none", "distinct", *(f"over_{t}" for t in OVER))}
    out["rate"] = add("sum_y") / add("labelled") if add("labelled") else None
    sums = [_central(p) for p in some if p["count"]]
    n = sum(p[0] for p in sums)
    mean = sum(p[0] * p[1] for p in sums) / n if n else 0.0
    total = [0.0, 0.0, 0.0]
    for m, at, m2, m3, m4 in sums:  # moved to the common mean
        d = at - mean
        total[0] += m2 + m * d * d
        total[1] += m3 + 3 * d * m2 + m * d**3
        total[2] += m4 + 4 * d * m3 + 6 * d * d * m2 + m * d**4
    out |= _moments(n, mean, *total)
    for f, k in ((min, "min"), (max, "max")):
        out[k] = f((p[k] for p in some if p[k] is not None), default=None)
    # Co-moments with the label, over rows that have both.
    both = [p for p in some if p["both"]]
    m = sum(p["both"] for p in both)
    centre = {k: sum(p["both"] * p[f"mean_{k}"] for p in both) / m if m else 0.0 for k in "xy"}
    moved = lambda p, k: p[f"mean_{k}"] - centre[k]
    out["covariance"] = sum(p["both"] * (p["cov"] + moved(p, "x") * moved(p, "y")) for p in both) / m if m else None
    for k in "xy":
        square = sum(p["both"] * (p[f"var_{k}"] + moved(p, k) ** 2) for p in both)
        out[f"spread_{k}"] = math.sqrt(square / m) if m else None
    for k, name in ((1, "ones"), (0, "zeros")):
        p = parts.get(k) or {"rows": 0, "count": 0, "none": 0, "min": None, "max": None, "mean": None}
        out[name] = p["rows"]
        out |= {f"{f}{k}": v for f, v in _moments(*(_central(p) if p["count"] else (0, 0.0, 0.0, 0.0, 0.0))).items()}
        out |= {f"{f}{k}": p[f] for f in ("count", "min", "max", "none", "mean")}
    return Row(*out)(*out.values())


class SharedPasses:
    """The passes over ``df``; wrap it in ``shared_input`` to read its source once."""

    def __init__(self, df: DataFrame, roles: Roles, bins: int = 20, exclude: Sequence[str] = ()):
        self.df, self.roles, self.bins = df, roles, bins
        self.spark = df.sparkSession
        self.cols = numeric_cols(df, exclude)
        needed = [roles.time, roles.amount, *roles.features]
        self.all = [*self.cols, *dict.fromkeys(c for c in needed if c and c not in self.cols)]
        self.flat = categorical_cols(df)
        self.y = as_double(df, roles.label) if roles.label else F.lit(None).cast("double")

    # -- passes -------------------------------------------------------------------------

    @cached_property
    def facts(self) -> dict[str, Row]:
        """One pass grouped by column and class: everything about a column that adds up."""
        x, y = F.col("x"), F.col("y")
        makers = {
            "rows": F.count(F.lit(1)), "labelled": F.count(y), "sum_y": F.sum(y),
            "count": F.count(x), "mean": F.avg(x), "var": F.var_pop(x), "min": F.min(x), "max": F.max(x),
            "skewness": F.skewness(x), "kurtosis": F.kurtosis(x), "none": F.count_if(x == 0),
            **{f"over_{k}": F.count_if(x > k) for k in OVER},
            "both": F.count(x + y), "mean_x": F.avg(F.when(y.isNotNull(), x)), "mean_y": F.avg(F.when(x.isNotNull(), y)),
            "cov": F.covar_pop(x, y), "var_x": F.var_pop(F.when(y.isNotNull(), x)), "var_y": F.var_pop(F.when(x.isNotNull(), y)),
            "distinct": F.approx_count_distinct(x),
        }
        kind = F.when(y == 1, 1).when(y == 0, 0).otherwise(2).alias("kind")
        pairs = self._long(self.all, keep_null=True)
        found = pairs.groupBy("column", kind).agg(*[e.alias(k) for k, e in makers.items()])
        parts = defaultdict(dict)
        for r in found.collect():  # three rows per column
            parts[r["column"]][r.kind] = r.asDict()
        return {c: _merged(parts[c]) for c in self.all}

    @cached_property
    def totals(self) -> Row:
        """Rows and class counts, which every column's facts carry."""
        if self.all:
            return next(iter(self.facts.values()))
        y = self.y
        return self.df.agg(
            F.count("*").alias("rows"), F.count_if(y == 1).alias("ones"), F.count_if(y == 0).alias("zeros"), F.avg(y).alias("rate")
        ).head()

    @cached_property
    def ranks(self) -> dict[str, list[float | None]]:
        exprs = {c: as_double(self.df, c) for c in self.all}
        if self.roles.label:
            for c in (self.roles.time, self.roles.amount):
                for k in (1, 0) if c else ():
                    exprs[_class_name(c, k)] = F.when(self.y == k, exprs[c])
        return quantile_values(self.df, exprs, PROBS, picked=self._methods(exprs))

    def _methods(self, names) -> dict[str, str]:
        many = {c for c, f in self.facts.items() if f.distinct > MAX_DISTINCT}
        return {n: "select" if n.split("\0")[0] in many else "builtin" for n in names}

    @cached_property
    def mads(self) -> dict[str, float | None]:
        away = {
            c: F.abs(as_double(self.df, c) - F.lit(self.rank(c, 0.5)))
            for c in self.cols if self.rank(c, 0.5) is not None
        }
        if not away:
            return {}
        found = quantile_values(self.df, away, (0.5,), picked=self._methods(away))
        return {c: q[0] for c, q in found.items()}

    @cached_property
    def bounds(self) -> dict[str, outliers.Bounds]:
        out = {}
        for c in self.cols:
            q1, q3 = self.rank(c, 0.25), self.rank(c, 0.75)
            width = outliers.FENCE * (q3 - q1) if q1 is not None else None
            out[c] = outliers.Bounds(
                lower=None if width is None else q1 - width, upper=None if width is None else q3 + width,
                mean=self.facts[c].mean, std=self.facts[c].spread or None,
                median=self.rank(c, 0.5), mad=self.mads.get(c) or None,
            )
        return out

    @cached_property
    def shape(self) -> dict[str, list[Row]]:
        """Rows of every bin of every column, with the outliers among them."""
        names = [c for c in self.cols if self.facts[c]["count"]]
        if not names:
            return {}
        x, y = F.col("x"), F.col("y")
        at = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column")).cast("int") - 1

        def of(values) -> Column:
            numbers = [F.lit(None if v is None else float(v)).cast("double") for v in values]
            return F.get(F.array(*numbers), F.col("at"))

        edges = [self.edges(c) for c in names]
        place = bin_index(x, of(e[0] for e in edges), of(e[1] for e in edges), self.bins)
        b = [self.bounds[c] for c in names]
        z = F.abs(F.try_divide(x - of(v.mean for v in b), of(v.std for v in b)))
        m = F.try_divide(F.lit(outliers.MAD_SCALE) * (x - of(v.median for v in b)), of(v.mad for v in b))
        fenced = F.coalesce((x < of(v.lower for v in b)) | (x > of(v.upper for v in b)), F.lit(False))
        rows = self._long(names).withColumn("at", at).select(
            "column", "y", place.alias("bin"), fenced.alias("fenced"), z.alias("z"),
            (F.abs(m) > outliers.MODIFIED_Z_LIMIT).alias("modified"),
        )
        held = F.when(F.col("fenced"), F.col("y"))
        found = rows.groupBy("column", "bin").agg(
            F.count("*").alias("n"), F.count_if("fenced").alias("fenced"),
            F.count_if(F.col("z") > outliers.Z_LIMIT).alias("far"), F.max("z").alias("most"),
            F.sum("z").alias("sum_z"), F.count("z").alias("with_z"),
            F.count_if("modified").alias("modified"), F.sum(held).alias("sum_y"), F.count(held).alias("with_y"),
        )
        out = defaultdict(list)
        for r in found.collect():  # columns × bins
            out[r["column"]].append(r)
        return dict(out)

    @cached_property
    def order(self) -> DataFrame:
        """Running counts over the distinct times and, with a label, amounts."""
        roles = self.roles
        names = [c for c in (roles.time, roles.amount if roles.label else None) if c]
        y = F.col("y")
        ones, zeros = F.when(y == 1, 1).otherwise(0), F.when(y == 0, 1).otherwise(0)
        sums = {"rows": F.lit(1), "c1": ones, "c0": zeros}
        return materialise(ordered_sums(self._long(names), F.col("x"), sums, ["column"]))

    @cached_property
    def cycles(self) -> list[Row]:
        t = as_double(self.df, self.roles.time)
        hour = F.floor(F.pmod(t, F.lit(float(DAY))) / HOUR).cast("int")
        day = F.floor(F.pmod(t / DAY, F.lit(7.0))).cast("int")
        rows = self.df.where(t.isNotNull()).groupBy(hour.alias("hour"), day.alias("day"))
        return rows.agg(F.count("*").alias("n")).collect()  # 168 rows

    @cached_property
    def values(self) -> DataFrame:
        return materialise(profile.value_table(self.df, self.flat))

    @cached_property
    def unique(self) -> list[Row]:
        """(column, unique_values) of every column."""
        rest = [c for c in self.df.columns if c not in self.flat]
        found = profile.distinct_counts(self.df, rest).collect() if rest else []
        if not self.flat:
            return found
        counted = dict(self.values.groupBy("column").agg(F.count("*")).collect())
        kind = Row("column", "unique_values")
        return [*found, *(kind(c, counted.get(c, 0)) for c in self.flat)]

    @cached_property
    def pairs(self) -> DataFrame:
        return materialise(correlation.correlation_pairs(self.df, self.cols))

    # -- what sections read -------------------------------------------------------------

    def _long(self, names: Sequence[str], keep_null: bool = False) -> DataFrame:
        base = self.df.withColumn("\0y", self.y)
        exprs = {c: as_double(self.df, c) for c in names}
        return long_form(base, exprs, ["\0y"], keep_null).withColumnRenamed("\0y", "y")

    def local(self, rows: Sequence[tuple], schema: str) -> DataFrame:
        """A table of a few rows; as an Arrow table it becomes part of the plan."""
        kind = T.StructType.fromDDL(schema)
        fields = to_arrow_schema(kind)
        columns = list(zip(*rows, strict=True)) or [()] * len(kind)
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)]
        return self.spark.createDataFrame(pa.Table.from_arrays(arrays, names=kind.names), kind)

    def rank(self, column: str, prob: float, label: int | None = None) -> float | None:
        name = column if label is None else _class_name(column, label)
        return self.ranks[name][_AT[prob]]

    def edges(self, column: str) -> tuple[float, float]:
        low, high = self.facts[column].min, self.facts[column].max
        return (low - 0.5, high + 0.5) if low == high else (low, high)

    def share(self, part: float | None, whole: float | None) -> float | None:
        return 100.0 * part / whole if whole and part is not None else None

    # -- sections of the profile --------------------------------------------------------

    def file_info(self) -> DataFrame:
        rows, names = self.totals.rows, self.df.columns
        size = rows * len(names) * 8 / (1024.0 * 1024.0)
        schema = "total_rows long, total_columns int, columns array<string>, estimated_size_mb double"
        return self.local([(rows, len(names), names, size)], schema)

    def data_types(self) -> DataFrame:
        unique = self.local([tuple(r) for r in self.unique], "column string, unique_values long")
        return profile.column_types_of(self.df, self.df.columns, unique, self.totals.rows)

    def numeric_statistics(self) -> DataFrame:
        schema = "column string, count long, mean double, std double, min double, max double, skewness double, kurtosis double, q1 double, median double, q3 double"
        return self.local(
            [(c, *(self.facts[c][k] for k in _DESCRIBED), *(self.rank(c, p) for p in (0.25, 0.5, 0.75))) for c in self.cols],
            schema,
        )

    def percentiles(self) -> DataFrame:
        names = ", ".join(f"p{round(p * 100):d} double" for p in profile.PERCENTILES)
        rows = [(c, *(self.rank(c, p) for p in profile.PERCENTILES)) for c in self.cols]
        return self.local(rows, f"column string, {names}")

    def histograms(self) -> DataFrame:
        rows = []
        for c, found in self.shape.items():
            low, high = self.edges(c)
            n, step = self.facts[c]["count"], (high - low) / self.bins
            counts = {r.bin: r.n for r in found}
            for b in range(self.bins):
                left = b * step + low
                right = high if b == self.bins - 1 else (b + 1) * step + low
                held = counts.get(b, 0)
                rows.append((c, b, left, right, (left + right) / 2, held, held / (n * step)))
        schema = "column string, bin int, left double, right double, center double, count long, density double"
        return self.local(rows, schema)

    def missing(self) -> list[tuple[str, int]]:
        """(column, missing cells) of every column, in order."""
        rows = self.totals.rows
        known = {c: f["count"] for c, f in self.facts.items()}
        if self.flat:
            known |= {c: 0 for c in self.flat}
            known |= dict(self.values.groupBy("column").agg(F.sum("count")).collect())
        rest = [c for c in self.df.columns if c not in known]
        if rest:
            known |= self.df.agg(*[F.count(c).alias(c) for c in rest]).head().asDict()
        return [(c, rows - known[c]) for c in self.df.columns]

    def missing_sections(self) -> dict[str, DataFrame]:
        rows, cells = self.totals.rows, self.missing()
        total = sum(m for _, m in cells)
        summary = (total, self.share(total, rows * len(cells)), [c for c, m in cells if m])
        return {
            "missing_by_column": self.local(
                [(c, m, self.share(m, rows)) for c, m in cells],
                "column string, missing_count long, missing_percentage double",
            ),
            "missing_summary": self.local(
                [summary],
                "total_missing_values long, percentage_of_total_values double, columns_with_missing array<string>",
            ),
        }

    def amount_flags(self) -> DataFrame:
        f = self.facts[self.roles.amount]
        over = [f[f"over_{k}"] for k in OVER]
        schema = "zero_count long, zero_percentage double, " + ", ".join(f"over_{k} long" for k in OVER)
        return self.local([(f.none, self.share(f.none, f.rows), *over)], schema)

    def balance(self) -> DataFrame:
        t = self.totals
        return self.local([(t.rows, t.ones, t.zeros)], "total long, positive_count long, negative_count long")

    def by_class(self, column: str) -> DataFrame:
        f = self.facts[column]
        rows = [
            (k, column, f[f"count{k}"], f[f"mean{k}"], f[f"std{k}"], f[f"min{k}"],
             *(self.rank(column, p, k) for p in (0.25, 0.5, 0.75)), f[f"max{k}"], f[f"skewness{k}"], f[f"kurtosis{k}"])
            for k in (0, 1) if (f.ones if k else f.zeros)
        ]
        label = self.roles.label
        return self.local(
            rows, f"`{label}` int, column string, count long, mean double, std double, min double, q1 double, "
            "median double, q3 double, max double, skewness double, kurtosis double",
        )

    def zero_amounts(self) -> DataFrame:
        f, label = self.facts[self.roles.amount], self.roles.label
        rows = [(k, f[f"none{k}"], self.share(f[f"none{k}"], n)) for k, n in ((0, f.zeros), (1, f.ones)) if n]
        return self.local(rows, f"`{label}` int, zero_count long, zero_percentage double")

    def diagonal(self) -> DataFrame:
        rows = [(c, c, 1.0 if (self.facts[c].spread or 0) > 0 else None) for c in self.cols]
        return self.local(rows, "var1 string, var2 string, r double")

    # -- sections of the patterns -------------------------------------------------------

    def gaps(self) -> DataFrame:
        times = self.order.where(F.col("column") == self.roles.time)
        gap = F.col("x") - F.col("prev_x")
        return gap_stats_of(times.select(F.col("x").alias("time"), "rows", gap.alias("gap")))

    def duration(self) -> DataFrame:
        f = self.facts[self.roles.time]
        span = f.max - f.min if f["count"] else None
        cut = lambda by: None if span is None else span / by
        return self.local(
            [(span, cut(HOUR), cut(DAY), f.mean, self.rank(self.roles.time, 0.5))],
            "duration_seconds double, duration_hours double, duration_days double, mean_time double, median_time double",
        )

    def cycle(self, name: str, size: int) -> DataFrame:
        counts = defaultdict(int)
        for r in self.cycles:
            counts[r[name]] += r.n
        f = self.facts[self.roles.time]
        empty = name == "day" and not (f["count"] and f.max - f.min > 7 * DAY)
        rows = [] if empty else [(k, counts[k]) for k in range(size)]
        return self.local(rows, f"{name} int, count long")

    @cached_property
    def tests(self) -> tuple[DataFrame, DataFrame]:
        """Kolmogorov–Smirnov and Mann–Whitney rows of the ordered columns, written."""
        return materialise(ks_of(self.order)), materialise(mann_whitney_of(self.order))

    def test_of(self, which: int, column: str) -> DataFrame:
        return self.tests[which].where(F.col("column") == column)

    def time_by_class(self) -> DataFrame:
        t = self.roles.time
        f = self.facts[t]
        some = lambda k, v: v if (f.ones if k else f.zeros) else None
        row = [(t, *(some(k, f[f"mean{k}"]) for k in (1, 0)), *(some(k, self.rank(t, 0.5, k)) for k in (1, 0)))]
        names = ["positive_mean_time", "negative_mean_time", "positive_median_time", "negative_median_time"]
        means = self.local(row, "test_column string, " + ", ".join(f"{n} double" for n in names))
        test = self.test_of(0, t)
        return means.join(test, F.col("test_column") == F.col("column"), "left").select(
            *names, "statistic", "p_value", "significant"
        )

    def outlier_sections(self) -> dict[str, DataFrame]:
        iqr, far, modified, rates = [], [], [], []
        per = []
        for i, c in enumerate(self.cols):
            found, b, n = self.shape.get(c, []), self.bounds[c], self.facts[c]["count"]
            add = lambda k, found=found: sum(r[k] or 0 for r in found)
            fenced, distant = add("fenced"), add("far")
            iqr.append((c, fenced, self.share(fenced, n), b.lower, b.upper))
            with_z = add("with_z")
            most = max((r.most for r in found if r.most is not None), default=None)
            far.append((c, distant, self.share(distant, n), most, add("sum_z") / with_z if with_z else None))
            if b.mad:
                modified.append((c, add("modified"), self.share(add("modified"), n), b.median, b.mad))
            rate = add("sum_y") / add("with_y") if add("with_y") else 0.0
            overall = self.totals.rate
            rates.append((c, overall, rate, None if overall is None else rate > overall))
            if n:
                per.append((fenced, -i, c, distant))
        best = max(per, default=(None, None, None, None))
        total = [sum(x[k] for x in per) if per else None for k in (0, 3)]
        counted = "column string, outlier_count long, outlier_percentage double"
        out = {
            "outliers_iqr": self.local(iqr, f"{counted}, lower_bound double, upper_bound double"),
            "outliers_zscore": self.local(far, f"{counted}, max_zscore double, mean_zscore double"),
            "outliers_modified_zscore": self.local(modified, f"{counted}, median double, mad double"),
            "outlier_summary": self.local(
                [(*total, len(per), best[2])],
                "total_outliers_iqr long, total_outliers_zscore long, columns_analyzed long, most_outliers_column string",
            ),
        }
        if self.roles.label:
            out["outlier_label_rate"] = self.local(
                rates, "column string, overall_rate double, outlier_rate double, more_likely boolean"
            )
        return out

    def target(self) -> DataFrame:
        """(variable, r) of every other column with the label."""
        rows = []
        for c in self.cols:
            if c != self.roles.label:
                f = self.facts[c]
                spread = (f.spread_x or 0.0) * (f.spread_y or 0.0)
                rows.append((c, f.covariance / spread if spread else None))
        return self.local(rows, "variable string, r double")

    def feature_tests(self) -> DataFrame:
        rows = []
        for c in self.roles.features:
            f = self.facts[c]
            if f.count1 or f.count0:
                square = lambda s: None if s is None else s * s
                rows.append((c, *(v for k in (1, 0) for v in (float(f[f"count{k}"]), f[f"mean{k}"], square(f[f"std{k}"])))))
        table = self.local(rows, "column string, n1 double, m1 double, v1 double, n0 double, m0 double, v0 double")
        return t_test_of(table, self.roles.features)
