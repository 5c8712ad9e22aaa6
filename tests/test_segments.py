"""Segment sections and frequent values on small tables with a hot segment."""

import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.operators import lookup, profile
from ledgerlens.plans.segments import segment_outliers, segment_pairs, segment_sections


def hot_rows():
    rng = random.Random(2)
    rows = [("hot" if k % 3 else rng.choice(["a", None, "b"]), rng.gauss(0, 1), rng.random()) for k in range(300)]
    rows += [("hot", 30.0, 0.5), ("a", -40.0, None), ("flat", 2.0, 1.0), ("flat", 2.0, 3.0), (None, 9.0, float("nan"))]
    return rows + [("void", None, None)]


def expected(x):
    q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    mad, spread = np.median(np.abs(x - med)), x.std()
    fenced = ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
    z = np.abs(x - x.mean()) / spread if spread else None
    modified = (np.abs(0.6745 * (x - med) / mad) > 3.5).sum() if mad else None
    return len(x), fenced, None if z is None else (z > 3).sum(), modified


@pytest.mark.parametrize("few", [0, 1_000])
def test_outliers_of_segments(spark, monkeypatch, few):
    monkeypatch.setattr(lookup, "FEW_GROUPS", few)
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {r.g: r for r in segment_outliers(df, ["g"], ["x"], method="builtin").collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        x = np.array([v for s, v, _ in rows if s == g and v is not None])
        if not len(x):
            assert (r.rows, r.outliers_iqr, r.outliers_zscore, r.max_zscore, r.outliers_modified_z) == (0, 0, 0, None, None)
            continue
        n, fenced, far, modified = expected(x)
        assert (r.rows, r.outliers_iqr, r.outliers_zscore, r.outliers_modified_z) == (n, fenced, far or 0, modified)


def test_pairs_of_segments(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {r.g: (r.n, r.r) for r in segment_pairs(df, ["g"], ["x", "y"]).collect()}
    for g in {r[0] for r in rows}:
        both = np.array([(a, b) for s, a, b in rows if s == g and a is not None and b is not None and b == b])
        n, r = got[g]
        assert n == len(both)
        if g in ("flat", "void"):
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(both.T)[0, 1])


def test_sections_of_segments(spark):
    df = spark.createDataFrame(hot_rows(), "g string, x double, y double")
    found = segment_sections(df, ["g"], ["x", "y"], bins=4, method="builtin")
    counts = Counter()
    for r in found["histogram"].where("column = 'x'").collect():
        counts[r.g] += r["count"]
    assert counts == Counter(s for s, x, _ in hot_rows() if x is not None)
    assert found["percentiles"].count() == 2 * 6 and found["summary"].count() == 2 * 6
    empty = segment_sections(df.where("g = 'nobody'"), ["g"], ["x", "y"], method="builtin")
    assert all(t.collect() == [] for t in empty.values())


@pytest.mark.parametrize("tracked", [8, 1_000])
def test_frequent_values_are_certain_or_say_so(spark, tracked):
    rng = random.Random(7)
    values = ["top"] * 400 + ["second"] * 300 + [f"v{rng.randrange(500)}" for _ in range(300)] + [None] * 20
    rng.shuffle(values)
    df = spark.createDataFrame([(v, "one") for v in values], "a string, b string").repartition(6)
    got = [r for r in profile.frequent_values(df, 5, ["a", "b"], tracked).collect() if r["column"] == "a"]
    exact = sorted(Counter(v for v in values if v).items(), key=lambda p: (-p[1], p[0]))
    for r in got:
        assert r["count"] == dict(exact)[r.value]
        if r.certain:
            assert exact[r.rank - 1] == (r.value, r["count"])
    if tracked == 1_000:
        assert [(r.value, r["count"]) for r in sorted(got, key=lambda r: r.rank)] == exact[:5]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [None, "x"])
def test_thresholds_of_many_groups_are_not_broadcast(spark, monkeypatch, hot):
    monkeypatch.setattr(lookup, "FEW_GROUPS", 3)
    few = [(f"g{k % 40}" if k % 40 else None, k) for k in range(160)]
    rows = spark.createDataFrame(few + [(hot, -k) for k in range(1, 300)], "g string, v long").repartition(6)
    names = {g for g, _ in few} | {hot}
    table = spark.createDataFrame([(g, f"t{g}") for g in names], "k string, t string")
    found = lookup.hot_groups(rows, ["g"])
    assert [r.g for r in found.collect()] == [hot]
    joined = lookup.lookup_join(rows, table, [("g", "k")], found)
    assert sorted((str(r.g), r.v, r.t) for r in joined.collect()) == sorted((str(r.g), r.v, f"t{r.g}") for r in rows.collect())
    assert "SortMergeJoin" in _plan(joined)
    even = spark.createDataFrame([(f"g{1 + k % 39}", k) for k in range(160)], "g string, v long")
    plain = lookup.lookup_join(even, table, [("g", "k")], lookup.hot_groups(even, ["g"]))
    assert plain.count() == 160
    # Neither side is collected at the driver, and no group is copied for every salt.
    assert "Broadcast" not in _plan(plain) and "Generate" not in _plan(plain)
