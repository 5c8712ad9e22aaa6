"""Ordered tree, shared passes and the many-model k-means on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import tails
from ledgerlens.operators import kmeans, ordered, silhouettes
from ledgerlens.operators.clustering import analyse_clusters
from ledgerlens.operators.ordered import ordered_quantiles, ordered_sums
from ledgerlens.operators.two_sample import ks_two_sample, mann_whitney_u
from ledgerlens.plans.bundles import analyse_patterns, profile_bundle
from ledgerlens.plans.shared import SharedPasses
from ledgerlens.roles import Roles


def mixed_rows(n=1500, seed=3):
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "b", None, "a", "a"]), float(rng.choice([rng.randrange(40), rng.random() * 900, 7.0])), rng.randrange(5))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("size", "fanout"), [(1_000_000, 256), (400, 4), (20, 4), (3, 8)])
def test_ordered_sums_on_every_number_of_levels(spark, monkeypatch, size, fanout):
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", size)
    monkeypatch.setattr(ordered, "FANOUT", fanout)
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = {(r.g, r.x): (r.prev_x, r.w, r.cum_w, r.tot_w) for r in ordered_sums(df, F.col("v"), {"w": F.col("w")}, ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = [(v, w) for gg, v, w in rows if gg == g]
        upto, before = 0, None
        for x in sorted({v for v, _ in own}):
            here = sum(w for v, w in own if v == x)
            upto += here
            want[(g, x)] = (before, here, upto, sum(w for _, w in own))
            before = x
    assert got == want


def test_ordered_quantiles_through_the_tree(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", 10)
    monkeypatch.setattr(ordered, "FANOUT", 6)
    values = [r[1] for r in mixed_rows(800)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ordered_quantiles(df, F.col("v"), [0.1, 0.5, 0.9]).head().q
    assert got == pytest.approx(np.quantile(values, [0.1, 0.5, 0.9]))


def test_slots_of_many_points(spark):
    points = [float(k) for k in range(0, 200, 3)]
    chunks = [points[k : k + 16] for k in range(0, len(points), 16)]
    df = spark.createDataFrame([(x / 2,) for x in range(-3, 420)], "x double")
    table = F.struct(F.lit([c[0] for c in chunks]).alias("heads"), F.lit(chunks).alias("chunks"))
    for r in df.select("x", ordered._slot(table, F.col("x")).alias("slot")).collect():
        assert r.slot == sum(p <= r.x for p in points)


# -- k-means ------------------------------------------------------------------------


def places(n=90):
    rng = random.Random(4)
    return [(k % 3, 100.0 * (k % 3) + rng.random(), 50.0 * (k % 3 == 1) + rng.random()) for k in range(n)]


@pytest.mark.parametrize("coreset", [4_096, 30])
def test_kmeans_finds_places_from_a_coreset(spark, monkeypatch, coreset):
    monkeypatch.setattr(kmeans, "CORESET", coreset)
    monkeypatch.setattr(kmeans, "MERGED", 2)
    df = spark.createDataFrame(places(), "place int, V1 double, V2 double").repartition(5)
    found = analyse_clusters(df, ["V1", "V2"])
    assert found.optimal_k == 3
    pairs = {(r.place, r.cluster) for r in found.assigned.collect()}
    assert len(pairs) == 3
    x = np.array([p[1:] for p in places()])
    x = (x - x.mean(0)) / x.std(0)
    own = np.array([p[0] for p in places()])
    inertia = sum(((x[own == k] - x[own == k].mean(0)) ** 2).sum() for k in range(3))
    away = ((x[:, None] - x[None]) ** 2).sum(-1)
    scores = []
    for i, k in enumerate(own):
        a = away[i, own == k].sum() / ((own == k).sum() - 1)
        b = min(away[i, own == j].mean() for j in range(3) if j != k)
        scores.append((b - a) / max(a, b))
    row = found.summary.head()
    assert row.inertia == pytest.approx(inertia) and row.silhouette == pytest.approx(np.mean(scores))


def test_best_start_is_the_optimum_of_a_small_table(spark):
    x = [0.0, 0.2, 1.0, 1.3, 5.0, 5.1, 9.0, 9.4, 9.9, 14.0, 14.2, 20.0]
    df = spark.createDataFrame([(v, v) for v in x], "V1 double, V2 double")
    found = {r.k: r.inertia for r in analyse_clusters(df, ["V1", "V2"], max_k=4).curve.collect()}
    z = (np.array(x) - np.mean(x)) / np.std(x)
    for k, inertia in found.items():
        cuts = itertools.combinations(range(1, len(z)), k - 1)
        best = min(sum(2 * p.var() * len(p) for p in np.split(z, c)) for c in cuts)
        assert inertia == pytest.approx(best)


@pytest.mark.parametrize("merged", [3, 32])
def test_sums_of_many_tasks_reach_the_driver_once(spark, monkeypatch, merged):
    monkeypatch.setattr(kmeans, "MERGED", merged)
    rows = [(k % 5, [float(k), 1.0]) for k in range(70)]
    parts = spark.createDataFrame(rows, "slot int, sums array<double>").repartition(14)
    sent, collect = [], type(parts).collect

    def counted(df):
        sent.append(collect(df))
        return sent[-1]

    monkeypatch.setattr(type(parts), "collect", counted)
    total = kmeans._add_up(parts, (5, 2))
    assert [len(found) for found in sent] == [5]
    assert total.tolist() == [[float(sum(range(slot, 70, 5))), 14.0] for slot in range(5)]


def test_copies_and_constants_do_not_stop_kmeans(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 12, "V1 double, V2 double")
    found = analyse_clusters(df, ["V1", "V2"], max_k=3)
    assert all(r.inertia == 0 for r in found.curve.collect()) and found.assigned.count() == 12


# -- bundles ------------------------------------------------------------------------


def odd_table(spark, rows):
    schema = "Time double, Amount double, Class int, V1 double, V2 double, kind string, flag boolean, tags array<string>"
    return spark.createDataFrame(rows, schema)


def test_bundles_of_odd_tables(spark):
    nan, nothing = float("nan"), [None] * 8
    cases = [
        [], [nothing] * 3 + [(1.0, nan, 1, 2.0, 2.0, "x", True, ["a"])],
        [(5.0, 3.0, 7, 1.0, 1.0, None, None, None)] * 12,
    ]
    for rows in cases:
        df = odd_table(spark, rows)
        roles = Roles("Time", "Amount", "Class", ("V1", "V2"))
        profile = {k: t.collect() for k, t in profile_bundle(df, roles).items()}
        assert profile["file_info"][0].total_rows == len(rows)
        times = [r[0] for r in rows if r[0] is not None]
        assert {r["column"]: r["count"] for r in profile["numeric_statistics"]}["Time"] == len(times)
        missing = {r["column"]: r.missing_count for r in profile["missing_by_column"]}
        assert missing["tags"] == sum(r[7] is None for r in rows)
        assert missing["Amount"] == sum(r[1] is None or math.isnan(r[1]) for r in rows)
        patterns = {k: t.collect() for k, t in analyse_patterns(df, roles, n_init=1, max_k=3).items()}
        assert patterns["key_findings"]


def test_passes_run_once_for_both_bundles(spark, monkeypatch):
    df = odd_table(spark, [(float(k), float(k % 7), k % 2, float(k), float(-k), "x", True, []) for k in range(40)])
    roles = Roles("Time", "Amount", "Class")
    calls = []
    real = SharedPasses._long
    monkeypatch.setattr(SharedPasses, "_long", lambda self, *a, **k: calls.append(a) or real(self, *a, **k))
    passes = SharedPasses(df, roles)
    profile_bundle(df, roles, passes=passes)
    analyse_patterns(df, roles, passes=passes)
    assert len(calls) == 3  # facts, shape and order


# -- exact p values -----------------------------------------------------------------


@pytest.mark.parametrize(("n", "m"), [(3, 4), (5, 5), (2, 7), (1, 6), (4, 6)])
def test_exact_tails_equal_counting_all_orders(n, m):
    d_of, u_of = [], []
    for pick in itertools.combinations(range(n + m), n):
        a = b = d = u = 0
        for k in range(n + m):
            if k in pick:
                a, u = a + 1, u + b
            else:
                b += 1
            d = max(d, abs(a * m - b * n))
        d_of.append(d)
        u_of.append(u)
    for d in set(d_of):
        assert tails.lattice_tail(d / (n * m), n, m) == pytest.approx(sum(x >= d for x in d_of) / len(d_of))
    for u in set(u_of):
        high = max(u, n * m - u)
        want = min(1, 2 * sum(x >= high for x in u_of) / len(u_of))
        assert tails.counted_u_tail(u, n, m) == pytest.approx(want)


def test_tails_of_published_tables():
    # Critical values of the two-sample D and U tables, at most 5 % on two sides.
    for n, d in ((5, 5 / 5), (8, 6 / 8), (10, 7 / 10), (15, 8 / 15), (20, 9 / 20)):
        assert tails.lattice_tail(d, n, n) <= 0.05 < tails.lattice_tail(d - 1 / n, n, n)
    for n, m, u in ((4, 4, 0), (5, 5, 2), (6, 6, 5), (7, 7, 8), (8, 8, 13), (5, 8, 6)):
        assert tails.counted_u_tail(u, n, m) <= 0.05 < tails.counted_u_tail(u + 1, n, m)


def test_large_samples_go_over_smoothly(monkeypatch):
    exact = [tails.counted_u_tail(u, n, m) for n, m, u in ((8, 40_000, 250_000), (1, 3_000, 2_900), (4, 9_000, 30_000))]
    monkeypatch.setattr(tails, "COUNTED_U", 1)
    sums = [tails.counted_u_tail(u, n, m) for n, m, u in ((8, 40_000, 250_000), (1, 3_000, 2_900), (4, 9_000, 30_000))]
    assert sums == pytest.approx(exact, rel=2e-3)
    limit = tails.kolmogorov_tail(0.03 * math.sqrt(4_000 * 5_000 / 9_000))
    assert tails.lattice_tail(0.03, 4_000, 5_000) == pytest.approx(limit, rel=0.05)


def test_small_samples_have_exact_p(spark):
    rows = [(v, 1) for v in (1.0, 2.5, 9.0)] + [(float(v), 0) for v in (3, 4, 5, 6, 7)] + [(None, 1), (8.0, None)]
    df = spark.createDataFrame(rows, "x double, y int")
    d, u = ks_two_sample(df, ["x"], "y").head(), mann_whitney_u(df, ["x"], "y").head()
    assert d.p_value == pytest.approx(tails.lattice_tail(d.statistic, 3, 5))
    assert u.p_value == pytest.approx(tails.counted_u_tail(u.statistic, 3, 5))
    assert ks_two_sample(df, ["x"], "y", exact=False).head().p_value != pytest.approx(d.p_value)
    alone = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, y int")
    assert ks_two_sample(alone, ["x"], "y").head().p_value is None
    assert mann_whitney_u(alone, ["x"], "y").head().p_value is None


# -- silhouettes --------------------------------------------------------------------


def test_tiled_silhouettes_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(silhouettes, "BLOCK", 7)
    rng = random.Random(6)
    rows = [(k, k % 4, rng.random() + k % 4, rng.random()) for k in range(60)]
    rows += [(60, 9, 5.0, 5.0), (61, None, 7.0, 1.0), (62, None, 7.5, 1.0), (63, 1, None, 2.0), (64, 0, 0.5, 0.5), (65, 0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "id long, c int, a double, b double").repartition(3)
    whole = [r for r in rows if None not in r[2:]]
    x = np.array([r[2:] for r in whole])
    own = [r[1] for r in whole]
    square = ((x[:, None] - x[None]) ** 2).sum(-1)

    def scores(away, asked):
        out = {}
        for i, c in enumerate(own):
            if not asked(whole[i][0]):
                continue
            of = {k: [away[i, j] for j in range(len(own)) if own[j] == k] for k in set(own)}
            a = sum(of[c]) / max(len(of[c]) - 1, 1)
            b = min(sum(v) / len(v) for k, v in of.items() if k != c)
            out.setdefault(c, []).append((b - a) / max(a, b) if len(of[c]) > 1 else 0.0)
        return {c: (len(v), pytest.approx(float(np.mean(v)))) for c, v in out.items()}

    table = lambda found: {r.c: (r.rows, r.silhouette) for r in found.collect()}
    got = table(silhouettes.silhouette_euclidean(df, ["a", "b"], "c", F.col("id") % 3 == 0))
    assert got == scores(np.sqrt(square), lambda i: i % 3 == 0)
    want = scores(square, lambda i: True)
    assert table(silhouettes.silhouette_of_many_clusters(df, ["a", "b"], "c")) == want
    one = silhouettes.silhouette_euclidean(df.where("c = 1"), ["a", "b"], "c").head()
    assert one.silhouette == 0.0
    assert silhouettes.silhouette_euclidean(df.where("c = 77"), ["a", "b"], "c").collect() == []
