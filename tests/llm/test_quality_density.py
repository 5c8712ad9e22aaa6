import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from ledgerlens.llm import quality_density
from ledgerlens.llm.quality_density import D, STATISTICS, discriminant, quality_scores, statistics
from tests.llm.common import odd_rows, prose, table


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def plain(text):
    """The statistics of one text, the slow way."""
    text = text or ""
    angle = lambda part, whole: math.asin(math.sqrt(min(1, part / max(whole, 1))))
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    sizes = [len(w) for w in words]
    n, chars = len(words), sum(sizes)
    mean = chars / max(n, 1)
    has = lambda cls: len(re.findall(cls, text))
    windows = [tuple(words[k : k + 3]) for k in range(n - 2)]
    counts = {w: words.count(w) for w in set(words)}
    ends = [re.findall(r"[^\x20\x09-\x0d]+", x)[-1][-1] for x in lines]
    symbol, upper = r"[#*$%&|<>=_~^\\{}\[\]@+]", r"[A-Z]"
    return [
        math.log1p(n), math.log1p(mean),
        math.log1p(math.sqrt(max(0, sum(s * s for s in sizes) / max(n, 1) - mean**2))),
        math.log1p(n / max(len(lines), 1)),
        angle(has(symbol), chars), angle(has(r"\|"), chars), angle(has("!"), chars),
        angle(has("[.!?,;:]"), chars), angle(has("[0-9]"), chars),
        angle(has(upper), has("[A-Za-z]")),
        angle(sum(x in lines[:k] for k, x in enumerate(lines)), len(lines)),
        angle(sum(windows.count(w) > 1 for w in windows), len(windows)),
        math.log1p(len(counts)) / math.log1p(max(n, 1)),
        angle(max(counts.values(), default=0), n),
        angle(sum(bool(re.search(symbol, w)) for w in words), n),
        angle(sum(len(re.findall(upper, w)) >= 2 and not re.search("[a-z]", w) for w in words), n),
        angle(sum(e in ".!?:;\"')" or ord(e) > 127 for e in ends), len(lines)),
        math.log1p(max(sizes, default=0)),
    ]


TEXTS = [
    None, "", " \n\t ", "x", "ONE TWO!! three | four\n\nONE TWO!! three | four", "#### $$ %%",
    "É à 多語。\nplain words, again; and again; and again.", prose(3), prose(4) + "\n" + prose(4), "a" * 3_000,
]


def test_statistics_equal_plain_ones():
    got = statistics(pa.chunked_array([pa.array(TEXTS)]).combine_chunks())
    assert got.shape == (len(TEXTS), D) == (len(TEXTS), len(STATISTICS))
    np.testing.assert_allclose(got, [plain(t) for t in TEXTS], atol=1e-9)


def test_density_gap_is_that_of_two_normal_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(50, D)) + k for k in (0, 1)]
    n = np.array([50.0, 50.0])
    sums, products = np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x])
    model = discriminant(n, sums, products)
    z = (rng.normal(size=(7, D)) - model.centre) / model.scale
    logs = []
    for mean, whiten in zip(model.means, model.whiten, strict=True):
        cov = np.linalg.inv(whiten.T @ whiten)
        gap = z - mean
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    np.testing.assert_allclose(model.density_gap(z * model.scale + model.centre), logs[1] - logs[0], rtol=1e-8)


def test_few_rows_and_constant_statistics_are_no_trouble():
    ones = np.ones((3, D))
    model = discriminant(np.array([1.0, 3.0]), np.stack([np.zeros(D), ones.sum(0)]), np.stack([np.zeros((D, D)), ones.T @ ones]))
    assert np.isfinite(model.score(np.zeros((1, D)))).all()


def junk(seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "|", "win###"]) for _ in range(80))


def labelled(spark):
    rows = [(k, junk(k) if k % 3 == 0 else prose(k, 60 + k % 50)) for k in range(1, 400)]
    labels = [(k, int(k % 3 > 0), 0) for k in range(1, 400)] + [(3, 0, 0), (6, 1, 0), (9, None, 0), (12, 7, 0), (None, 1, 0)]
    return rows, labels


def scores(spark, rows, labels, **options):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return quality_scores(table(spark, rows), known, **options).collect()


def test_scores_on_held_out_rows(spark, monkeypatch):
    rows, labels = labelled(spark)
    rows += [(1000 + k if i is not None else None, t) for k, (i, t) in enumerate(odd_rows())]
    got = scores(spark, rows, labels)
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out and r.doc_id and r.doc_id < 1000]
    assert len(out) > 50 and all(r.predicted == (r.doc_id % 3 > 0) for r in out)
    # The model is that of the plain formulas over the same rows.
    said = {}
    for i, quality, _ in labels:
        if quality in (0, 1):
            said.setdefault(i, set()).add(quality)
    use = [(plain(t), min(said[i])) for i, t in rows if not held(i) and len(said.get(i, ())) == 1]
    x = [np.array([s for s, q in use if q == k]) for k in (0, 1)]
    model = discriminant(
        np.array([float(len(v)) for v in x]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x])
    )
    want = sorted(model.score(np.array([plain(t) for _, t in rows])))
    np.testing.assert_allclose(sorted(r.score for r in got), want, atol=1e-6)
    monkeypatch.setattr(quality_density, "BROADCAST_LABELS", 0)
    again = scores(spark, rows, labels)
    np.testing.assert_allclose(sorted(r.score for r in again), want, atol=1e-6)


def test_without_both_classes_scores_are_the_share(spark):
    assert [r.score for r in scores(spark, [(1, prose(1)), (2, None)], [])] == [0.5, 0.5]
    learnt = [k for k in range(1, 30) if not held(k)][:4]
    got = scores(spark, [(k, prose(k)) for k in learnt], [(k, 1, 0) for k in learnt])
    assert {r.score for r in got} == {5 / 6}


def test_empty_table(spark):
    assert scores(spark, [], [(1, 1, 0)]) == []
