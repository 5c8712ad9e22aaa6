"""Many k-means models at once: every iteration of all of them is one scan.

Starting points come from a weighted coreset of a fixed expected size. Each task adds up
sums for every centre of every model that still moves; the sums of tasks are merged in a
tree to one, so the driver gets each sum of a scan once, however many rows or tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Expected rows of the coreset from which starting points are drawn.
CORESET = 4_096
#: Partial sums that one merging task adds up.
MERGED = 32
CORESET_ROUNDS = 100
#: Column of the standardised values, as an array.
VECTOR = "_standardised"


@dataclass
class Model:
    """Centres of one k and start, and what the last scan found with them."""

    centres: np.ndarray
    inertia: float = np.inf
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    means: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    squares: np.ndarray = field(default_factory=lambda: np.zeros(0))  # mean squared norms
    silhouette: float | None = None

    @property
    def k(self) -> int:
        return len(self.centres)


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    away = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    return np.maximum(away, 0.0)


def _sums(x: np.ndarray, w: np.ndarray, centres: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For every centre of every model (they begin at ``heads``): weight, inertia, squared
    norms and sums of its rows."""
    d = x.shape[1]
    out = np.zeros((len(centres), 3 + d))
    away, norms = _distances(x, centres), (x * x).sum(axis=1)
    for first, end in zip(heads, [*heads[1:], len(centres)], strict=True):
        own = away[:, first:end]
        nearest = own.argmin(axis=1)
        member = np.zeros_like(own)
        member[np.arange(len(x)), nearest] = w
        out[first:end, 0] = member.sum(axis=0)
        out[first:end, 1] = (member * own).sum(axis=0)
        out[first:end, 2] = member.T @ norms
        out[first:end, 3:] = member.T @ x
    return out


def _batch(totals: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(totals.reshape(-1))
    ends = pa.array(np.arange(len(totals) + 1, dtype=np.int32) * totals.shape[1])
    slots = pa.array(np.arange(len(totals), dtype=np.int32))
    return pa.RecordBatch.from_arrays([slots, pa.ListArray.from_arrays(ends, flat)], ["slot", "sums"])


def _add_up(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of (slot, sums) rows over all tasks, by a tree with ``MERGED`` tasks a node."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            np.add.at(total, batch.column(0).to_numpy(), _rows(batch.column(1), shape[1]))
        yield _batch(total)

    tasks = parts.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // MERGED)
        parts = parts.repartition(tasks).mapInArrow(merge, parts.schema)
    total = np.zeros(shape)
    for row in parts.collect():  # one sum of each slot
        total[row.slot] += row.sums
    return total


def _scan(data: DataFrame, models: Sequence[Model], d: int) -> None:
    """One pass: what every model finds with its centres."""
    centres = np.concatenate([m.centres for m in models])
    heads = np.cumsum([0, *(m.k for m in models)])[:-1]
    shared = data.sparkSession.sparkContext.broadcast((centres, heads))  # models × k × d numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, heads = shared.value
        total = np.zeros((len(centres), 3 + d))
        for batch in batches:
            x = _rows(batch.column(0), d)
            for first in range(0, len(x), 4_096):
                part = x[first : first + 4_096]
                total += _sums(part, np.ones(len(part)), centres, heads)
        yield _batch(total)

    parts = data.select(VECTOR).mapInArrow(work, "slot int, sums array<double>")
    _take(models, _add_up(parts, (len(centres), 3 + d)))
    shared.destroy()


def _take(models: Sequence[Model], total: np.ndarray) -> None:
    first = 0
    for m in models:
        own = total[first : first + m.k]
        first += m.k
        m.sizes, m.inertia = own[:, 0], float(own[:, 1].sum())
        filled = np.maximum(m.sizes, 1e-300)[:, None]
        # A centre without rows stays where it is.
        m.means = np.where(m.sizes[:, None] > 0, own[:, 3:] / filled, m.centres)
        m.squares = own[:, 2] / filled[:, 0]


def _moved(m: Model) -> float:
    shift = float(((m.means - m.centres) ** 2).sum())
    m.centres = m.means
    return shift


def _coreset(data: DataFrame, n: int, d: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and weights: each row is taken by its share of an even and of a distance-based
    draw, and weighs the inverse. All rows while there are no more than ``size``."""
    if n <= size:
        x = np.array([r[VECTOR] for r in data.select(VECTOR).toLocalIterator()])
        return x, np.ones(len(x))
    norm = F.aggregate(VECTOR, F.lit(0.0), lambda a, v: a + v * v)
    total = data.agg(F.sum(norm)).head()[0] or 0.0
    share = F.lit(0.5 / n) + (F.lit(0.5 / total) * norm if total else F.lit(0.5 / n))
    chance = F.least(F.lit(1.0), share * size)
    taken = data.select(VECTOR, chance.alias("chance")).where(F.rand(seed) < F.col("chance"))
    rows = taken.collect()  # `size` rows are expected
    return np.array([r[VECTOR] for r in rows]), np.array([1 / r.chance for r in rows])


def _starting_points(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++, the best of a few candidates for each next centre."""
    centres = x[[rng.choice(len(x), p=w / w.sum())]]
    nearest = _distances(x, centres)[:, 0]
    for _ in range(1, k):
        pull = w * nearest
        pull = pull / pull.sum() if pull.sum() > 0 else w / w.sum()
        tried = rng.choice(len(x), size=2 + int(np.log(k)), p=pull)
        left = np.minimum(nearest[:, None], _distances(x, x[tried]))
        best = int((w @ left).argmin())
        nearest = left[:, best]
        centres = np.vstack([centres, x[tried[best]]])
    return centres


def fit_many(
    data: DataFrame, ks: Sequence[int], n: int, d: int, n_init: int, seed: int,
    max_iter: int = 100, tol: float = 1e-4,
) -> dict[int, Model]:
    """The best of ``n_init`` starts for each k; ``data`` has standardised :data:`VECTOR`, is
    written or kept, and has ``n`` rows of ``d`` numbers.

    Models whose centres move less than ``tol`` leave the scans. A last scan gives the
    inertia, sizes and means of the chosen models.
    """
    x, w = _coreset(data, n, d, CORESET, seed)
    rng = np.random.default_rng(seed)
    models = []
    for k in ks:
        for _ in range(n_init):
            m = Model(_starting_points(x, w, k, rng))
            for _ in range(CORESET_ROUNDS):
                _take([m], _sums(x, w, m.centres, np.array([0])))
                if _moved(m) <= tol:
                    break
            models.append(m)
    moving = models
    for _ in range(max_iter):
        if not moving:
            break
        _scan(data, moving, d)
        moving = [m for m in moving if _moved(m) > tol]
    best = {k: min((m for m in models if m.k == k), key=lambda m: m.inertia) for k in ks}
    _scan(data, list(best.values()), d)
    return best


def add_silhouettes(data: DataFrame, models: Sequence[Model], d: int) -> None:
    """Mean silhouette of each model under squared Euclidean distance, all in one scan."""
    models = list(models)
    if not models:
        return
    shared = data.sparkSession.sparkContext.broadcast(
        [(m.centres, m.means, m.sizes, m.squares) for m in models]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 1))
        for batch in batches:
            x = _rows(batch.column(0), d)
            norms = (x * x).sum(axis=1)[:, None]
            for k, (centres, means, sizes, squares) in enumerate(shared.value):
                own = _distances(x, centres).argmin(axis=1)
                away = np.maximum(norms - 2 * x @ means.T + squares, 0.0)
                away[:, sizes == 0] = np.inf
                at = np.arange(len(x))
                a = away[at, own] * sizes[own] / np.maximum(sizes[own] - 1, 1)
                away[at, own] = np.inf
                b = away.min(axis=1)
                most = np.maximum(a, b)
                fine = (sizes[own] > 1) & np.isfinite(b) & (most > 0)
                total[k, 0] += np.where(fine, (b - a) / np.where(fine, most, 1.0), 0.0).sum()
        yield _batch(total)

    parts = data.select(VECTOR).mapInArrow(work, "slot int, sums array<double>")
    total = _add_up(parts, (len(models), 1))
    for m, score in zip(models, total[:, 0], strict=True):
        m.silhouette = float(score / max(m.sizes.sum(), 1)) if (m.sizes > 0).sum() > 1 else 0.0
    shared.destroy()


def with_cluster(data: DataFrame, model: Model, out: str = "cluster") -> DataFrame:
    """Every row with the number of its nearest centre, the first on a tie."""
    d = model.centres.shape[1]
    at = data.columns.index(VECTOR)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = _distances(_rows(batch.column(at), d), model.centres).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest.astype(np.int32))], names=[*batch.schema.names, out]
            )

    return data.mapInArrow(work, data.withColumn(out, F.lit(0)).schema)
