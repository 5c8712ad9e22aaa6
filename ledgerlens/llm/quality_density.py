"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import words as W
from ledgerlens.llm.registry import documents, join_keys, register, table
from ledgerlens.session import materialise

#: Share of the pooled covariance in each class covariance, and the least share of the
#: spherical target (more is taken where a class has few rows for its dimensions).
POOLED, LEAST_SPHERE = 0.6, 0.02
#: Variance of the sphere at least, in units of the pooled variance.
LEAST_VARIANCE = 0.01
#: Held-out rows: the remainder of crc32(doc_id) by FOLDS that the model does not learn from.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Label tables up to this many rows (16 bytes each) are broadcast, larger ones are shuffled.
BROADCAST_LABELS = 500_000

MARKS = {
    "symbols": W.byte_class("#*$%&|<>=_~^\\{}[]@+"),
    "bars": W.byte_class("|"),
    "shouts": W.byte_class("!"),
    "stops": W.byte_class(".!?,;:"),
    "digits": W.byte_class("0123456789"),
    "upper": W.byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": W.byte_class("abcdefghijklmnopqrstuvwxyz"),
}
STATISTICS = (
    "words", "word_length", "word_spread", "line_words", "symbols", "bars", "shouts", "stops",
    "digits", "upper", "repeated_lines", "repeated_windows", "distinct_words", "common_word",
    "noisy_words", "shouted_words", "stopped_lines", "longest_word",
)
D = len(STATISTICS)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Angle of a share: its variance hardly depends on the share."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, D): transformed statistics of whole texts; missing texts are empty."""
    parts = [np.zeros((0, D))]
    for first, end, data, bounds in W.slices(column):
        n = end - first
        count = lambda rows, weights=None, n=n: np.bincount(rows, weights, minlength=n)
        starts, ends, rows = W.split_words(data, bounds)
        spans = W.Spans(data)
        hashes = spans.hash(starts, ends)
        row_key = W.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        sums = {k: W.totals(t[data]) for k, t in MARKS.items()}
        of_row = {k: s[bounds[1:]] - s[bounds[:-1]] for k, s in sums.items()}
        of_word = {k: s[ends] - s[starts] for k, s in sums.items()}
        chars = W.totals((data & 0xC0) != 0x80)
        length = chars[ends] - chars[starts]
        n_words = count(rows)
        n_chars = count(rows, length)
        mean = n_chars / np.maximum(n_words, 1)
        spread = np.sqrt(np.maximum(0, count(rows, length**2.0) / np.maximum(n_words, 1) - mean**2))
        longest = np.zeros(n)
        np.maximum.at(longest, rows, length)

        window, window_row = W.shingles(hashes, rows, 3)
        again, _ = W.repeated(window ^ row_key[window_row])
        keyed = hashes ^ row_key[rows]
        order = np.argsort(keyed, kind="stable")
        keyed = keyed[order]
        new = np.ones(len(keyed), bool)  # the first of equal words
        new[1:] = keyed[1:] != keyed[:-1]
        heads = np.flatnonzero(new)
        runs = np.diff(np.append(heads, len(keyed)))
        top = np.zeros(n)
        np.maximum.at(top, rows[order][heads], runs)

        line_start, line_end, line_row = W.split_lines(data, bounds)
        word_line = np.searchsorted(line_start, starts, "right") - 1
        line_words = np.bincount(word_line, minlength=len(line_start))
        solid = line_words > 0
        line_hash = spans.hash(line_start[solid], line_end[solid])
        _, later = W.repeated(line_hash ^ row_key[line_row[solid]])
        lines = count(line_row[solid])
        last_word = np.cumsum(line_words)[solid] - 1  # of each line
        final = data[ends[last_word] - 1]
        stopped = W.byte_class(".!?:;\"')")[final] | (final >= 0x80)

        letters = of_row["upper"] + of_row["lower"]
        noisy = of_word["symbols"] > 0
        shouted = (of_word["upper"] >= 2) & (of_word["lower"] == 0)
        parts.append(
            np.stack(
                [
                    np.log1p(n_words), np.log1p(mean), np.log1p(spread),
                    np.log1p(n_words / np.maximum(lines, 1)),
                    *(_share(of_row[k], n_chars) for k in ("symbols", "bars", "shouts", "stops", "digits")),
                    _share(of_row["upper"], letters),
                    _share(count(line_row[solid][later]), lines),
                    _share(count(window_row[again]), count(window_row)),
                    np.log1p(count(rows[order][heads])) / np.log1p(np.maximum(n_words, 1)),
                    _share(top, n_words), _share(count(rows[noisy]), n_words),
                    _share(count(rows[shouted]), n_words),
                    _share(count(line_row[solid][stopped]), lines), np.log1p(longest),
                ],
                axis=1,
            )
        )
    return np.concatenate(parts)


# -- the model ----------------------------------------------------------------------


def _sphere_share(cov: np.ndarray, n: float) -> float:
    """Oracle-approximating share of the spherical target, from the covariance and its rows."""
    d = len(cov)
    trace, square = float(np.trace(cov)), float((cov * cov).sum())
    over = (n + 1 - 2 / d) * (square - trace**2 / d)
    return 1.0 if over <= 0 else min(1.0, ((1 - 2 / d) * square + trace**2) / over)


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, and what follows from them."""

    centre: np.ndarray
    scale: np.ndarray
    prior: tuple[float, float]
    means: list[np.ndarray] = field(default_factory=list)
    whiten: list[np.ndarray] = field(default_factory=list)
    log_det: list[float] = field(default_factory=list)

    def density_gap(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, by Mahalanobis distances."""
        if not self.means:
            return np.zeros(len(x))
        z = (x - self.centre) / self.scale
        logs = []
        for mean, whiten, log_det in zip(self.means, self.whiten, self.log_det, strict=True):
            y = (z - mean) @ whiten.T
            logs.append(-0.5 * (y * y).sum(axis=1) - log_det)
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        odds = self.density_gap(x) + math.log(self.prior[1] / self.prior[0])
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def discriminant(
    n: np.ndarray, sums: np.ndarray, products: np.ndarray,
    pooled: float = POOLED, least_sphere: float = LEAST_SPHERE,
) -> Discriminant:
    """Model from each class's row count, sums and sums of products of the statistics.

    A class covariance is shrunk towards the pooled one by ``pooled`` and then towards a
    sphere, by the share that suits its row count but ``least_sphere`` at least; statistics
    are in units of their pooled deviation. Without rows of both classes only the share of
    class 1 is known, with one row more of each.
    """
    prior = ((n[0] + 1) / (n.sum() + 2), (n[1] + 1) / (n.sum() + 2))
    model = Discriminant(np.zeros(D), np.ones(D), prior)
    if not n.all():
        return model
    means = sums / n[:, None]
    covs = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
    within = (covs * n[:, None, None]).sum(axis=0) / n.sum()
    model.centre = sums.sum(axis=0) / n.sum()
    spread = np.sqrt(np.maximum(np.diag(within), 0))
    model.scale = np.where(spread > 1e-6, spread, 1.0)  # a constant statistic stays as it is
    unit = np.outer(model.scale, model.scale)
    for k in (0, 1):
        cov = (1 - pooled) * covs[k] / unit + pooled * within / unit
        sphere = max(least_sphere, _sphere_share(cov, n[k]))
        cov = (1 - sphere) * cov + sphere * max(np.trace(cov) / D, LEAST_VARIANCE) * np.eye(D)
        factor = np.linalg.cholesky(cov)
        model.means.append((means[k] - model.centre) / model.scale)
        model.whiten.append(np.linalg.inv(factor))
        model.log_det.append(float(np.log(np.diag(factor)).sum()))
    return model


# -- on tables ----------------------------------------------------------------------


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, stats`` of every row, from whole texts, without a shuffle.

    A missing id is held out. The table is written, as the fit and the scores both read it;
    it has about 150 bytes a document.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = statistics(batch.column(2))
            flat = pa.array(made.reshape(-1))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * D), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), stats], ["doc_id", "held_out", "stats"]
            )

    rows = df.select(F.col(id_col).alias("doc_id"), _held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    return materialise(rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, stats array<double>"))


def _held_out(id_col: str) -> Column:
    shown = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(shown) % FOLDS == HELD_OUT


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """The model of all labelled rows of ``stats`` that are not held out.

    ``labels`` has ``doc_id, quality``. Labels other than 0 and 1 are ignored, and so is an
    id with both; a label given twice counts once. Every task adds up its rows, and sums of
    a fixed number come to the driver.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")
    )
    known = known.where("quality = most").select("doc_id", "quality")
    rows = join_keys(stats.where("not held_out"), known, ["doc_id"], "inner", BROADCAST_LABELS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + D + D * D))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            label = batch.column(0).to_numpy()
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(total.tolist())], ["quality", "sums"])

    partial = rows.select("quality", "stats").mapInArrow(sums, "quality long, sums array<double>")
    partial = partial.select("quality", F.posexplode("sums").alias("place", "x"))
    total = np.zeros((2, 1 + D + D * D))
    for row in partial.groupBy("quality", "place").agg(F.sum("x").alias("x")).collect():
        total[row.quality, row.place] = row.x
    products = total[:, 1 + D :].reshape(2, D, D)
    return discriminant(total[:, 0], total[:, 1 : 1 + D], products)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


def quality_scores(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    ``score`` is the probability that a text has label 1, from its statistics alone. Missing
    and empty texts have the statistics of no word and a score like any other. Rows with the
    same id or text have rows of their own; an empty table gives none, and other columns,
    whatever their names, play no part. Without labels of both classes all scores are the
    share of class 1, with one row more of each.
    """
    stats = with_statistics(df, id_col, text_col)
    model = fit(stats, labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return stats.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")


@register("op13_quality_density")
def op13(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return quality_scores(documents(spark, sf_dir), labels)
