"""Bounded-space online packing of documents into token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.registry import documents, register, text_or_empty
from ledgerlens.llm.text_batches import releasing
from ledgerlens.llm.tokens import word_ids
from ledgerlens.session import materialise

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: No piece shorter than this is cut off to fill a window (documents may be shorter).
MIN_PIECE = 32
#: Partitions whose leftovers are merged together, so a merge has at most this many
#: times the open windows.
MERGED_PARTITIONS = 64

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "part int, window long, offset long, closed boolean"
)


class Packer:
    """Keeps ``space`` open windows; every call places one document and yields its pieces.

    A piece is ``(start, length, window, offset)``. Full-length pieces are windows of their
    own. The rest goes into the open window that it fills best; if it fits none, the
    fullest one is topped up with the front of it (unless less than MIN_PIECE tokens
    would be cut) and emitted.
    """

    def __init__(self, width: int, space: int):
        self.width, self.space = width, space
        self.used: dict[int, int] = {}
        self.next = 0

    def _open(self) -> int:
        self.next += 1
        self.used[self.next - 1] = 0
        return self.next - 1

    def place(self, tokens: int) -> Iterator[tuple[int, int, int, int]]:
        start = 0
        while tokens - start >= self.width:
            self.next += 1
            yield start, self.width, self.next - 1, 0
            start += self.width
        while start < tokens:
            rest = tokens - start
            fits = [w for w, used in self.used.items() if used + rest <= self.width]
            if fits or len(self.used) < self.space:
                window = max(fits, key=lambda w: (self.used[w], -w)) if fits else self._open()
                yield start, rest, window, self.used[window]
                self.used[window] += rest
                return
            window = max(self.used, key=lambda w: (self.used[w], -w))
            free = self.width - self.used[window]
            if free >= MIN_PIECE and rest - free >= MIN_PIECE:
                yield start, free, window, self.used[window]
                start += free
            del self.used[window]


def _pack_partition(path: str, width: int, space: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = word_ids(path), Packer(width, space)
        part = TaskContext.get().partitionId()
        end = END_ID.to_bytes(4, "little")
        held: list[tuple] = []
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = b"".join(map(ids_of.__getitem__, text.as_py().split())) + end
                n = len(ids) // 4
                for start, length, window, offset in packer.place(n):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    held.append((doc, start, length, crc, n, part, window, offset))
            # Windows that are open still may or may not be emitted later; only rows of
            # windows that are done leave the task, so what is held stays small.
            done = [row for row in held if row[6] not in packer.used]
            held = [row for row in held if row[6] in packer.used]
            yield _rows(done, True)
        yield _rows(held, False)

    return work


def _rows(rows: list[tuple], closed: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in PIECES.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([closed] * len(rows), pa.bool_())], names)


def _merge(width: int):
    def work(windows: pd.DataFrame) -> pd.DataFrame:
        """Best fit of the open windows of a group of partitions, fullest first."""
        windows = windows.sort_values(["used", "part", "window"], ascending=[False, True, True])
        free: list[int] = []
        made, shift = [], []
        for used in windows["used"]:
            fits = [k for k, x in enumerate(free) if x >= used]
            k = min(fits, key=lambda k: free[k]) if fits else len(free)
            if not fits:
                free.append(width)
            made.append(k)
            shift.append(width - free[k])
            free[k] -= used
        return windows.assign(merged=np.array(made, "int64"), shift=np.array(shift, "int64"))[
            ["part", "window", "grp", "merged", "shift"]
        ]

    return work


def pack_documents(
    df: DataFrame,
    width: int = 2048,
    space: int = 16,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each partition is packed as it is read, with ``space`` open windows and no shuffle
    (see :class:`Packer`); the windows still open at its end are merged with those of
    other partitions. A document's ids are those of its text and one end id, so a missing
    or empty text is one piece of one id. Rows without an id or with the same id are
    documents of their own. An empty table gives no rows; other columns play no part.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    pieces = materialise(rows.mapInArrow(releasing(_pack_partition(path, width, space)), PIECES))
    left = (
        pieces.filter(~F.col("closed")).groupBy("part", "window")
        .agg(F.sum("length").alias("used"))
        .withColumn("grp", F.floor(F.col("part") / MERGED_PARTITIONS))
    )
    merged = left.groupBy("grp").applyInPandas(
        _merge(width), "part int, window long, grp long, merged long, shift long"
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    number = lambda a, b, odd: F.shiftleft(a.cast("long"), 32) + b * 2 + odd
    whole = pieces.filter("closed").select(
        *columns, number(F.col("part"), F.col("window"), 0).alias("sequence_id"), "offset"
    )
    rest = pieces.filter(~F.col("closed")).join(merged, ["part", "window"]).select(
        *columns,
        number(F.col("grp"), F.col("merged"), 1).alias("sequence_id"),
        (F.col("offset") + F.col("shift")).alias("offset"),
    )
    return whole.unionByName(rest)


@register("op6_online_packing")
def op6(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir))
