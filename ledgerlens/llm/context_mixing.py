"""Language-model scores: online logistic context mixing, beside a unigram base."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import mixing as M
from ledgerlens.llm import words as W
from ledgerlens.llm.registry import documents, register, text_or_empty
from ledgerlens.session import materialise, scratch_path

#: Bytes of text whose grams are found at once.
GRAM_BYTES = 2 << 20
#: Bytes of text of a block, whose distinct grams are sent once, and of texts to a bucket.
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
#: Log2 probabilities go back to the texts in steps of one by GRAIN.
GRAIN = 512
#: Distinct entries that a task gathers before it sends them on.
HELD = 3_000_000
#: The end of a text as a token: no hash of a word is excluded, but none is likely to be it.
END_WORD = np.uint64(0x6C6F2D7465787421)
#: The block number of rows with counts of short items, which no block has.
SHORT = -1


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order; the order of all, and where each distinct one begins in
    it. The keys come in sorted runs, which a stable sort merges."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], order, first


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    distinct, order, first = _places(keys)
    return distinct, np.add.reduceat(counts[order], first)


class Counter:
    """Sums counts by key for a task, in bounded memory."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([*self.keys, np.zeros(0, np.uint64)])
        counts = np.concatenate([*self.counts, np.zeros(0, np.int64)])
        self.__init__()
        return _summed(keys, counts)

def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all tokens: the lower-cased words, and an end for each row."""
    data = W.FOLD[data]
    starts, ends, rows = W.split_words(data, bounds)
    n = len(bounds) - 1
    words = np.concatenate([W.Spans(data).hash(starts, ends), np.full(n, END_WORD)])
    return words, np.concatenate([rows, np.arange(n)])


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """The rows with a ``block`` number: consecutive ones of about ``size`` bytes of text.

    The numbers depend on how rows are dealt to tasks, so the table is written at once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) for x in batch.column(2)], np.int64)
            number = (filled + np.cumsum(sizes) - sizes) // size
            filled += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(block + number), *batch.columns], ["block", "doc_id", "trains", "t"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    path = scratch_path(rows.sparkSession, "blocks")
    rows = rows.select("doc_id", "trains", "t")
    made = rows.mapInArrow(work, f"block long, doc_id {kind}, trains boolean, t string")
    made.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on, compressed: what is
    sorted or small takes little room like this."""
    return zlib.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = zlib.decompress(raw)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _all_planes(column: pa.Array | pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [_from_planes(x.as_buffer(), kind) for x in column]


def _block_items(n_buckets: int, of_grams: bool):
    """One row per bucket of a block: its distinct grams (turned), or tokens, and their
    counts in training texts. With the tokens go the counts of the short items, in rows of
    the block SHORT."""

    def rows_of(block: int, held: Counter) -> pa.RecordBatch:
        grams, n = held.sums()
        if of_grams:
            bucket = M.buckets(M.turned_back(grams), n_buckets)
        else:
            bucket = ((M.mix(grams) if block == SHORT else grams) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, grams, n = bucket[order], grams[order], n[order].astype(np.int32)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[cuts[:-1]]),
                pa.array(np.full(len(parts), block)),
                pa.array([_planes(grams[x]) for x in parts], pa.binary()),
                pa.array([_planes(n[x]) for x in parts], pa.binary()),
            ],
            ["bucket", "block", "grams", "n"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, short = None, Counter(), Counter()
        for batch in batches:
            blocks, trains = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.diff(blocks)) + 1
            for at, end in zip([0, *change], [*change, len(blocks)], strict=True):
                if block != blocks[at] and held.size:
                    yield rows_of(block, held)
                block = int(blocks[at])
                for first, last, data, bounds in W.slices(batch.column(2)[at:end], GRAM_BYTES):
                    grams, row = M.grams_of(data, bounds) if of_grams else _tokens(data, bounds)
                    grams = M.turned(grams) if of_grams else grams
                    learnt = trains[at + first : at + last][row]
                    held.add(*np.unique(grams[learnt], return_counts=True))
                    others = np.unique(grams[~learnt])
                    held.add(others, np.zeros(len(others), np.int64))
                    if held.size > HELD:
                        held.add(*held.sums())
                    if not of_grams:
                        items, row = M.short_of(data, bounds)
                        items = items[trains[at + first : at + last][row]].astype(np.uint32)
                        items, n = np.unique(items, return_counts=True)
                        short.add(items.astype(np.uint64), n)
                        if short.size > HELD:
                            short.add(*short.sums())
        if held.size:
            yield rows_of(block, held)
        if short.size:
            yield rows_of(SHORT, short)

    return work


def gram_scores(
    blocks: DataFrame, items: np.ndarray, counts: np.ndarray, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``block, items, values``: log2 probabilities of the distinct grams of every block, as
    whole steps of one by GRAIN below nothing.

    Every gram of every text reaches the bucket that has all counts of its contexts, so the
    counts are those of the whole corpus and their table grows with it: the number of
    buckets is that of the bytes. Counts of the two shortest contexts (``items``, at most
    2**24 whatever the corpus) are sent to all buckets.
    """
    size = blocks.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    placed = blocks.select("block", "trains", "t").mapInArrow(
        _block_items(max(8, -(-size // bucket_bytes)), True), "bucket long, block long, grams binary, n binary"
    )
    shared = blocks.sparkSession.sparkContext.broadcast((items, counts.astype(np.float64)))

    def score(table: pa.Table) -> pa.Table:
        parts = _all_planes(table["grams"], np.uint64)
        ends = np.cumsum([len(x) for x in parts])
        keys, order, first = _places(np.concatenate(parts))
        del parts
        n = np.concatenate(_all_planes(table["n"], np.int32)).astype(np.float64)
        n, grams = np.add.reduceat(n[order], first), M.turned_back(keys)
        by_gram = np.argsort(grams)
        value = np.empty(len(grams), np.int32)
        value[by_gram] = np.round(M.log2_of(grams[by_gram], n[by_gram], *shared.value) * -GRAIN)
        steps = np.empty(len(order), np.int32)
        steps[order] = np.repeat(value, np.diff(np.append(first, len(order))))
        scores = [_planes(x) for x in np.split(steps, ends[:-1])]
        return pa.table(
            {"block": table["block"], "items": table["grams"], "values": pa.array(scores, pa.binary())}
        )

    return placed.groupBy("bucket").applyInArrow(score, "block long, items binary, values binary")


def token_counts(
    blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES
) -> tuple[DataFrame, int, int, np.ndarray, np.ndarray]:
    """``block, items, values``: how often the distinct tokens of every block occur in all
    training texts; N and V; and the short items, sorted, with their counts in training
    texts. A token leaves a block once."""
    size = blocks.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    posted = blocks.select("block", "trains", "t").mapInArrow(
        _block_items(max(8, -(-size // bucket_bytes)), False),
        "bucket long, block long, grams binary, n binary",
    )

    names = ["block", "items", "values", "total", "distinct"]

    def count(table: pa.Table) -> pa.Table:
        own = pc.equal(table["block"], SHORT)
        short, table = table.filter(own), table.filter(pc.invert(own))
        held, rows = Counter(), []
        for chunk in short.to_batches():
            for at in range(chunk.num_rows):
                held.add(*(
                    _from_planes(chunk[name][at].as_buffer(), kind).astype(into)
                    for name, kind, into in (("grams", np.uint64, np.uint64), ("n", np.int32, np.int64))
                ))
                if held.size > HELD:
                    held.add(*held.sums())
        if held.size:
            rows.append([[SHORT], *([_planes(x)] for x in held.sums()), [0], [0]])
        if table.num_rows:
            parts = _all_planes(table["grams"], np.uint64)
            items, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            c = np.bincount(inverse, np.concatenate(_all_planes(table["n"], np.int32)), minlength=len(items))
            values = np.split(c.astype(np.int64)[inverse], np.cumsum([len(x) for x in parts])[:-1])
            first = np.arange(len(parts)) == 0  # one row of a bucket has its sums
            rows.append([
                table["block"].to_pylist(), table["grams"].to_pylist(), [_planes(x) for x in values],
                first * int(c.sum()), first * int((c > 0).sum()),
            ])
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        tables = [
            pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names) for columns in rows
        ]
        return pa.concat_tables(tables)

    counted = materialise(posted.groupBy("bucket").applyInArrow(
        count, "block long, items binary, values binary, total long, distinct long"
    ))
    total, distinct = counted.agg(F.sum("total"), F.sum("distinct")).first()
    short = counted.filter(F.col("block") == SHORT).select("items", "values").toArrow()
    items = np.concatenate([*_all_planes(short["items"], np.uint64), np.zeros(0, np.uint64)])
    counts = np.concatenate([*_all_planes(short["values"], np.int64), np.zeros(0, np.int64)])
    answers = counted.filter(F.col("block") != SHORT).select("block", "items", "values")
    return answers, total or 0, distinct or 0, *_summed(items, counts)


def all_scores(rows: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, trains, n_tokens, n_known, train_tokens, base_score, n_bytes, score`` (log10)
    for rows of ``doc_id, trains, t``; those that train are learnt from, all are scored."""
    blocks = in_blocks(rows, block_bytes)
    tokens, total, distinct, items, counts = token_counts(blocks)
    norm = float(np.log10(total + 0.5 * (distinct + 1)))

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        def known(kind: str, items: type, values: type) -> M.Lookup:
            mine = answers.filter(pc.equal(answers["kind"], kind))
            found = np.concatenate([*_all_planes(mine["items"], items), np.zeros(0, items)])
            return M.Lookup(
                M.turned_back(found) if kind == "gram" else found,
                np.concatenate([*_all_planes(mine["values"], values), np.zeros(0, values)]),
            )

        by_gram, by_token = known("gram", np.uint64, np.int32), known("token", np.uint64, np.int64)
        made = {name: [] for name in ("n_tokens", "n_known", "base_score", "n_bytes", "score")}
        for chunk in texts["t"].chunks:
            for first, end, data, bounds in W.slices(chunk, GRAM_BYTES):
                n = end - first
                words, row = _tokens(data, bounds)
                c, size = by_token.of(words), np.bincount(row, minlength=n)
                made["n_tokens"].append(size)
                made["n_known"].append(np.bincount(row[c > 0], minlength=n))
                made["base_score"].append(np.bincount(row, np.log10(c + 0.5), minlength=n) - size * norm)
                grams, row = M.grams_of(data, bounds)
                made["n_bytes"].append(np.bincount(row, minlength=n))
                steps = np.bincount(row, by_gram.of(grams), minlength=n)
                made["score"].append((0.0 - steps / GRAIN) * np.log10(2))
        return pa.table(
            {"doc_id": texts["doc_id"], "trains": texts["trains"]}
            | {name: np.concatenate(x) for name, x in made.items()}
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    answers = gram_scores(blocks, items, counts, bucket_bytes).withColumn("kind", F.lit("gram"))
    answers = answers.unionByName(tokens.withColumn("kind", F.lit("token")))
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish,
        f"doc_id {kind}, trains boolean, n_tokens long, n_known long, base_score double, "
        "n_bytes long, score double",
    )
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def mixing_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte``.

    Tokens are the lower-cased (A-Z) words and one end. Rows whose ``crc32`` of the id as
    text leaves another remainder than 1 by 5 are learnt from. ``base_score`` is the
    smoothed unigram sum, ``score`` the model's log10 probability of the token sequence
    (words, one space between them, an end), from the first byte to the end.

    The model: for each byte, eight bits; each bit is predicted from the counts of all
    training texts for contexts of one to five bytes and for the word so far, by hash. A
    mixer adds the stretched predictions with weights that the bucket of contexts, the bit
    and a gate (what was seen) choose; the weights are learnt online, gram by gram, and
    what comes out is refined by an adaptive table. The counts grow with the corpus.

    A missing or empty text is the end alone. A missing id counts as an empty text for the
    checksum, so such rows are learnt from. Rows that repeat id and text have the same
    result each; an empty table gives no rows. Words go by 64-bit hashes.
    """
    text = text_or_empty(text_col)
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).alias("doc_id"), (F.crc32(id_text) % 5 != 1).alias("trains"), text.alias("t")
    )
    return all_scores(rows).select(
        "doc_id",
        (~F.col("trains")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        (-F.col("score") / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


@register("op1_context_mixing")
def op1(spark, sf_dir):
    return mixing_scores(documents(spark, sf_dir))
