"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import words as W
from ledgerlens.llm.registry import documents, register, text_or_empty
from ledgerlens.llm.tokens import WordIds, word_ids

VOCABULARY = "word_bpe_49k.json"
#: Bytes that the rolling hash sees; a chunk ends where its low MASK_BITS are zero.
ROLLING, MASK_BITS = 32, 9
MIN_CHUNK, MAX_CHUNK = 128, 4096
#: Shared chunks that are encoded once and handed to every task: those that save most. It
#: bounds the broadcast to DICTIONARY * MAX_CHUNK bytes of text and its ids; what is not in
#: it is encoded where it occurs, so results do not depend on it.
DICTIONARY = 8_192

#: Tokens of a batch of results, and words that a worker remembers.
OUT_TOKENS, MEMO_WORDS = 500_000, 400_000

_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def chunk_ends(data: np.ndarray, bounds: np.ndarray, spans: W.Spans) -> list[list[int]]:
    """Ends of the chunks of each row, from content alone except for the size limits."""
    n = len(data)
    places = np.arange(min(ROLLING, n), n + 1)
    rolling = spans.hash(places - ROLLING, places) if n >= ROLLING else np.zeros(0, np.uint64)
    cuts = places[(rolling & np.uint64((1 << MASK_BITS) - 1)) == 0] if n >= ROLLING else places[:0]
    first = np.searchsorted(cuts, bounds, "right")
    out = []
    for row in range(len(bounds) - 1):
        start, end, ends = int(bounds[row]), int(bounds[row + 1]), []
        # A window that reaches back into another row says nothing about this one.
        for cut in cuts[first[row] : first[row + 1]].tolist():
            if cut - int(bounds[row]) < ROLLING or cut - start < MIN_CHUNK or cut >= end:
                continue
            while cut - start > MAX_CHUNK:
                start += MAX_CHUNK
                ends.append(start)
            if cut - start >= MIN_CHUNK:
                ends.append(cut)
                start = cut
        while end - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if end > start:
            ends.append(end)
        out.append(ends)
    return out


def chunks_of(column: pa.Array) -> Iterator[list[bytes]]:
    """The chunks of each row; nulls have none."""
    for first, end, data, bounds in W.slices(column):
        raw = data.tobytes()
        for row, ends in enumerate(chunk_ends(data, bounds, W.Spans(data))):
            starts = [int(bounds[row]), *ends[:-1]] if ends else []
            yield [raw[s:e] for s, e in zip(starts, ends, strict=True)]


def chunk_key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


@dataclass(slots=True)
class Encoded:
    """A chunk's words: ids of those inside it, and its two cut-off ends as bytes.

    ``first`` and ``last`` are the words next to the ends, for the check of a repair.
    Without any white space the chunk is one ``solid`` run.
    """

    head: bytes
    tail: bytes
    ids: bytes
    first: bytes
    last: bytes
    solid: bool

    @classmethod
    def of(cls, chunk: bytes, ids_of: WordIds) -> Encoded:
        words = chunk.split()
        solid = bool(words) and len(words) == 1 and len(words[0]) == len(chunk)
        head = words.pop(0) if words and chunk[0] not in _SPACE else b""
        tail = words.pop() if words and chunk[-1] not in _SPACE else b""
        ids = b"".join(map(ids_of.__getitem__, words))
        return cls(head, tail, ids, *((words[0], words[-1]) if words else (b"", b"")), solid)


class Disagreement(Exception):
    """A repaired word and its neighbours give other ids together than alone."""


def repaired(before: bytes, cut: bytes, after: bytes, ids_of: WordIds) -> bytes:
    """Ids of a word that a chunk end cut, by re-encoding a window around it.

    The window is the word and its neighbours. If the neighbours come out with the ids
    that their chunks have, both sides agree from there on and the middle is right.
    """
    left, right = (ids_of[w] if w else b"" for w in (before, after))
    ids = ids_of[cut]
    window = b" ".join(w for w in (before, cut, after) if w)
    if ids_of.encode(window.decode()) != left + ids + right:
        raise Disagreement
    return ids


def encode_chunks(chunks: list[bytes], known: dict[bytes, Encoded], ids_of: WordIds) -> bytes:
    """Ids of the text that the chunks make up, 32 bits each."""
    out: list[bytes] = []
    held, before, joined = b"", b"", False  # a word that the last chunk did not end
    for chunk in chunks:
        made = known.get(chunk) or Encoded.of(chunk, ids_of)
        if made.solid:
            joined = joined or bool(held)
            held += chunk
            continue
        cut = held + made.head
        if cut:
            if (held and made.head) or joined:
                out.append(repaired(before, cut, made.first, ids_of))
            else:
                out.append(ids_of[cut])
        out.append(made.ids)
        held, joined = made.tail, False
        before = made.last
    if held:
        out.append(repaired(before, held, b"", ids_of) if joined else ids_of[held])
    return b"".join(out)


def shared_chunks(rows: DataFrame, limit: int) -> DataFrame:
    """``key, holder`` of at most ``limit`` chunks that occur more than once, by bytes
    saved; the holder is the ``doc_id`` of a row that has the chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[bytes, int]] = Counter()
            holder: dict[tuple[bytes, int], int] = {}
            for row, chunks in enumerate(chunks_of(batch.column(1))):
                for chunk in chunks:
                    key = chunk_key(chunk), len(chunk)
                    seen[key] += 1
                    holder.setdefault(key, row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in seen], pa.binary()), pa.array([n for _, n in seen], pa.int64()),
                 pa.array(list(seen.values()), pa.int64()),
                 batch.column(0).take(pa.array([holder[key] for key in seen], pa.int64()))],
                ["key", "size", "n", "holder"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"key binary, size long, n long, holder {id_type}")
    total = counted.groupBy("key", "size").agg(F.sum("n").alias("n"), F.min("holder").alias("holder"))
    saved = ((F.col("n") - 1) * F.col("size")).desc()
    return total.filter("n > 1").orderBy(saved, "key").limit(limit).select("key", "holder")


def encoded_once(rows: DataFrame, chosen: pa.Table, path: str) -> dict[bytes, Encoded]:
    """The chosen chunks (see :func:`shared_chunks`), each encoded once.

    Only the rows of their holders are cut again: a missing id holds what no other has.
    """
    keys = set(chosen["key"].to_pylist())
    names = ["head", "tail", "ids", "first", "last", "solid"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for chunks in chunks_of(batch.column(0)):
                for chunk in chunks:
                    key = chunk_key(chunk)
                    if key in keys and key not in sent:
                        sent.add(key)
                        found[key] = chunk
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())],
                ["key", "chunk"],
            )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path, MEMO_WORDS)
        for batch in batches:
            made = [astuple(Encoded.of(chunk, ids_of)) for chunk in batch.column(0).to_pylist()]
            fields = zip(*made, strict=True) if made else [[]] * len(names)
            types = [pa.bool_() if name == "solid" else pa.binary() for name in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(x), t) for x, t in zip(fields, types, strict=True))],
                ["chunk", *names],
            )

    schema = rows.select(F.col("doc_id").alias("holder")).schema
    holders = rows.sparkSession.createDataFrame(chosen.select(["holder"]), schema).distinct()
    held = rows.join(F.broadcast(holders), rows["doc_id"].eqNullSafe(holders["holder"]), "left_semi")
    texts = held.select("t").mapInArrow(pick, "key binary, chunk binary").dropDuplicates(["key"])
    made = texts.select("chunk").mapInArrow(
        encode, ", ".join(f"{x} binary" for x in ["chunk", *names[:-1]]) + ", solid boolean"
    )
    table = made.toArrow()  # at most DICTIONARY rows
    fields = zip(*(table[name].to_pylist() for name in names), strict=True)
    return dict(zip(table["chunk"].to_pylist(), (Encoded(*x) for x in fields), strict=True))


def encode_documents(
    df: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    dictionary: int = DICTIONARY,
) -> DataFrame:
    """One row per input row: ``doc_id, ids`` (array of int), ``tokens`` (the decoded text).

    A rolling hash cuts texts into chunks; chunks that occur more than once and save most
    are encoded once and reused, and words that a cut runs through are encoded again with
    their neighbours. Ids equal those of the tokenizers library on the whole text without
    special tokens added; ``tokens`` equals its ``decode(ids, skip_special_tokens=False)``.
    A missing or empty text has no ids and decodes to an empty text. Rows with a missing
    or repeated id stay rows of their own; an empty table gives no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    chosen = shared_chunks(rows, dictionary).toArrow()
    shared = df.sparkSession.sparkContext.broadcast(
        encoded_once(rows, chosen, path) if chosen.num_rows else {}
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path, MEMO_WORDS)
        known = shared.value
        names = _token_texts(ids_of)
        for batch in batches:
            first, size, ids, decoded = 0, 0, [], []
            for row, chunks in enumerate(chunks_of(batch.column(1))):
                try:
                    packed = encode_chunks(chunks, known, ids_of)
                except Disagreement:
                    packed = ids_of.encode(b"".join(chunks).decode())
                own = np.frombuffer(packed, "<u4")
                ids.append(own.astype("int32"))
                decoded.append(" ".join(map(names.__getitem__, own.tolist())))
                size += len(own)
                # Results are larger than texts, so they leave in smaller batches.
                if size > OUT_TOKENS or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, row + 1 - first),
                         pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                        ["doc_id", "ids", "tokens"],
                    )
                    first, size, ids, decoded = row + 1, 0, [], []

    return rows.mapInArrow(work, f"doc_id {id_type}, ids array<int>, tokens string")


def _token_texts(ids_of: WordIds) -> list[str]:
    tokenizer = ids_of.tokenizer
    names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    probe = list(range(0, len(names), 97))
    if tokenizer.decode(probe, skip_special_tokens=False) != " ".join(names[i] for i in probe):
        raise ValueError("the tokenizer's decoder does more than joining tokens")
    return names


@register("op9_bpe_chunks")
def op9(spark, sf_dir):
    coded = encode_documents(documents(spark, sf_dir))
    # The library decodes a list of ids to the tokens with single spaces between them.
    text = F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string")))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(text, 256).alias("ids_sha256"), F.sha2("tokens", 256).alias("decoded_sha256"),
    )
