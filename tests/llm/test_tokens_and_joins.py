import hashlib
import itertools
import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm import bpe_chunks, context_mixing, jaccard_join, packing
from ledgerlens.llm.bpe_chunks import encode_documents
from ledgerlens.llm.components import components
from ledgerlens.llm import mixing as M
from ledgerlens.llm.context_mixing import all_scores, mixing_scores
from ledgerlens.llm.jaccard_join import Bands, divide_skip, jaccard_components, spanning_links
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.tokens import WordIds
from ledgerlens.llm.words import FOLD, slices
from ledgerlens.session import materialise
from tests.llm.common import WORDS, odd_rows, prose, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe_chunks.public_tokenizers.path("word_bpe_49k.json"))


def encode(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def given_rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


STRANGE = [
    (70, "don't can't we'll <|endoftext|>x <|startoftext|> 42nd 3.14 ½ ² é ẛ̣"),
    (71, "ΣΑΣ ΑΣ İstanbul ǅ ﬁ 日本語テキスト 🎉🎉  nbsp sep\u0085nel\x1cfs"),
    (72, "...!!!???,,,;;; a,b.c:d \x00 ﻿"),
]


def test_encoding_equals_the_library(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "MIN_CHUNK", 40)
    rows = odd_rows() + STRANGE + given_rows()
    for limit in (0, 5000):
        got = encode_documents(table(spark, rows), dictionary=limit).collect()
        want = Counter()
        for i, t in rows:
            ids = encode(tokenizer, t)
            want[(i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False))] += 1
        assert Counter((r.doc_id, tuple(r.ids), r.tokens) for r in got) == want
    assert encode_documents(table(spark, [])).collect() == []


def test_words_with_any_punctuation_are_remembered_by_their_pieces(tokenizer):
    ids_of = WordIds(bpe_chunks.public_tokenizers.path("word_bpe_49k.json"), 50)
    rng, whole = random.Random(5), []
    encode_whole = ids_of.encode
    ids_of.encode = lambda text: whole.append(text) or encode_whole(text)
    parts = ["Word", "é", "Ünß", "x", "***", "###", "!?", "'", "'s", '"', ")", "<|endoftext|>", "42", "\x01", "中"]
    for _ in range(3_000):
        word = "".join(rng.choices(parts, k=rng.randint(1, 4)))
        assert list(np.frombuffer(ids_of[word.encode()], "<u4")) == encode(tokenizer, word)
    whole.clear()
    for word in ("tree***", "Stone$$$", "été)", "leaf'"):  # once encoded as a whole, at six times the cost
        assert list(np.frombuffer(ids_of[word.encode()], "<u4")) == encode(tokenizer, word)
    assert whole == []


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    """Each task encoded them for itself, and all texts were cut again to find them."""
    monkeypatch.setattr(bpe_chunks, "MIN_CHUNK", 40)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3_000)]
    copies = [" ".join(words[k : k + 400]) for k in (0, 400)]
    rows = [(None, copies[0]), (None, copies[0]), (7, copies[1]), (8, copies[1])]
    rows += [(9 + k, " ".join(words[800 + 20 * k : 820 + 20 * k])) for k in range(100)] + [(200, None), (201, "")]
    given = table(spark, rows).selectExpr("doc_id", "coalesce(text, '') AS t")
    chosen = bpe_chunks.shared_chunks(given, 1_000).toArrow()
    assert set(chosen["holder"].to_pylist()) == {None, 7}
    path = bpe_chunks.public_tokenizers.path("word_bpe_49k.json")
    known = bpe_chunks.encoded_once(given, chosen, path)
    ids_of = WordIds(path, 50)
    assert sorted(map(bpe_chunks.chunk_key, known)) == sorted(chosen["key"].to_pylist())
    assert known == {chunk: bpe_chunks.Encoded.of(chunk, ids_of) for chunk in known}


def test_packing_covers_every_id_once(spark, tokenizer):
    rows = odd_rows() + STRANGE + [(1000 + i, t) for i, t in given_rows()]
    got = pack_documents(table(spark, rows), space=4).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = 0
    for doc_id, text in rows:
        ids = np.array([*encode(tokenizer, text), 1], "<u4")
        total += len(ids)
        if [i for i, _ in rows].count(doc_id) > 1:
            continue
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in got) == total
    assert len(by_sequence) <= 1.1 * math.ceil(total / 2048) + 1
    assert pack_documents(table(spark, [])).collect() == []


def test_sets_leave_in_batches_of_a_slice():
    texts = [" ".join(f"w{i}x{k}" for k in range(3_000)) for i in range(120)]
    texts[70] = texts[3]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None])], ["t"])
    every = SimpleNamespace(value=np.full(1 << (jaccard_join.FILTER_BITS - 6), 2**64 - 1, np.uint64))
    made = list(jaccard_join._sets_of(5, every)(iter([batch])))
    assert len(made) > 2 and max(b.nbytes for b in made) < 4 << 20  # not all sets of the batch at once
    nodes = [k for b in made for k in b.column(0).to_pylist()]
    assert len(nodes) == len(set(nodes)) == 119
    assert all(len(x) == 8 * 2_996 for b in made for x in b.column(1).to_pylist())


def test_packer_tops_up_the_fullest():
    packer = packing.Packer(100, 2)
    placed = [list(packer.place(n)) for n in (70, 60, 45, 250)]
    assert placed[2] == [(0, 45, 2, 0)] or placed[2][0][2] in (0, 1)
    assert sum(x[1] for x in placed[3]) == 250


# -- joins --------------------------------------------------------------------------


def test_divide_skip_counts():
    rng = random.Random(1)
    for _ in range(3000):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 25))) for _ in range(rng.randint(1, 14))]
        least = rng.randint(1, 14)
        counts = Counter(itertools.chain.from_iterable(lists))
        want = sorted((k, n) for k, n in counts.items() if n >= least)
        assert sorted(divide_skip(lists, least)) == want


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def classes(n, links):
    root = list(range(n))
    for a, b in links:
        a, b = find(root, a), find(root, b)
        root[max(a, b)] = min(a, b)
    return [find(root, k) for k in range(n)]


@pytest.mark.parametrize("two", [False, True])
def test_spanning_links_connect_what_is_linked(two):
    rng = random.Random(2)
    for percent in (50, 80, 90):
        sets = []
        for _ in range(12):
            base = rng.sample(range(10_000), 40)
            sets += [sorted({*rng.sample(base, 40 - rng.randint(0, 6)), rng.randrange(10_000)}) for _ in range(6)]
        side = [k % 2 if two else 0 for k in range(len(sets))]
        pairs = [
            (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
            if (not two or side[a] != side[b])
            and 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})
        ]
        links = spanning_links(sets, side, percent)
        assert len(links) < len(sets)
        assert classes(len(sets), links) == classes(len(sets), pairs)


def test_bands_lose_no_link():
    rng = np.random.default_rng(4)
    for percent, n in itertools.product((80, 90), (5, 9, 12, 19, 30, 77, 300)):
        for _ in range(30):
            base = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
            for drop in range(0, n // 3 + 1, max(1, n // 12)):
                a, b = np.unique(base[: n - drop]), np.unique(base[:n])
                if drop % 2:
                    b = np.unique(np.concatenate([b[drop // 2 :], base[n : n + 1]]))
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
                    continue
                value = np.concatenate([a, b])
                row = np.repeat([0, 1], [len(a), len(b)])
                sent = {0: set(), 1: set()}
                size = np.array([len(a), len(b)])
                for of, sig, _ in Bands(percent, 1000).signatures(value, row, size):
                    for k, s in zip(of.tolist(), sig.tolist(), strict=True):
                        sent[k].add(s)
                assert sent[0] & sent[1], (percent, len(a), len(b), both)


def brute_components(rows, width, percent):
    sets = []
    for _, t in rows:
        words = (t or "").encode().translate(bytes(jaccard_join.W.FOLD)).split()
        grams = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    pairs = [
        (a, b) for a, b in itertools.combinations(range(len(rows)), 2)
        if sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = classes(len(rows), pairs)
    ids = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            ids[r] = min(ids.get(r, rows[k][0]), rows[k][0])
    return Counter((i, len(s), ids.get(r) if s else i) for (i, _), s, r in zip(rows, sets, root, strict=True))


@pytest.mark.parametrize("block", [300_000, 400])
def test_jaccard_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rng = random.Random(6)
    rows = odd_rows()
    for k in range(15):
        words = prose(100 + k, rng.randint(4, 120)).split()
        for c in range(8):
            new = list(words)
            for _ in range(rng.randint(0, 3)):
                new[rng.randrange(len(new))] = rng.choice(WORDS) + "X"
            rows.append((1000 + 20 * k + c, " ".join(new)))
    for width, percent in ((3, 90), (5, 80)):
        got = jaccard_components(table(spark, rows), width, percent).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(
            rows, width, percent
        )
    assert jaccard_components(table(spark, [])).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_loops_of_joins_keep_estimates_small(spark):
    rows = spark.range(20).toDF("k")
    for _ in range(9):  # the estimate had twice the digits after each
        rows = materialise(rows.join(rows.withColumnRenamed("k", "other"), F.col("k") == F.col("other")))
        rows = rows.select("k")
    assert [r.k for r in rows.orderBy("k").collect()] == list(range(20))
    assert rows._jdf.logicalPlan().stats().sizeInBytes() < 2**64
    path = components(spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long"))
    assert {(r.node, r.root) for r in path.collect()} == {(k, 0) for k in range(31)}
    assert path._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**70


def test_repairs_of_long_words_are_checked():
    class Ids(dict):
        """Words of other ids beside their neighbours than alone."""

        def __missing__(self, word):
            return bytes(4)

        def encode(self, text):
            return b"other"

    for size in (3, 65, 5_000):
        with pytest.raises(bpe_chunks.Disagreement):
            bpe_chunks.repaired(b"before", b"x" * size, b"after", Ids())


# -- scores -------------------------------------------------------------------------


def test_scores(spark):
    rows = odd_rows() + [(2000 + i, t) for i, t in given_rows()]
    got = mixing_scores(table(spark, rows)).collect()
    trains = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1
    tokens = lambda t: [*(t or "").encode().translate(bytes(jaccard_join.W.FOLD)).split(), b""]
    counts = Counter(w for i, t in rows if trains(i) for w in tokens(t))
    total, norm = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    want = Counter()
    for i, t in rows:
        base = sum(math.log10((counts[w] + 0.5) / norm) for w in tokens(t))
        known = sum(counts[w] > 0 for w in tokens(t))
        want[(i, not trains(i), len(tokens(t)), known, total, round(base, 4))] += 1
    assert want == Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got
    )
    assert all(r.score < 0 for r in got)
    # A trained model knows the language: far below eight bits a byte on held-out texts.
    held = [r.bits_per_byte for r in got if r.held_out and r.doc_id and r.doc_id >= 2000]
    assert sum(held) / len(held) < 3.5


def bucket_of(text, n_buckets=1):
    """Grams of the first bucket of a text, their counts, and those of the short contexts."""
    data = np.frombuffer(text.encode(), np.uint8)
    grams, _ = M.grams_of(data, np.array([0, len(data)]))
    items, counts = np.unique(M.short_items(grams), return_counts=True)
    distinct, n = np.unique(grams, return_counts=True)
    own = M.buckets(distinct, n_buckets) == M.buckets(distinct[:1], n_buckets)[0]
    return distinct[own], n[own], items, counts.astype(float)


def test_scores_are_probabilities():
    """The bytes after a context share one unit of probability, seen in training or not."""
    grams, n, items, counts = bucket_of(prose(1, 600), 4)
    for at in (0, len(grams) // 2, len(grams) - 1):
        after = (grams[at] & ~np.uint64(0xFF)) | np.arange(256, dtype=np.uint64)
        every = np.union1d(grams, after)
        times = np.zeros(len(every), np.int64)
        times[np.searchsorted(every, grams)] = n
        score = M.log2_of(every, times, items, counts)
        assert abs((2.0 ** score[np.searchsorted(every, after)]).sum() - 1) < 1e-6
        # Grams without a count change nothing for the others.
        assert np.allclose(score[np.searchsorted(every, grams)], M.log2_of(grams, n, items, counts), atol=1e-4)


def brute_force_log2(text):
    """The model of one bucket with dictionaries and loops, for the text's distinct grams."""
    raw, seen = text.encode() + b"\xff", Counter()
    for i, byte in enumerate(raw):
        before = b"\xff" * 5 + raw[:i]
        # An END has the whole of the last word before it, a space likewise.
        word = before[max(before.rfind(b" "), before.rfind(b"\xff")) + 1 :]
        seen[(before[-5:], word, byte)] += 1
    table = Counter()
    contexts = lambda before, word: [before[5 - k :] for k in range(1, 6)] + [(before[-3:], word)]
    for (before, word, byte), n in seen.items():
        for k, context in enumerate(contexts(before, word)):
            for bit in range(8):
                table[k, context, bit, byte >> (8 - bit), byte >> (7 - bit) & 1] += n
    squash = lambda x: 1 / (1 + math.exp(-min(max(x, -20), 20)))

    def view(gram, bit, less):
        before, word, byte = gram
        x, known, level = [], 0, 0
        for k, context in enumerate(contexts(before, word)):
            zeros, ones = (table[k, context, bit, byte >> (8 - bit), side] for side in (0, 1))
            one = byte >> (7 - bit) & 1
            zeros, ones = zeros - less * (1 - one), ones - less * one
            both = zeros + ones
            odds = math.log((ones + M.PRIOR) / (zeros + M.PRIOR)) * both / (both + 0.4)
            x.append(min(max(odds, -13), 13))
            known += k < 5 and both > 0
            level = sum(both >= edge for edge in (0.5, 2.5, 12.5))
        return np.array([*x, 0.3]), known + 6 * level

    return seen, view, squash


def test_scores_equal_brute_force(monkeypatch):
    monkeypatch.setattr(M, "STEP", 1)
    text = " ".join(prose(3, 60).lower().split())
    seen, view, squash = brute_force_log2(text)
    grams, n, items, counts = bucket_of(text)
    pack = {}  # the same gram as numbers, to learn in the same order
    data = np.frombuffer(text.encode(), np.uint8)
    raw = text.encode() + b"\xff"
    for i, gram in enumerate(M.grams_of(data, np.array([0, len(data)]))[0]):
        before = b"\xff" * 5 + raw[:i]
        word = before[max(before.rfind(b" "), before.rfind(b"\xff")) + 1 :]
        pack[(before[-5:], word, raw[i])] = int(gram)
    assert len(set(pack.values())) == len(pack) == len(grams)
    order = sorted(seen, key=lambda g: int(M.mix(np.array([pack[g]], np.uint64))[0]))
    want = dict.fromkeys(seen, 0.0)
    for bit in range(8):
        w, speed = np.full((M.GATES, 7), 0.3), np.full((M.GATES, 7), 1e-4)
        line = np.linspace(-M.SPREAD, M.SPREAD, M.BUCKETS)
        hits = np.array([[M.PULL * squash(v) for v in line]] * M.GATES)
        hits, total = hits, np.full((M.GATES, M.BUCKETS), M.PULL)
        for gram in order:
            x, gate = view(gram, bit, 1)
            one, weight = gram[2] >> (7 - bit) & 1, seen[gram]
            mixed = w[gate] @ x
            slope = (one - squash(mixed)) * x
            speed[gate] += slope**2
            w[gate] += M.RATE * slope / np.sqrt(speed[gate])
            place, part = M._bucket(np.array([mixed]))
            for at, share in ((place[0], 1 - part[0]), (place[0] + 1, part[0])):
                hits[gate, at] += share * weight * one
                total[gate, at] += share * weight
        refined = hits / total
        for gram in seen:
            x, gate = view(gram, bit, 0)
            mixed = w[gate] @ x
            adapted = np.interp(np.clip(mixed, -M.SPREAD, line[-1] - 1e-9), line, refined[gate])
            p = min(max((squash(mixed) + adapted) / 2, 1e-6), 1 - 1e-6)
            want[gram] += math.log2(p if gram[2] >> (7 - bit) & 1 else 1 - p)
    got = dict(zip(grams.tolist(), M.log2_of(grams, n, items, counts), strict=True))
    assert all(abs(got[pack[g]] - want[g]) < 1e-2 for g in seen)


def test_scores_do_not_depend_on_blocks(spark):
    rows = spark.createDataFrame(
        [(k, k, k % 5 != 1, prose(k, 120) if k else "") for k in range(30)],
        "doc_id long, key long, trains boolean, t string",
    )
    made = [
        {r.doc_id: r for r in all_scores(rows, block).collect()} for block in (1 << 24, 500, 1)
    ]
    assert set(made[0]) == set(range(30))
    for other in made[1:]:
        assert all(abs(other[k].score - r.score) < 1e-3 for k, r in made[0].items())
        assert all((other[k].n_tokens, other[k].n_bytes) == (r.n_tokens, r.n_bytes) for k, r in made[0].items())
    # More buckets have mixers of their own, but the same counts.
    many = {r.doc_id: r.score for r in all_scores(rows, 1 << 24, 500).collect()}
    assert sum(many.values()) > 1.2 * sum(r.score for r in made[0].values())


def test_lookup_finds_every_gram():
    grams = M.mix(np.arange(5000, dtype=np.uint64))
    found = M.Lookup(grams, np.arange(5000.0)).of(np.repeat(grams[::-1], 2))
    assert (found == np.repeat(np.arange(5000.0)[::-1], 2)).all()
    assert len(M.Lookup(grams[:0], np.zeros(0)).of(grams[:0])) == 0


def test_grams_equal_brute_force():
    rng = random.Random(8)
    texts = ["", " ", "a", "A b", "\t a  b\n", "é ü", "abcdefg"]
    texts += ["".join(rng.choices("aB c\t\né.", k=rng.randint(0, 12))) for _ in range(300)]
    data = [x.encode() for x in texts]
    grams, row = M.grams_of(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])))
    want = []
    for k, text in enumerate(data):
        whole = b" ".join(text.translate(bytes(FOLD)).split()) + b"\xff"
        for at, byte in enumerate(whole):
            back = [whole[at - j] if at >= j else 0xFF for j in range(1, M.ORDERS + 1)]
            want.append((k, sum(x << 8 * j for j, x in enumerate([byte, *back])), whole[:at].split(b" ")[-1]))
    low = np.uint64((1 << 48) - 1)
    assert list(zip(row.tolist(), (grams & low).tolist(), strict=True)) == [x[:2] for x in want]
    hashes = {}  # one of each word so far
    for gram, (_, _, word) in zip(grams.tolist(), want, strict=True):
        assert hashes.setdefault(word, gram >> 48) == gram >> 48
    assert (M.turned_back(M.turned(grams)) == grams).all()


def test_grams_leave_once_and_small(spark):
    """They were written to a table, sent from it and sent back, sorted by a hash: more disk
    than allowed."""
    texts = [t for _, t in given_rows() if t]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([5] * len(texts)), pa.array([True] * len(texts)), pa.array(texts)], ["block", "trains", "t"]
    )
    rows = list(context_mixing._block_items(8, True)(iter([batch])))[0]
    sent = sum(map(len, rows["grams"].to_pylist()))
    whole = context_mixing._all_planes(rows["grams"], np.uint64)
    before = sum(len(context_mixing._planes(np.sort(M.turned_back(x)))) for x in whole)
    assert sent < 0.75 * before
    blocks = spark.createDataFrame(pa.Table.from_batches([batch]))
    answers, total, _, items, counts = context_mixing.token_counts(blocks)
    grams = np.concatenate([M.grams_of(d, b)[0] for _, _, d, b in slices(batch.column(2))])
    want = np.unique(M.short_items(grams), return_counts=True)
    assert (items == want[0]).all() and (counts == want[1]).all()
    assert total == sum(len(t.encode().split()) + 1 for t in texts)
    assert {row.block for row in answers.select("block").collect()} == {5}
    made = context_mixing.gram_scores(blocks, items, counts)
    assert made.inputFiles() == blocks.inputFiles()  # nothing was written between


def test_scores_empty_table(spark):
    assert mixing_scores(table(spark, [])).collect() == []


# -- pipeline -----------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        done.write.parquet(f"{tmp_path}/{name}")
        done = spark.read.parquet(f"{tmp_path}/{name}")
        rows = done.collect()
        if name != "packing":
            assert done.columns == columns
            assert all(r.n_chars == len(r.text) for r in rows)
            assert before is None or {r.doc_id for r in rows} <= before
            before = {r.doc_id for r in rows}
        docs = done
    assert {r.doc_id for r in rows} == before
    ran = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, ran)) == sorted(map(key, rows))


def test_pipeline_takes_odd_rows(spark, tmp_path):
    rows = [(i, t, None, "s", None) for i, t in odd_rows()]
    for given in (rows, []):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        kept = {r.doc_id for r in docs.collect()}
        assert bool(kept) == bool(given)




def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b, c = prose(1, 100), prose(2, 100), prose(3, 100)
    rows = [(1, a), (1, a), (1, a + " end"), (1, b), (2, b), (2, c), (2, c), (None, prose(4)), (None, prose(4)),
            (None, prose(5)), (None, c), (7, ""), (7, ""), (8, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "l", f"s{k}", None) for k, (i, t) in enumerate(rows)], schema)
    got = corpus_pipeline.near_duplicates(spark, docs.repartition(4), SF)
    assert got.columns == docs.columns
    near = {a: a, a + " end": a}
    found = Counter((r.doc_id, near.get(r.text, r.text)) for r in got.collect())
    assert found == {(1, a): 1, (1, b): 1, (2, c): 1, (None, prose(4)): 1, (None, prose(5)): 1,
                     (7, ""): 2, (8, None): 1}


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for drop in (0, 1, 20, 150):
        a, b = np.unique(base[drop:]), np.unique(base[: 400 - drop // 2])
        row = np.repeat([0, 1], [len(a), len(b)])
        x, y = jaccard_join.parity_sketches(np.concatenate([a, b]), row, 2)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_sampled_sketches_keep_large_linked_sets():
    rng = np.random.default_rng(10)
    for percent, n in ((80, 9_000), (90, 9_000), (80, 2_000)):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        other = np.unique(np.concatenate([base[: n * percent // 100], rng.integers(0, 2**63, 40, dtype=np.uint64)]))
        far = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        level = np.array([Bands(percent, n).levels[np.searchsorted(Bands(percent, n).lows, n, "right") - 1]] * 3)
        row = np.repeat([0, 1, 2], [len(base), len(other), len(far)])
        a, b, c = jaccard_join.parity_sketches(np.concatenate([base, other, far]), row, 3, level)
        bound = jaccard_join.most_bits(np.array([len(base) + len(other)]), level[:1], percent)
        assert np.bitwise_count(a ^ b).sum() <= bound < np.bitwise_count(a ^ c).sum()


def test_groups_may_span_batches():
    rng = np.random.default_rng(9)
    words = jaccard_join.SKETCH_WORDS
    near = rng.integers(0, 2**63, words, dtype=np.uint64)
    groups = np.sort(rng.integers(0, 30, 200))
    sketches = [near.tobytes() if k % 3 else bytes(8 * words) for k in range(200)]
    rows = [pa.array(groups), pa.array(np.arange(200)), pa.array(np.full(200, 50)),
            pa.array(np.zeros(200, np.int64)), pa.array(sketches, pa.binary()), pa.array([False] * 200)]
    whole = pa.RecordBatch.from_arrays(rows, ["group", "set_id", "size", "level", "sketch", "hot"])
    for step in (1, 7, 200):
        batches = iter([whole.slice(k, step) for k in range(0, 200, step)])
        links = [x for b in jaccard_join._grouped_links(80)(batches) for x in zip(*[c.to_pylist() for c in b.columns[:2]], strict=True)]
        want = [(a, b) for a, b in itertools.combinations(range(200), 2)
                if groups[a] == groups[b] and (a % 3 > 0) == (b % 3 > 0)]
        assert classes(200, links) == classes(200, want)


def test_hot_rows_pass_the_groups_unchanged():
    words = jaccard_join.SKETCH_WORDS
    names = ["group", "set_id", "size", "level", "sketch", "hot"]
    rows = [[5, 5, 7, 9], [1, 2, 3, 4], [50] * 4, [0] * 4, [bytes(8 * words)] * 4, [False, False, True, True]]
    made = list(jaccard_join._grouped_links(80)(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names)])))
    got = [tuple(c.to_pylist()[k] for c in b.columns[:2]) + (b.column(4)[k].is_valid,) for b in made for k in range(b.num_rows)]
    assert sorted(got) == [(1, 2, False), (7, 3, True), (9, 4, True)]


def near_copies(n, words=30):
    """Copies with a word changed here and there, in two families, and unrelated texts."""
    rng = random.Random(n)
    base = [[f"w{f}x{k}" for k in range(words)] for f in range(2)]
    rows = []
    for k in range(n):
        text = list(base[k % 2])
        for _ in range(rng.randrange(3)):
            text[rng.randrange(words)] = f"new{rng.randrange(50)}"
        rows.append((k, " ".join(text)))
    return rows + [(n + k, " ".join(f"u{k}y{j}" for j in range(words))) for k in range(5)]


def test_hot_signatures_meet_pivots(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_GROUP", 4)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    rows = near_copies(60)
    sets = {i: {" ".join(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])]
    want = classes(len(rows), links)
    got = {r.doc_id: r.component_id for r in jaccard_components(table(spark, rows), 3, 60).collect()}
    assert [got[k] for k in range(len(rows))] == want


def test_unrelated_texts_share_no_signature():
    """Signatures say something of the content, also where parts are empty."""
    rng = np.random.default_rng(2)
    for n in (100, 1_000, 4_000):
        value = np.sort(rng.integers(0, 2**63, (20, n), dtype=np.uint64), axis=1).reshape(-1)
        row, size = np.repeat(np.arange(20), n), np.full(20, n)
        sent = [sig for _, sig, _ in Bands(80, 2 * n).signatures(value, row, size)]
        sent = np.concatenate(sent)
        assert len(np.unique(sent)) == len(sent)
