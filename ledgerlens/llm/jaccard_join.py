"""Jaccard join on word shingles by T-occurrence search with DivideSkip."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm import words as W
from ledgerlens.llm.components import components
from ledgerlens.llm.registry import documents, join_keys, register
from ledgerlens.llm.text_batches import releasing
from ledgerlens.session import materialise

#: Shingles of the sets that one search task holds (8 bytes each, and as many list entries).
BLOCK_SHINGLES = 300_000
#: Bits of the filters that say which signatures and sets are worth sending; their size
#: never changes.
FILTER_BITS = 25
#: Sets of one signature that one task compares; larger groups meet pivots first.
HOT_GROUP = 2_000
#: Pivots of a hot signature in the first round and at most; rounds double them.
PIVOTS, MOST_PIVOTS = 4, 256
#: Rows of hot signatures in one task.
ROWS_PER_TASK = 20_000
#: Rows of pivots up to this number are broadcast (150 bytes each), more are shuffled.
BROADCAST_PIVOTS = 50_000
#: 64-bit words of a set's parity sketch. Sets of more than SKETCH_SETS shingles are
#: sketched from a share of them, chosen by hash, which then bounds the difference but for
#: a chance below 1e-14 for each pair (ten standard deviations).
SKETCH_WORDS, SKETCH_SETS = 16, 800
#: Weight of binary probes against heap steps when lists are divided into long and short.
PROBE_WEIGHT = 0.01
#: Key tables up to this many rows are broadcast, larger ones are shuffled.
BROADCAST_KEYS = 100_000


# -- sets of shingles ---------------------------------------------------------------


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the distinct shingles, by row and hash; A-Z are lower-cased.

    A text of fewer words than ``width`` has its whole sequence as one shingle.
    """
    data = W.FOLD[data]
    starts, ends, rows = W.split_words(data, bounds)
    hashes = W.Spans(data).hash(starts, ends)
    parts = [W.shingles(hashes, rows, width)]
    counts = np.bincount(rows, minlength=len(bounds) - 1)
    for short in range(1, width):
        own = counts[rows] == short
        parts.append(W.shingles(hashes[own], rows[own], short))
    value = np.concatenate([p[0] for p in parts])
    row = np.concatenate([p[1] for p in parts])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def set_ids(value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit id of each row's set; equal sets have equal ids, an empty one has 0."""
    size = np.bincount(row, minlength=n)
    ids = np.zeros(n, np.uint64)
    filled = np.flatnonzero(size)
    if len(filled):
        first = np.searchsorted(row, filled)
        sums = np.add.reduceat(W.mix(value), first)
        ids[filled] = W.mix(sums + size[filled].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return size, ids


def per_text(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for first, end, data, bounds in W.slices(column):
        value, row = shingle_sets(data, bounds, width)
        yield (value, row, *set_ids(value, row, end - first))


# -- routing: sets that can link share a part ---------------------------------------


class Bands:
    """Ranges of set sizes such that linked sets lie in one range or in neighbouring ones.

    Linked sets of the sizes n and m differ in at most ``(n + m) (1 - t) / (1 + t)``
    shingles (t: the percentage as a share). Cut by hash into ``1 + spare`` more parts than
    that, both have at least ``1 + spare`` equal parts, so they share a filled one unless
    both have more than ``spare`` empty parts; only then empty parts are sent as well.
    ``spare`` is six deviations above the empty parts that the smallest set of a band has
    on average, so what is sent says something of the content.
    """

    def __init__(self, percent: int, largest: int):
        self.percent, lows = percent, [1]
        while lows[-1] <= largest * 200 // percent:
            lows.append(lows[-1] * 100 // percent + 1)
        lows += [lows[-1] * 100 // percent + 1, lows[-1] * 200 // percent + 2]
        self.lows = np.array(lows)
        most = self.lows[1:-1] - 1 + self.lows[2:] - 1  # of a band and of it with the next
        self.differ = most * (100 - percent) // (100 + percent)
        parts = self.differ + 2.0
        for _ in range(8):  # more parts have more empty ones
            empty = parts * np.exp(-self.lows[:-2] / parts)
            spare = np.maximum(1, np.ceil(empty + 6 * np.sqrt(empty) - 1e-3))
            parts = self.differ + 1 + spare
        self.spare = spare.astype(np.int64)
        self.levels = np.maximum(0, np.ceil(np.log2(self.lows / SKETCH_SETS))).astype(np.int64)

    def signatures(self, value: np.ndarray, row: np.ndarray, size: np.ndarray):
        """Rows and values of all signatures that make a candidate when shared, and for
        each row the level of the sketch that goes with them."""
        band = np.searchsorted(self.lows, size, "right") - 1
        low, high = value & np.uint64(0xFFFFFFFF), value >> np.uint64(32)
        mixed = W.mix(value)
        for back in (0, 1):  # a band's own group, and that of the band below
            group = band - back
            sent = (size > 0) & (group >= 0)
            differ = np.where(sent, self.differ[np.maximum(group, 0)], 0)
            sent &= differ > 0  # without a difference linked sets are equal sets
            spare = self.spare[np.maximum(group, 0)]
            parts = np.where(sent, differ + 1 + spare, 0)
            base = np.concatenate([[0], np.cumsum(parts)])
            use = sent[row]
            if not use.any():
                continue
            part = ((high[use] ^ low[use]) * parts[row[use]].astype(np.uint64)) >> np.uint64(32)
            place = base[row[use]] + part.astype(np.int64)
            total = int(base[-1])
            filled = np.bincount(place, minlength=total) > 0
            sums = np.zeros(total, np.uint64)
            for shift in (0, 32):  # halves are summed exactly as doubles
                half = (mixed[use] >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
                added = np.bincount(place, half.astype(np.float64), minlength=total)
                sums += added.astype(np.uint64) << np.uint64(shift)
            of = np.repeat(np.arange(len(size)), parts)
            empty = np.bincount(of[~filled], minlength=len(size))
            emit = filled | (empty[of] > spare[of])
            number = (np.arange(total) - base[of]).astype(np.uint64)
            seed = W.mix((group[of].astype(np.uint64) << np.uint64(32)) + number + np.uint64(1))
            yield of[emit], W.mix(sums[emit] + seed[emit]), self.levels[np.maximum(group, 0)]


def parity_sketches(
    value: np.ndarray, row: np.ndarray, n: int, levels: np.ndarray | None = None
) -> np.ndarray:
    """(n, SKETCH_WORDS): each shingle flips one bit, so sketches of two sets differ in at
    most as many bits as the sets differ in shingles. At level j a row's sketch has one in
    ``2**j`` of its shingles."""
    if levels is not None and levels.any():
        picked = W.mix(value ^ np.uint64(0x2545F4914F6CDD1D))
        kept = (picked & ((np.uint64(1) << levels[row].astype(np.uint64)) - np.uint64(1))) == 0
        value, row = value[kept], row[kept]
    bit = (W.mix(value ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(54)).astype(np.int64)
    bits = SKETCH_WORDS * 64
    odd = (np.bincount(row * bits + bit % bits, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view(np.uint64)


def most_bits(total: np.ndarray, level: int | np.ndarray, percent: int) -> np.ndarray:
    """Most bits in which sketches of linked sets of ``total`` shingles together differ."""
    exact = total * (100 - percent) // (100 + percent)
    share = exact / 2.0**level
    return np.where(level > 0, share + 10 * np.sqrt(share) + 8, exact)


def compatible_links(
    ids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, level: int, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all sets of a group which their sketches allow to link.

    Breadth first as :func:`spanning_links`: what was reached is not compared again.
    """
    waiting, links = np.arange(len(ids)), []
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        for k in queue:
            if not len(waiting):
                break
            differ = np.bitwise_count(sketches[waiting] ^ sketches[k]).sum(axis=1, dtype=np.int64)
            met = differ <= most_bits(sizes[waiting] + sizes[k], level, percent)
            for x in waiting[met].tolist():
                links.append((ids[k], ids[x]))
                queue.append(x)
            waiting = waiting[~met]
    a, b = zip(*links, strict=True) if links else ((), ())
    return np.array(a, np.int64), np.array(b, np.int64)


def _grouped_links(percent: int):
    """Compatible links of each run of equal ``group``; rows come sorted by it."""

    def links_of(group, ids, sizes, levels, sketches) -> pa.RecordBatch:
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(heads[1:], len(group))
        pairs = heads[ends - heads == 2]  # nearly all groups
        differ = np.bitwise_count(sketches[pairs] ^ sketches[pairs + 1]).sum(axis=1, dtype=np.int64)
        pairs = pairs[differ <= most_bits(sizes[pairs] + sizes[pairs + 1], levels[pairs], percent)]
        out = [(ids[pairs], ids[pairs + 1])]
        for head, end in zip(heads, ends, strict=True):
            if end - head > 2:
                own = slice(head, end)
                out.append(compatible_links(ids[own], sizes[own], sketches[own], levels[head], percent))
        made = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)]), axis=1)
        n = made.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(made[0]), pa.array(made[1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
             pa.nulls(n, pa.binary())], ["a", "b", "size", "level", "sketch"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            hot = batch.column(5)
            if pc.any(hot).as_py():  # those of hot signatures go on as they are
                names = ["a", "b", "size", "level", "sketch"]
                yield pa.RecordBatch.from_arrays(batch.filter(hot).columns[:5], names)
                batch = batch.filter(pc.invert(hot))
            if not batch.num_rows:
                continue
            sketch = b"".join(batch.column(4).to_pylist())
            now = [
                *(batch.column(k).to_numpy() for k in range(4)),
                np.frombuffer(sketch, np.uint64).reshape(-1, SKETCH_WORDS),
            ]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            last = int(np.searchsorted(held[0] == held[0][-1], True))  # the group may go on
            if last:
                yield links_of(*[x[:last] for x in held])
                held = [x[last:] for x in held]
        if held:
            yield links_of(*held)

    return work


_FOUND = "a long, b long, size long, level long, sketch binary"


def _links_by_signature(signed: DataFrame, percent: int, tasks: int | None = None) -> DataFrame:
    """Compatible links (without a sketch) of ``sig, set_id, size, level, sketch, hot``, and
    the rows of hot signatures as they are; in ``tasks`` tasks where few rows are known."""
    # Hot signatures are only passed on, so their rows are dealt out by set as well.
    group = F.when(F.col("hot"), F.xxhash64("sig", "set_id")).otherwise(F.col("sig"))
    rows = signed.select(group.alias("group"), "set_id", "size", "level", "sketch", "hot", "sig")
    rows = rows.repartition("group")
    rows = (rows.coalesce(tasks) if tasks else rows).sortWithinPartitions("group")
    # `group` has done its work; a hot row's signature is what goes on.
    rows = rows.select(F.when(F.col("hot"), F.col("sig")).otherwise(F.col("group")).alias("group"),
                       "set_id", "size", "level", "sketch", "hot")
    return rows.mapInArrow(_grouped_links(percent), _FOUND)


def _met_pivots(percent: int):
    """For each row: the pivots of its signature within twice the bound, and whether one is
    within the bound itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(1).to_numpy()
            level, most = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(n, -1)
            ends = batch.column(6).offsets.to_numpy()
            ends = ends - ends[0]
            flat = batch.column(6).flatten()
            pivot = flat.field(0).to_numpy()
            other = np.frombuffer(b"".join(flat.field(1).to_pylist()), np.uint64).reshape(len(pivot), -1)
            row = np.repeat(np.arange(n), np.diff(ends))
            away = np.zeros(len(row), np.int64)
            for first in range(0, len(row), 20_000):
                part = slice(first, first + 20_000)
                differ = np.bitwise_count(sketch[row[part]] ^ other[part])
                away[part] = differ.sum(axis=1, dtype=np.int64)
            bound = most_bits(2 * most, level, percent)[row]
            near = np.zeros(n, bool)
            near[row[away <= bound]] = True
            met = (away <= 2 * bound) & (pivot != ids[row])
            counts = np.bincount(row[met], minlength=n)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(pivot[met])
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(near), lists],
                ["sig", "set_id", "size", "level", "sketch", "near", "met"],
            )

    return work


def _hot_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join whatever may link within hot signatures.

    Sketch distance obeys the triangle inequality: what links with a set within the bound
    of a pivot lies within twice the bound of that pivot. So all sets within twice the
    bound are linked with the pivot, and those within the bound are done. Each round
    compares every set that is left with a few pivots of its signature; a group of near
    copies is done after one. Signatures with few sets left are compared in one task.
    """
    rest = rows.select(F.col("a").alias("sig"), F.col("b").alias("set_id"), "size", "level", "sketch")
    rest = materialise(rest.dropDuplicates(["sig", "set_id"]))
    schema = "sig long, set_id long, size long, level long, sketch binary, near boolean, met array<long>"
    found, pivots = [], PIVOTS
    while True:
        counts = materialise(rest.groupBy("sig").agg(F.count("*").alias("n"), F.max("size").alias("most")))
        # Few rows are worked on by few tasks.
        tasks = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // ROWS_PER_TASK))
        counts, rest = counts.coalesce(tasks), rest.coalesce(tasks)
        hot = counts.filter(F.col("n") > HOT_GROUP)
        cool = counts.filter(F.col("n") <= HOT_GROUP).select("sig")
        few = rest.join(cool, "sig", "left_semi").withColumn("hot", F.lit(False))
        links = _links_by_signature(few, percent, tasks).select("a", "b").distinct()
        found.append(materialise(links.coalesce(tasks)))
        if hot.isEmpty():
            break
        rest = rest.join(hot.select("sig"), "sig", "left_semi")
        first = F.row_number().over(Window.partitionBy("sig").orderBy("set_id"))
        chosen = rest.withColumn("place", first).filter(F.col("place") <= pivots)  # limits before it shuffles
        chosen = chosen.groupBy("sig").agg(F.collect_list(F.struct("set_id", "sketch")).alias("pivots"))
        chosen = materialise(chosen.join(hot.select("sig", "most"), "sig").coalesce(tasks))
        met = join_keys(rest, chosen, ["sig"], "inner", BROADCAST_PIVOTS // pivots)
        met = met.select("sig", "set_id", "size", "level", "sketch", "most", "pivots")
        met = materialise(met.mapInArrow(_met_pivots(percent), schema))
        found.append(met.select(F.explode("met").alias("a"), F.col("set_id").alias("b")).distinct())
        rest = met.filter("not near").select("sig", "set_id", "size", "level", "sketch")
        pivots = min(2 * pivots, MOST_PIVOTS)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


# -- search -------------------------------------------------------------------------


def divide_skip(lists: list[list[int]], threshold: int) -> Iterator[tuple[int, int]]:
    """``(member, count)`` of the members of at least ``threshold`` of the sorted lists.

    The longest lists are put aside; the others are merged by a heap that skips members
    too rare to qualify, and what remains is looked up in the long ones by binary search.
    """
    lists = sorted((x for x in lists if x), key=len, reverse=True)
    if len(lists) < threshold:
        return
    probes = int(threshold / (PROBE_WEIGHT * np.log2(len(lists[0]) + 1) + 1))
    probes = max(0, min(probes, threshold - 1))
    long, short = lists[:probes], lists[probes:]
    needed = threshold - probes
    at = [0] * len(short)
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    while len(heap) >= needed:
        member, popped = heap[0][0], []
        while heap and heap[0][0] == member:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= needed:
            count = len(popped)
            for k, x in enumerate(long):
                if count + len(long) - k < threshold:
                    break
                place = bisect_left(x, member)
                count += place < len(x) and x[place] == member
            if count >= threshold:
                yield member, count
            following = member + 1
        else:  # take out as many as can't qualify together, and skip to the next one
            while heap and len(popped) < needed - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            following = heap[0][0]
        for k in popped:
            x = short[k]
            at[k] = bisect_left(x, following, at[k])
            if at[k] < len(x):
                heapq.heappush(heap, (x[at[k]], k))


class Lists:
    """Inverted lists over the sets that no search has reached yet."""

    def __init__(self, sets: list[list[int]], members: list[int]):
        self.sets, self.live = sets, set(members)
        self.build()

    def build(self) -> None:
        self.lists: dict[int, list[int]] = {}
        for k in sorted(self.live):
            for token in self.sets[k]:
                self.lists.setdefault(token, []).append(k)
        self.built = len(self.live)

    def reach(self, k: int) -> None:
        self.live.discard(k)
        if self.live and 2 * len(self.live) < self.built:
            self.build()

    def search(self, query: list[int], percent: int) -> list[int]:
        """Live sets that link with the query."""
        if not self.live:
            return []
        n = len(query)
        smallest = -(-percent * n // 100)
        least = -(-percent * (n + smallest) // (100 + percent))
        lists = [x for x in map(self.lists.get, query) if x]
        found = []
        for k, count in divide_skip(lists, least):
            union = n + len(self.sets[k]) - count
            if k in self.live and 100 * count >= percent * union:
                found.append(k)
        return found


def spanning_links(sets: list[list[int]], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever is linked, at most one per set.

    Sets are searched breadth first, and a set that was reached leaves the lists, so a
    group of n copies takes n links and not all pairs. With two sides only links across
    count: each set searches the lists of the other side.
    """
    two = len(set(side)) == 2
    sides = {s: Lists(sets, [k for k, x in enumerate(side) if x == s]) for s in set(side)}
    other = {s: (1 - s if two else s) for s in sides}
    links, reached = [], [False] * len(sets)
    for start in range(len(sets)):
        if reached[start]:
            continue
        queue = [start]
        reached[start] = True
        sides[side[start]].reach(start)
        for k in queue:
            there = sides[other[side[k]]]
            for found in there.search(sets[k], percent):
                links.append((k, found))
                reached[found] = True
                there.reach(found)
                queue.append(found)
    return links


# -- filters ------------------------------------------------------------------------


def _filter_of(keys: DataFrame, column: str):
    """A broadcast bitmap of hashed keys: ``2**FILTER_BITS`` bits whatever their number."""
    words = 1 << (FILTER_BITS - 6)
    key = F.col(column)
    marks = keys.groupBy(F.shiftright(key, 6).bitwiseAND(words - 1).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")
    )
    table = np.zeros(words, np.uint64)
    packed = marks.groupBy((F.col("word") % 256).alias("slice")).agg(
        F.collect_list("word").alias("words"), F.collect_list("bits").alias("bits")
    )
    for row in packed.toLocalIterator():  # at most `words` numbers in all
        table[np.array(row.words, np.int64)] = np.array(row.bits, np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def _passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word = table[(keys >> np.uint64(6)) & np.uint64(len(table) - 1)]
    return ((word >> (keys & np.uint64(63))) & np.uint64(1)) > 0


def _first_seen(ids: np.ndarray, sent: set[int]) -> np.ndarray:
    """Mask of the ids that are not in ``sent``, which gets them."""
    new = np.zeros(len(ids), bool)
    for k, x in enumerate(ids.tolist()):
        new[k] = x not in sent
        sent.add(x)
    return new


# -- the join -----------------------------------------------------------------------


def _sets_of(width: int, hint):
    """The sets that the broadcast filter ``hint`` lets pass, once for each batch of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent: set[int] = set()
            # One batch for each slice of texts, as sets are larger than their texts.
            for value, row, size, ids in per_text(batch.column(0), width):
                keys, sets = [], []
                for k in np.flatnonzero(_passes(hint.value, ids) & (size > 0)).tolist():
                    if int(ids[k]) not in sent:
                        sent.add(int(ids[k]))
                        keys.append(int(ids[k].view(np.int64)))
                        first, end = np.searchsorted(row, [k, k + 1])
                        sets.append(value[first:end].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"]
                )

    return work


def near_sets(
    df: DataFrame, width: int, percent: int, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_shingles, set_id)`` of every row and ``(set_id, root)`` of linked sets."""
    texts = df.select(F.col(text_col).alias("t"))
    id_type = df.schema[id_col].dataType.simpleString()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(size, ids) for _, _, size, ids in per_text(batch.column(1), width)]
            n = np.concatenate([m[0] for m in made]) if made else np.zeros(0, np.int64)
            ids = np.concatenate([m[1] for m in made]) if made else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids.view(np.int64))],
                ["doc_id", "n_shingles", "set_id"],
            )

    rows = materialise(
        df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(
            releasing(sizes), f"doc_id {id_type}, n_shingles long, set_id long"
        )
    )
    largest = rows.agg(F.max("n_shingles")).first()[0] or 0

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, largest)
        for batch in batches:
            sent: set[int] = set()  # equal sets of a batch are sent once
            for value, row, size, ids in per_text(batch.column(0), width):
                new = _first_seen(ids, sent)
                kept = new[row]
                for _, sig, _ in bands.signatures(value[kept], row[kept], np.where(new, size, 0)):
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64))], ["sig"])

    counted = texts.mapInArrow(releasing(signatures), "sig long").groupBy("sig").agg(F.count("*").alias("n"))
    shared = materialise(counted.filter("n > 1"))
    may_share = _filter_of(shared, "sig")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, largest)
        for batch in batches:
            sent: set[int] = set()
            for value, row, size, ids in per_text(batch.column(0), width):
                new = _first_seen(ids, sent)
                kept = new[row]
                step = 8 * SKETCH_WORDS
                for of, sig, levels in bands.signatures(
                    value[kept], row[kept], np.where(new, size, 0)
                ):
                    raw = parity_sketches(value, row, len(size), levels).tobytes()
                    use = _passes(may_share.value, sig)
                    of, sig = of[use], sig[use]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig.view(np.int64)), pa.array(ids[of].view(np.int64)),
                         pa.array(size[of].astype(np.int64)), pa.array(levels[of]),
                         pa.array([raw[k * step : (k + 1) * step] for k in of.tolist()], pa.binary())],
                        ["sig", "set_id", "size", "level", "sketch"],
                    )

    signed = texts.mapInArrow(
        releasing(sketched), "sig long, set_id long, size long, level long, sketch binary"
    )
    hot = materialise(shared.filter(F.col("n") > HOT_GROUP).select("sig", F.lit(True).alias("hot")))
    signed = join_keys(signed, hot, ["sig"], "left", BROADCAST_KEYS)
    signed = signed.withColumn("hot", F.coalesce("hot", F.lit(False)))
    met = materialise(_links_by_signature(signed, percent))
    links = met.filter("sketch is null").select("a", "b")
    if not hot.isEmpty():
        links = links.unionByName(_hot_links(met.filter("sketch is not null"), percent))
    links = links.filter("a <> b").distinct()
    candidates = materialise(components(links))
    hint = _filter_of(candidates, "node")

    # Groups that are too large for a task are cut into blocks; every two blocks of a
    # group meet in a task of their own.
    counts = rows.groupBy("set_id").agg(F.first("n_shingles").alias("n"))
    members = candidates.join(counts.withColumnRenamed("set_id", "node"), "node")
    total = materialise(members.groupBy("root").agg(F.sum("n").alias("total")))
    blocks = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks")
    everything = total.agg(F.sum("total")).first()[0] or 0
    tasks = max(1, everything // BLOCK_SHINGLES)
    placed = members.join(total, "root").select("node", "root", blocks)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.withColumn("block", block)
    sets = texts.mapInArrow(releasing(_sets_of(width, hint)), "node long, shingles binary")
    sets = sets.dropDuplicates(["node"])
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met")
    held = sets.join(placed, "node").select("node", "root", "blocks", "block", "shingles", each)
    held = held.select(
        "node", "root", "shingles",
        F.least("block", "met").alias("one"), F.greatest("block", "met").alias("two"),
        (F.col("block") > F.col("met")).cast("int").alias("side"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks)))
        .otherwise(F.xxhash64("root", F.least("block", "met"), F.greatest("block", "met")))
        .alias("task"),
    )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in group.groupby(["root", "one", "two"], sort=True):
            part = part.sort_values(["side", "node"])
            sets = [np.frombuffer(x, np.uint64).tolist() for x in part["shingles"]]
            nodes = part["node"].tolist()
            out += [(nodes[a], nodes[b]) for a, b in spanning_links(sets, part["side"].tolist(), percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = materialise(held.groupBy("task").applyInPandas(search, "a long, b long"))
    roots = components(links)
    return rows, roots.withColumnRenamed("node", "set_id")


def jaccard_components(
    df: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Texts link when ``100 * intersection >= percent * union`` of their sets of word
    shingles; ``component_id`` is the least id that links reach. Equal sets are one set
    from the first scan on. Signatures of parts (:class:`Bands`) bring every two sets that
    can link together, and parity sketches part those of them that cannot, such as texts
    with a passage in common; within what is left, :func:`divide_skip` searches inverted
    lists for sets with the required overlap, and sets that were reached leave the lists.
    Shingles and sets go by 64-bit hashes.

    A text without words, empty or missing, has no shingles and is linked with nothing,
    not even its like. Missing ids never are the least; a component of nothing else has a
    missing id. Rows with the same id keep rows of their own. An empty table gives no rows.
    """
    rows, roots = near_sets(df, width, percent, id_col, text_col)
    least = rows.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    least = materialise(least)
    named = least.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = materialise(named)
    merged = materialise(named.groupBy("root").agg(F.min("least").alias("component")))
    whole = materialise(named.join(merged, "root").select("set_id", "component"))
    joined = rows.join(whole, "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


@register(
    "op2_jaccard_join",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS ws FROM documents),
        x AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3
                THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1),
                     lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
        sh AS (SELECT DISTINCT doc_id, s FROM x),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b
              ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
              WHERE 100 * i >= 90 * (na.n + nb.n - i)),
        r AS (SELECT doc_id AS d, doc_id AS c FROM documents
              UNION SELECT e.b AS d, r.c FROM r JOIN e ON e.a = r.d)
        SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d""",
)
def op2(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir), width=3, percent=90)
