"""Online logistic mixing of hashed-context bit predictors, on arrays of n-grams.

A gram packs a byte (bits 0-7), the ORDERS bytes before it (8-47) and a hash of the word
so far (48-63) into 64 bits. A bucket holds all grams of some contexts of BUCKET_ORDER
bytes, so every longer context lies in one bucket; the shorter ones have at most 2**24
counts in all and are known to each bucket. What is counted is exact and grows with the
corpus: a context is a 56-bit hash, and its counts are never shared with another's.
"""

from __future__ import annotations

import numpy as np

from ledgerlens.llm.words import FOLD, IS_SPACE, Spans, mix, split_words

#: Longest context in bytes; there is a predictor for each length from 1 on, and one for
#: the word so far.
ORDERS = 5
INPUTS = ORDERS + 1
#: Gates: how many of the byte contexts were seen, and how often the word context was.
GATES = 4 * (ORDERS + 1)
#: Contexts of this length choose the bucket; those below it are counted apart.
BUCKET_ORDER = 3
#: What is added to the counts of zeros and ones of a node.
PRIOR = 0.02
#: Grams of one step of the mixer, and its learning rate.
STEP, RATE = 256, 0.04
#: Grams whose inputs are made at once.
PIECE = 1 << 16
BUCKETS, SPREAD = 33, 12.0
#: Pull of the mixer's own probability on the refinement of a bucket, in observations.
PULL = 20.0
END = 0xFF


def canonical(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of the canonical form of each text: its lower-cased words with
    one space between them, and END, a byte that UTF-8 does not have."""
    data = FOLD[data]
    starts, ends, rows = split_words(data, bounds)
    n, inner = len(bounds) - 1, np.zeros(len(starts), bool)
    inner[1:] = rows[1:] == rows[:-1]
    kept, gaps = ~IS_SPACE[data], starts[inner] - 1  # before a word that another one precedes
    kept[gaps], data[gaps] = True, 0x20
    size = np.bincount(rows, ends - starts + inner, minlength=n).astype(np.int64) + 1
    after = np.append(0, np.cumsum(size))
    out, own = np.full(int(after[-1]), END, np.uint8), np.ones(int(after[-1]), bool)
    own[after[1:] - 1] = False
    out[own] = data[kept]
    return out, after


def _windows(out: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each byte of canonical forms and the ORDERS bytes before it in its row, or ENDs."""
    back = np.full(len(out) + 8 + 8, END, np.uint8)  # the bytes in reverse, so that these follow
    back[: len(out)] = out[::-1]
    grams = np.empty(len(out) + 8, "<u8")
    for k in range(8):
        grams[k::8] = back[k : k + 8 * len(grams[k::8])].view("<u8")
    grams = grams[: len(out)][::-1] & np.uint64((1 << 8 * (ORDERS + 1)) - 1)
    for place in range(ORDERS):  # what lies before the row
        at = bounds[:-1][np.diff(bounds) > place] + place
        grams[at] |= np.uint64((1 << 8 * (ORDERS + 1)) - (1 << 8 * (place + 1)))
    return grams


def grams_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams and rows of the canonical form of each text."""
    out, bounds = canonical(data, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if not len(out):
        return np.zeros(0, np.uint64), row
    last = out == 0x20  # of a word and the byte next to it
    last[bounds[1:] - 1] = True
    after = np.flatnonzero(last) + 1
    begin = np.append(0, after[:-1])
    prefix = Spans(out).hash_prefixes(begin, after - begin)
    prefix >>= np.uint64(48)
    prefix <<= np.uint64(48)
    prefix[begin] = 0
    prefix |= _windows(out, bounds)
    return prefix, row


def short_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The short items (see :func:`short_items`) and rows of the grams of each text."""
    out, bounds = canonical(data, bounds)
    return short_items(_windows(out, bounds)), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def turned(grams: np.ndarray) -> np.ndarray:
    """Grams with the bytes before, nearest first, in front of the hash and the byte: sorted
    like this, equal contexts are neighbours, which compresses well."""
    low = np.uint64(0xFF)
    return (grams.byteswap() << np.uint64(8)) | (grams & low)


def turned_back(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(8)) | (keys << np.uint64(56))).byteswap()


def buckets(grams: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each gram, of so many."""
    near = (grams >> np.uint64(8)) & np.uint64((1 << 8 * BUCKET_ORDER) - 1)
    return (mix(near) % np.uint64(n)).astype(np.int64)


def short_items(grams: np.ndarray) -> np.ndarray:
    """The byte and the BUCKET_ORDER - 1 bytes before it."""
    return grams & np.uint64((1 << 8 * BUCKET_ORDER) - 1)


def _hashed(grams: np.ndarray) -> list[np.ndarray]:
    """For each context that a bucket has whole, its hash (56 bits) and the byte after it."""
    before = grams >> np.uint64(8)
    out = [before & np.uint64((1 << 8 * order) - 1) for order in range(BUCKET_ORDER, ORDERS + 1)]
    # The word so far: its hash, and its bytes as far as the window has them.
    inside, own = np.ones(len(grams), bool), np.zeros(len(grams), np.uint64)
    for k in range(ORDERS):
        byte = (before >> np.uint64(8 * k)) & np.uint64(0xFF)
        inside &= (byte != 0x20) & (byte != END)
        own |= np.where(inside, byte << np.uint64(8 * k), np.uint64(0))
    near = before & np.uint64((1 << 8 * BUCKET_ORDER) - 1)
    out.append(mix(near) ^ own ^ (grams >> np.uint64(48) << np.uint64(40)))
    last = np.uint64(0xFF)
    return [
        (mix(x ^ (np.uint64(k + 1) << np.uint64(57))) & ~last) | (grams & last)
        for k, x in enumerate(out)
    ]


def _bit(grams: np.ndarray, bit: int) -> np.ndarray:
    return ((grams >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _node_counts(items: np.ndarray, n: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones that followed each item's context and first ``bit`` bits; the items,
    a context and a byte each, are sorted, so a node is a run of them."""
    if not len(items):
        return n, n
    node = items >> np.uint64(8 - bit)
    at = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    size = np.diff(np.append(at, len(items)))
    ones = np.add.reduceat(n * _bit(items, bit), at)
    zeros = np.add.reduceat(n, at) - ones
    return np.repeat(zeros, size), np.repeat(ones, size)


class Counts:
    """Counts of the nodes of some grams: of a bucket's contexts by its own grams, and of
    the shorter contexts by ``items`` (see :func:`short_items`, sorted) and their counts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, items: np.ndarray, counts: np.ndarray):
        self.short, self.place = np.unique(short_items(grams), return_inverse=True)
        self.tables = []
        for order in range(1, BUCKET_ORDER):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            own, inverse = np.unique(items & mask, return_inverse=True)
            self.tables.append((mask, own, np.bincount(inverse, counts, minlength=len(own))))
        self.sorted = []
        for item in _hashed(grams):
            order = np.argsort(item)
            self.sorted.append((order.astype(np.int32), item[order], n[order]))

    def of(self, bit: int) -> np.ndarray:
        """Zeros and ones (2, inputs, grams) at one bit."""
        out = np.zeros((2, INPUTS, len(self.place)), np.float32)
        for k, (mask, items, n) in enumerate(self.tables):
            nodes, wanted = items >> np.uint64(8 - bit), (self.short & mask) >> np.uint64(8 - bit)
            at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
            for side, counted in zip(out, _node_counts(items, n, bit), strict=True):
                if len(nodes):
                    side[k] = np.where(nodes[at] == wanted, counted[at], 0)[self.place]
        for k, (order, items, n) in enumerate(self.sorted, len(self.tables)):
            for side, counted in zip(out, _node_counts(items, n, bit), strict=True):
                side[k, order] = counted
        return out


def _inputs(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions and a bias (inputs + 1, n), and the gate. A prediction is the
    log odds of a one, drawn to nothing where little was seen."""
    seen = zeros + ones
    odds = np.log((ones + PRIOR) / (zeros + PRIOR)) * (seen / (seen + 0.4))
    inputs = np.full((INPUTS + 1, zeros.shape[1]), 0.3, np.float32)
    inputs[:-1] = np.clip(odds, -13, 13)
    level = np.digitize(seen[-1], [0.5, 2.5, 12.5]).astype(np.int16)
    return inputs, (seen[:-1] > 0).sum(axis=0, dtype=np.int16) + np.int16(ORDERS + 1) * level


def _views(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_inputs``, in pieces, so that what is in between stays small."""
    parts = [
        _inputs(zeros[:, at : at + PIECE], ones[:, at : at + PIECE])
        for at in range(0, max(1, zeros.shape[1]), PIECE)
    ]
    return np.concatenate([x for x, _ in parts], axis=1), np.concatenate([g for _, g in parts])


def _learn(inputs, gate, one, weight, order) -> tuple[np.ndarray, np.ndarray]:
    """Weights (gates, inputs + 1) and the refinement (gates, buckets) of one bit, learnt
    online: each step is mixed with the weights that the steps before it left."""
    w = np.full((GATES, INPUTS + 1), 0.3, np.float32)
    speed = np.full_like(w, 1e-4)
    mixed = np.empty(len(order), np.float32)
    for at in range(0, len(order), STEP):
        now = order[at : at + STEP]
        x, g = inputs[:, now], gate[now]
        mixed[now] = (w[g].T * x).sum(axis=0)
        error = (one[now] - _squash(mixed[now])) * weight[now]
        slope = np.stack([np.bincount(g, error * row, minlength=GATES) for row in x], axis=1)
        slope /= np.bincount(g, weight[now], minlength=GATES)[:, None] + 1e-9
        speed += slope * slope
        w += (RATE * slope / np.sqrt(speed)).astype(np.float32)
    place, part = _bucket(mixed)
    total = np.full(GATES * BUCKETS, PULL)
    hits = np.tile(PULL * _squash(np.linspace(-SPREAD, SPREAD, BUCKETS)), GATES)
    key = gate.astype(np.int64) * BUCKETS + place
    for key, share in ((key, 1 - part), (key + 1, part)):
        hits += np.bincount(key, share * weight * one, minlength=len(hits))
        total += np.bincount(key, share * weight, minlength=len(hits))
    refined = (hits / total).reshape(GATES, BUCKETS)
    return w, refined


def log2_of(grams: np.ndarray, n: np.ndarray, items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log2 of the probability of each gram's byte after its context.

    ``grams`` are the distinct grams of a bucket and ``n`` how often each occurred in
    training texts (0: only in others); ``items`` and ``counts`` are those of the shorter
    contexts. The mixer learns from the grams with a count, each as often as it occurred and
    predicted from the counts without one of its own, so that the weights fit texts not
    seen; all are then scored with the whole counts.
    """
    known, total = Counts(grams, n, items, counts), np.zeros(len(grams))
    trained = np.flatnonzero(n > 0)
    order = np.argsort(mix(grams[trained]), kind="stable")
    weight = n[trained].astype(np.float64)
    for bit in range(8):
        one, (zeros, ones) = _bit(grams, bit), known.of(bit)
        own = one[trained]
        left = [np.maximum(x[:, trained] - y, 0) for x, y in ((zeros, ~own), (ones, own))]
        inputs, gate = _views(*left)
        del left
        w, refined = _learn(inputs, gate, own, weight, order)
        del inputs, gate
        for at in range(0, len(grams), PIECE):
            now = slice(at, at + PIECE)
            inputs, gate = _inputs(zeros[:, now], ones[:, now])
            mixed = (w[gate].T * inputs).sum(axis=0)
            place, part = _bucket(mixed)
            low = refined[gate, place]
            adapted = low + (refined[gate, place + 1] - low) * part
            p = np.clip((_squash(mixed) + adapted) / 2, 1e-6, 1 - 1e-6)
            total[now] += np.log2(np.where(one[now], p, 1 - p))
    return total


def _bucket(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.clip((mixed + SPREAD) / (2 * SPREAD) * (BUCKETS - 1), 0, BUCKETS - 1.001)
    low = place.astype(np.int64)
    return low, place - low


class Lookup:
    """Values by gram: places by hash, and what found its place taken in a further level."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.levels, factor = [], 0x9E3779B97F4A7C15
        while len(grams):
            shift = np.uint64(62 - int(len(grams)).bit_length())
            place = grams * np.uint64(factor) >> shift
            slot = np.zeros(1 << (64 - int(shift)), np.int32)
            slot[place] = np.arange(len(grams))
            self.levels.append((np.uint64(factor), shift, slot, grams, values))
            rest = grams[slot[place]] != grams
            grams, values = grams[rest], values[rest]
            factor = factor * 0xD6E8FEB86659FD93 % 2**64

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The value of each gram; all of them are known."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for factor, shift, slot, known, values in self.levels:
            at = slot[grams * factor >> shift]
            hit = known[at] == grams
            out[left[hit]] = values[at[hit]]
            left, grams = left[~hit], grams[~hit]
        return out
