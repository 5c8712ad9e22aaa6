"""Words, lines and their hashes for whole Arrow batches, as numpy arrays over UTF-8 bytes.

All separators are ASCII, so splitting bytes equals splitting characters. Hashes are 64
bits of a polynomial over random byte values, mixed; one prefix sum serves every span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes; one longer text is one slice.
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_powers: list[np.ndarray] = []


def byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode("ascii"))] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on unsigned 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES) + 1
        made = []
        for base in (_P, pow(_P, -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n > 4 * SLICE_BYTES:  # a rare long text must not leave its tables behind
            return made
        _powers[:] = made
    return _powers


class Spans:
    """Hashes of byte spans of ``data``."""

    def __init__(self, data: np.ndarray):
        self.up, down = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * down[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        # The tables hold inverse powers, so multiplying moves a span back to place 0.
        raw = (self.sums[ends] - self.sums[starts]) * self.up[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hash_prefixes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each byte, the hash of the bytes before it in its span; the spans follow each
        other and cover all bytes."""
        n = len(self.sums) - 1
        raw = (self.sums[:-1] - np.repeat(self.sums[starts], sizes)) * np.repeat(self.up[starts], sizes)
        raw += (np.arange(n) - np.repeat(starts, sizes)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(raw)


def slices(
    column: pa.Array, size: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, row bounds)`` for consecutive rows; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


def row_of(bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, places, "right") - 1


def split_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words."""
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True  # a row boundary ends a word as white space does
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, row_of(bounds, starts)


def split_lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (without the line feed) and rows of all lines; an empty text has one."""
    feeds = np.flatnonzero(data == 10)
    rows = np.arange(len(bounds) - 1)
    starts = np.concatenate([bounds[:-1], feeds + 1])
    ends = np.concatenate([feeds, bounds[1:]])
    row = np.concatenate([rows, row_of(bounds, feeds)])
    order = np.lexsort((starts, row))
    # Ends sort alike: the k-th line of a row ends where its k-th end is.
    row_ends = np.concatenate([row_of(bounds, feeds), rows])
    return starts[order], ends[np.lexsort((ends, row_ends))], row[order]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: key held by two or more places; key held by an earlier place too."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return any_, later


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all windows of ``width`` words inside a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    value = hashes[:n].copy()
    for k in range(1, width):
        value = mix(value * np.uint64(_P)) + hashes[k : n + k]
    inside = rows[:n] == rows[width - 1 :]
    return mix(value[inside]), rows[:n][inside]


def totals(mask_or_values: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero, to count inside spans."""
    out = np.zeros(len(mask_or_values) + 1, np.int64)
    np.cumsum(mask_or_values, out=out[1:])
    return out
