"""Whole texts as flat arrays: words, word hashes and shingle hashes of many documents at once.

The functions run inside tasks on Arrow batches. Words are found in the UTF-8 bytes, where every
separator used here is a single ASCII byte. Hashes have 64 bits; a word's hash depends on its bytes
alone, so the same word has the same hash in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20  # bytes hashed at once; longer documents go through in several steps
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(count: int, seed: int) -> np.ndarray:
    """Fixed odd pseudo-random multipliers."""
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_BASE)
    return mix(steps + mix(np.array([seed], dtype=np.uint64))) | np.uint64(1)


def _table(accept) -> np.ndarray:
    return np.array([accept(b) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
# Words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = _table(lambda b: b != 32 and not 9 <= b <= 13)
# Words of digits, letters and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (lower case)
ALNUM = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows in them. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0 or pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)
    bounds = bounds[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    raw = raw[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes together; one longer document is a run alone."""
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def ids(column: pa.Array) -> np.ndarray:
    """Integer ids as int64; call only on columns without nulls."""
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.int64)


class Words:
    """Finds and hashes the words of documents."""

    def __init__(self, kind: np.ndarray = SPACED, lower: bool = True):
        self.kind, self.lower = kind, lower
        self.salt = numbers(256, 11)
        self._tables(PIECE_BYTES)

    def _tables(self, size: int) -> None:
        steps = np.full(size + 1, _BASE, np.uint64)
        back = np.full(size + 1, _BASE_INVERSE, np.uint64)
        steps[0] = back[0] = 1
        self.power, self.inverse = np.cumprod(steps), np.cumprod(back)

    def find(self, data: np.ndarray, bounds: np.ndarray):
        """Lower-cased bytes, starts and ends of the words, and each document's range of words."""
        low = LOWER[data] if self.lower else data
        word = self.kind[low]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        return low, starts, ends, np.searchsorted(starts, bounds)

    def hash(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes between each start and end (ends must not fall)."""
        return self.hash_prefixes(low, starts, ends, ())[0]

    def hash_prefixes(
        self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]
    ) -> list[np.ndarray]:
        """The hashes of the words, then of their first ``sizes`` bytes (of the word, if shorter)."""
        out = [np.empty(len(starts), np.uint64) for _ in range(len(sizes) + 1)]
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, "right")))
            base, size = starts[i], int(ends[j - 1] - starts[i])
            if size >= len(self.power):
                self._tables(size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(self.salt[low[base : base + size]] * self.power[:size], out=sums[1:])
            a, b = starts[i:j] - base, ends[i:j] - base
            begin, back = sums[a], self.inverse[a]
            out[0][i:j] = (sums[b] - begin) * back
            for values, width in zip(out[1:], sizes):
                values[i:j] = (sums[np.minimum(a + width, b)] - begin) * back
            i = j
        return [mix(values) for values in out]


def shingles(words: np.ndarray, ranges: np.ndarray, size: int = 5):
    """Hashes of all runs of ``size`` words inside a document, in order, and each document's range.

    A document with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    factors = numbers(size, 23)
    counts = np.diff(ranges)
    total = len(words)
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ranges), np.int64)
    values = np.zeros(total, np.uint64)
    for j in range(min(size, total)):
        values[: total - j] += words[j:] * factors[j]
    keep = np.ones(total, bool)
    for j in range(1, size):
        cut = ranges[1:] - j
        keep[cut[cut >= ranges[:-1]]] = False
    short = np.flatnonzero((counts > 0) & (counts < size))
    for d in short:
        a, n = int(ranges[d]), int(counts[d])
        values[a : a + 1] = (words[a : a + n] * factors[:n]).sum(keepdims=True)
        values[a : a + 1] += np.uint64(n * _BASE & (1 << 64) - 1)
        keep[a] = True
    kept = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.zeros(len(ranges), np.int64)
    np.cumsum(kept, out=out[1:])
    return mix(values[keep]), out


def range_of(values: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges hashes fall into, by the 24 bits above the low 40."""
    return ((values >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.uint16)


def by_range(values: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """The ranges of sorted hashes: number, begin and end."""
    part = range_of(values, parts).astype(np.int32)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(at, [*at[1:], len(part)]):
        yield int(part[a]), int(a), int(b)


def in_range(values: np.ndarray, parts: int) -> np.ndarray:
    """Hashes as their range above the low 40 bits, as packed rows tell them."""
    low = values & np.uint64((1 << 40) - 1)
    return low | range_of(values, parts).astype(np.uint64) << np.uint64(40)


def pack_low(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_low(raw, width: int) -> np.ndarray:
    """The reverse of :func:`pack_low`."""
    rows = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :width] = rows
    return out.view("<u8").ravel()
