"""Words of text batches as 64-bit hashes, computed on whole Arrow columns at once.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Words are compared by 64-bit hash: two different words among ``n``
share one with probability below ``n * n / 2**65``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the bounds of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    width = np.int64 if column.type == pa.large_string() else np.int32
    bounds = np.frombuffer(bounds, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


class WordHasher:
    """Hashes spans of a byte array by prefix sums of a polynomial in ``_BASE``."""

    def __init__(self, lower: bool):
        rng = np.random.Generator(np.random.PCG64(20240607))
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            self.values = self.values[_lower_table()]
        self.space = np.zeros(256, bool)
        self.space[list(_SPACES)] = True
        self._grow(PIECE_BYTES)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps)
            steps[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
            self.inverse = np.cumprod(steps)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span ``data[start:end]``; the spans are in order."""
        if len(data) + 1 > len(self.powers):
            self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * self.inverse[starts]
            return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_BASE))

    def words(self, data: np.ndarray, bounds: np.ndarray):
        """(starts, ends, hashes) of all words, and the bounds of each row's words.

        The bytes are worked on in pieces that end at a space or at a row's end, so that
        memory follows ``PIECE_BYTES`` and the longest word, not the longest text.
        """
        blank = self.space[data]
        cuts = np.zeros(len(data) + 1, bool)
        cuts[bounds] = True
        starts, ends, hashes, a = [], [], [], 0
        while a < len(data):
            b = min(a + PIECE_BYTES, len(data))
            while b < len(data):
                stop = np.flatnonzero(blank[b : b + 65536] | cuts[b : b + 65536][: len(blank[b : b + 65536])])
                if len(stop):
                    b += int(stop[0])
                    break
                b = min(b + 65536, len(data))
            full = ~blank[a:b]
            edge = cuts[a:b]
            first = full.copy()
            first[1:] &= ~full[:-1] | edge[1:]
            last = full.copy()
            last[:-1] &= ~full[1:] | edge[1:]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            hashes.append(self.spans(data[a:b], s, e))
            starts.append(s + a)
            ends.append(e + a)
            a = b
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        starts = join(starts, np.int64)
        return starts, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(starts, bounds)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all ``i``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
