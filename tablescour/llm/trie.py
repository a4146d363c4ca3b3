"""Two-level n-gram trie in Elias-Fano levels that are mapped, not loaded.

Level 1 holds contexts, as sorted 64-bit word hashes; a monotone pointer sequence gives
each context's range in level 2. Level 2 holds the successors of every context: their
ranks in the trie's successor vocabulary, each raised by its context's number times the
size of that vocabulary, so the whole level is one monotone sequence. A successor is
looked for in its context's range only. Beside the levels stand quantised values: counts
and successor numbers of contexts, and discounted counts of successors, as codes of
their logarithms. Counts have no ceiling: a pair count above the range of the codes is
kept exactly in a sorted list of places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FINE = 2048  # codes to a power of two at level 1
EXACT_CODES, STEPS = 16, 12  # at level 2: counts up to 16 as they are, then 12 codes to a power of two
OVER = 255  # the code of pairs whose counts are kept exactly


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers.

    Low bits are packed; the high parts are a bitmap with a one per entry after as many
    zeros as the high part says. About ``2 + log2(universe / n)`` bits an entry.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._ones = self._first = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(2, np.uint64), np.zeros(1, np.uint8))
        bits = max(0, int(values[-1]).bit_length() - n.bit_length())
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = (values >> np.uint64(bits)).astype(np.int64)
        bitmap = np.zeros(int(top[-1]) + n + 1, np.uint8)
        bitmap[top + np.arange(n)] = 1
        return cls(n, bits, low, np.packbits(bitmap, bitorder="little"))

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        place = at.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        out = self.low[word] >> shift
        carry = shift > 0
        out[carry] |= self.low[word[carry] + 1] << (np.uint64(64) - shift[carry])
        return out & np.uint64((1 << self.bits) - 1)

    def _open(self) -> None:
        bitmap = np.unpackbits(self.high, bitorder="little")
        self._ones = np.flatnonzero(bitmap)[: self.n]
        tops = self._ones - np.arange(self.n)
        size = int(tops[-1]) + 1 if self.n else 0
        self._first = np.concatenate([[0], np.cumsum(np.bincount(tops, minlength=size))])

    def at(self, index: np.ndarray) -> np.ndarray:
        if self._ones is None:
            self._open()
        top = (self._ones[index] - index).astype(np.uint64)
        return top << np.uint64(self.bits) | self.lows(index)

    def find(self, values: np.ndarray, start=None, stop=None) -> np.ndarray:
        """Place of the first entry not below each value, between ``start`` and ``stop``."""
        if self._ones is None:
            self._open()
        last = len(self._first) - 1
        top = np.minimum(values >> np.uint64(self.bits), np.uint64(last)).astype(np.int64)
        lo, hi = self._first[top], self._first[np.minimum(top + 1, last)]
        if start is not None:
            lo, hi = np.clip(lo, start, stop), np.clip(hi, start, stop)
        want = values & np.uint64((1 << self.bits) - 1)
        lo = lo.copy()
        hi = hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            below = self.lows(mid) < want[todo]
            lo[todo[below]] = mid[below] + 1
            hi[todo[~below]] = mid[~below]
            todo = todo[lo[todo] < hi[todo]]
        return lo

    def index(self, values: np.ndarray, start=None, stop=None) -> np.ndarray:
        """Place of each value, or -1."""
        if not self.n or not len(values):
            return np.full(len(values), -1)
        place = self.find(values, start, stop)
        inside = place < (self.n if stop is None else stop)
        there = np.minimum(place, self.n - 1)
        return np.where(inside & (self.at(there) == values), place, -1)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high]


def code_fine(counts: np.ndarray) -> np.ndarray:
    """Codes of counts: 0 for 0, else of the logarithm; below 2**32 they have 16 bits."""
    codes = np.rint(np.log2(np.maximum(counts, 1)) * FINE).astype(np.int64) + 1
    return np.where(counts > 0, codes, 0).astype(np.uint32)


def value_fine(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 2.0 ** ((codes.astype(np.float64) - 1) / FINE), 0.0)


def code_coarse(counts: np.ndarray) -> np.ndarray:
    """8-bit codes of counts from 1; 0 means none, ``OVER`` that the count is kept exactly."""
    above = EXACT_CODES + np.rint(np.log2(np.maximum(counts, 1) / EXACT_CODES) * STEPS)
    return np.where(counts <= EXACT_CODES, counts, np.minimum(above, OVER)).astype(np.uint8)


def value_coarse(codes: np.ndarray, discount: float, over=None) -> np.ndarray:
    """Discounted counts; ``over``: the exact counts of codes ``OVER``, in their order."""
    codes = codes.astype(np.float64)
    counts = np.where(codes <= EXACT_CODES, codes, EXACT_CODES * 2.0 ** ((codes - EXACT_CODES) / STEPS))
    if over is not None:
        counts[codes == OVER] = over
    return np.maximum(counts - discount, 0.0)


class Trie:
    """Level 1: ``contexts`` with ``pointers``, ``counts`` and the codes ``mass`` (count)
    and ``width`` (number of successors). Level 2: ``successors`` over the vocabulary
    ``words``, with the codes ``joint``, and the exact counts ``over`` at ``places``."""

    LEVELS = ("contexts", "pointers", "words", "successors")
    VALUES = (("counts", np.int64), ("mass", np.uint32), ("width", np.uint16), ("joint", np.uint8),
              ("places", np.int64), ("over", np.int64))

    def __init__(self, levels: list[EliasFano], values: list[np.ndarray]):
        self.contexts, self.pointers, self.words, self.successors = levels
        self.counts, self.mass, self.width, self.joint, self.places, self.over = values

    @classmethod
    def build(cls, contexts, counts, first, second, pairs) -> Trie:
        """From sorted contexts with counts, and successor rows (first, second, pairs):
        number of the context, word hash, count; equal rows are summed."""
        words = np.unique(second)
        span = np.uint64(max(1, len(words)))
        keys = first.astype(np.uint64) * span + np.searchsorted(words, second).astype(np.uint64)
        keys, back = np.unique(keys, return_inverse=True)
        sums = np.bincount(back, pairs, len(keys)).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        owner = (keys // span).astype(np.int64)
        widths = np.bincount(owner, minlength=len(contexts)) if len(contexts) else np.zeros(0, np.int64)
        pointers = np.concatenate([[0], np.cumsum(widths)]).astype(np.uint64)
        levels = [EliasFano.encode(x) for x in (contexts, pointers, words, keys)]
        joint = code_coarse(sums)
        places = np.flatnonzero(joint == OVER)
        width = code_fine(widths).astype(np.uint16)  # a shard in memory has fewer than 2**32 successors
        return cls(levels, [counts.astype(np.int64), code_fine(counts), width, joint, places, sums[places]])

    def write(self, stream) -> None:
        """Arrays one after another, each behind its length and on an eight-byte bound."""
        arrays = [p for x in self.LEVELS for p in getattr(self, x).parts()]
        arrays += [getattr(self, x) for x, _ in self.VALUES]
        for array in arrays:
            raw = array.tobytes()
            stream.write(np.int64(len(raw)).tobytes() + raw + b"\0" * (-len(raw) % 8))

    @classmethod
    def open(cls, file: pa.NativeFile) -> Trie:
        """The trie of a file; of a mapped file, pages are read as they are asked for."""

        def array(kind):
            size = int(np.frombuffer(file.read_buffer(8), np.int64)[0])
            out = np.frombuffer(file.read_buffer(size), kind)
            file.read_buffer(-size % 8)
            return out

        levels = []
        for _ in cls.LEVELS:
            n, bits = array(np.int64).tolist()
            levels.append(EliasFano(n, bits, array(np.uint64), array(np.uint8)))
        return cls(levels, [array(kind) for _, kind in cls.VALUES])

    def joints(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs of a context's number (-1: none) and a word hash."""
        return self.pairs(context, word)[0]

    def pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes as of ``joints``, and the exact counts of those that are ``OVER``."""
        out, over = np.zeros(len(context), np.uint8), np.zeros(0, np.int64)
        rank = self.words.index(word)
        known = np.flatnonzero((context >= 0) & (rank >= 0))
        if not len(known):
            return out, over
        own = context[known]
        start = self.pointers.at(own).astype(np.int64)
        stop = self.pointers.at(own + 1).astype(np.int64)
        value = own.astype(np.uint64) * np.uint64(max(1, self.words.n)) + rank[known].astype(np.uint64)
        place = self.successors.index(value, start, stop)
        there = place >= 0
        place = place[there]
        out[known[there]] = self.joint[place]
        return out, self.over[np.searchsorted(self.places, place[self.joint[place] == OVER])]
