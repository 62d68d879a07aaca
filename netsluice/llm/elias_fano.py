"""Elias-Fano coding of monotone sequences, with vectorised access and successor search.

A sequence of n values below u keeps log2(u / n) low bits of each value side by side, and the high bits
in unary: value i sets bit (value >> low) + i. A directory holds the number of ones before each 64-bit
word. All arrays can be memory-mapped.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
_PAIRS, _FOURS, _EIGHTS, _EACH, _TOPS = (np.uint64(0x0101010101010101 * x) for x in (0x55, 0x33, 0x0F, 1, 0x80))
_B1, _B2, _B3, _B4, _B8 = (np.uint64(x) for x in (1, 2, 3, 4, 8))
_BYTE, _LAST = np.uint64(255), np.uint64(63)
#: The place of one number k (from 0) in a byte b, at 8 * b + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).ravel()


def _select_in_words(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of one number ``rank`` (from 0) in each 64-bit word: its byte by sums of the bytes' ones, then by a table."""
    rank = rank.astype(np.uint64)
    sums = words - ((words >> _B1) & _PAIRS)
    sums = (sums & _FOURS) + ((sums >> _B2) & _FOURS)
    sums = ((sums + (sums >> _B4)) & _EIGHTS) * _EACH  # byte i: the ones of the bytes up to i
    shift = np.bitwise_count(((rank * _EACH | _TOPS) - sums) & _TOPS).astype(np.uint64) << _B3
    rank -= ((sums << _B8) >> shift) & _BYTE
    return (shift + _IN_BYTE[(((words >> shift) & _BYTE) << _B3) + rank]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.mask = np.uint64((1 << low_bits) - 1)
        self.zeros = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        b = np.uint64(low_bits)
        low = np.zeros((n * low_bits + 63) // 64 + 2, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.uint64) * b
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + b > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        bits = np.zeros(((n + (top >> low_bits) + 2 + 63) // 64) * 64, np.uint8)
        bits[((values >> b).astype(np.int64) + np.arange(n)) if n else []] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(high).astype(np.int64)
        return cls(n, low_bits, low, high, np.concatenate([[0], np.cumsum(counts)]))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"shape": np.array([self.n, self.low_bits], np.int64), "low": self.low, "high": self.high, "ones": self.ones}

    @classmethod
    def open(cls, a: dict[str, np.ndarray], prefix: str) -> EliasFano:
        n, low_bits = (int(x) for x in a[prefix + "shape"])
        return cls(n, low_bits, a[prefix + "low"], a[prefix + "high"], a[prefix + "ones"])

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & _LAST
        return ((self.low[word] >> shift) | (self.low[word + 1] << (_LAST - shift) << ONE)) & self.mask

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at some places, each from 0 to n - 1."""
        at = np.asarray(at, np.int64)
        word = np.searchsorted(self.ones, at, side="right") - 1
        bit = word * 64 + _select_in_words(self.high[word], at - self.ones[word])
        return ((bit - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def _before(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values have high bits below ``high`` (the ones before zero number high - 1), and the bit behind that zero."""
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        total = int(self.zeros[-1])
        zero = np.clip(high - 1, 0, total - 1)
        word = np.searchsorted(self.zeros, zero, side="right") - 1
        bit = word * 64 + _select_in_words(~self.high[word], zero - self.zeros[word])
        low, beyond = high <= 0, high > total
        return np.where(low, 0, np.where(beyond, self.n, bit - zero)), np.where(low, 0, np.where(beyond, len(self.high) * 64, bit + 1))

    def _range(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values with these high bits: a run of ones, mostly within one 64-bit word."""
        lo, bit = self._before(high)
        word, shift = np.minimum(bit >> 6, len(self.high) - 1), (bit & 63).astype(np.uint64)
        rest = ~(self.high[word] >> shift)
        run = np.bitwise_count((rest & (~rest + ONE)) - ONE).astype(np.int64)
        hi = lo + run
        over = np.flatnonzero((run + shift.astype(np.int64) >= 64) | (bit >> 6 >= len(self.high)))
        if len(over):
            hi[over] = self._before(high[over] + 1)[0]
        return lo, hi

    def _first(self, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first of the places from lo to hi, of equal high bits, whose low bits are not below those wanted; hi if none."""
        lo, hi = lo.copy(), hi.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            below = self._low(mid) < want[active]
            lo[active[below]] = mid[below] + 1
            hi[active[~below]] = mid[~below]
            active = active[lo[active] < hi[active]]
        return lo

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The first place whose value is not below each given value; n if none."""
        values = np.asarray(values, np.uint64)
        lo, hi = self._range((values >> np.uint64(self.low_bits)).astype(np.int64))
        return self._first(lo, hi, values & self.mask)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The first place of each value, -1 where it is not in the sequence."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1)
        if not self.n or not len(values):
            return out
        lo, end = self._range((values >> np.uint64(self.low_bits)).astype(np.int64))
        some = np.flatnonzero(lo < end)
        lo, end, want = lo[some], end[some], values[some] & self.mask
        low = self._low(lo)  # few values have the same high bits: mostly the first place tells
        hit = low == want
        out[some[hit]] = lo[hit]
        more = np.flatnonzero((low < want) & (lo + 1 < end))
        if len(more):
            at = self._first(lo[more] + 1, end[more], want[more])
            more, at = more[at < end[more]], at[at < end[more]]
            hit = self._low(at) == want[more]
            out[some[more[hit]]] = at[hit]
        return out
