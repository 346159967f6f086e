"""Elias-Fano sequences and bit-packed arrays that are queried as they lie in a memory map, many queries at once; nothing is unfolded.

A sequence of n values below a universe u: the low bits of each value packed, the rest as unary gaps in n + u / 2^low bits, with the number of ones and
zeros before each 64-bit word as directories. Value i is found by select; the successor of x by the two zeros that bound the values of its high part, and
a search among these values' low bits.
"""

from __future__ import annotations

import numpy as np

_W = np.uint64
_ONES = [_W(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080)]
#: Place of the k-th set bit of a byte.
_PLACE = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint64).reshape(-1)


def select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of each 64-bit word."""
    a5, a3, a0, a1, a8 = _ONES
    b = x - ((x >> _W(1)) & a5)
    b = (b & a3) + ((b >> _W(2)) & a3)
    upto = ((b + (b >> _W(4))) & a0) * a1  # bits in each byte and those below it
    byte = np.bitwise_count((((k * a1) | a8) - upto) & a8).astype(np.uint64) << _W(3)
    rest = k - (((upto << _W(8)) >> byte) & _W(255))
    return byte + _PLACE[(((x >> byte) & _W(255)) << _W(3)) | rest]


def packed(x: np.ndarray, width: int) -> np.ndarray:
    """Values below 2^width in `width` bits each, lowest bit first, as 64-bit words and one more."""
    out = np.zeros(len(x) * width // 64 + 2, np.uint64)
    if width and len(x):
        at = np.arange(len(x), dtype=np.uint64) * _W(width)
        word, shift = (at >> _W(6)).astype(np.int64), at & _W(63)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] = np.bitwise_or.reduceat(x << shift, first)
        over = np.flatnonzero(shift + _W(width) > _W(64))
        out[word[over] + 1] |= x[over] >> (_W(64) - shift[over])
    return out


def unpacked(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    """The values at places i of a packed array."""
    if not width:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.uint64) * _W(width)
    word, shift = (at >> _W(6)).astype(np.int64), at & _W(63)
    got = (words[word] >> shift) | ((words[word + 1] << _W(1)) << (_W(63) - shift))
    return got & _W((1 << width) - 1)


def encoded(x: np.ndarray, universe: int) -> bytes:
    """A sorted sequence of unsigned 64-bit integers below `universe`; a multiple of 8 bytes."""
    n = len(x)
    low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    zeros = ((universe - 1) >> low) + 1 if universe > 0 else 1
    size = -(-(n + zeros) // 64)
    upper = np.zeros(size, np.uint64)
    if n:
        at = (x >> _W(low)).astype(np.int64) + np.arange(n)
        word = at >> 6
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        upper[word[first]] = np.bitwise_or.reduceat(_W(1) << (at & 63).astype(np.uint64), first)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(upper).astype(np.int64))))[:-1]
    none = np.arange(size, dtype=np.int64) * 64 - ones
    head = np.array([n, low, size, len(x) * low // 64 + 2], "<u8").tobytes()
    pad = b"\0" * (4 * (size % 2))
    return head + upper.tobytes() + ones.astype("<u4").tobytes() + pad + none.astype("<u4").tobytes() + pad + packed(x & _W((1 << low) - 1), low).tobytes()


class EliasFano:
    """A coded sequence in a byte map from `at` on; `end` is where it ends. The coded words are views of the map."""

    def __init__(self, data: np.ndarray, at: int = 0):
        n, low, size, lows = (int(v) for v in np.frombuffer(data, "<u8", 4, at))
        self.n, self.low = n, low
        at += 32
        self.upper = np.frombuffer(data, "<u8", size, at)
        at += 8 * size
        self.ones = np.frombuffer(data, "<u4", size, at)
        at += 4 * (size + size % 2)
        self.zeros = np.frombuffer(data, "<u4", size, at)
        at += 4 * (size + size % 2)
        self.lows = np.frombuffer(data, "<u8", lows, at)
        self.end = at + 8 * lows

    def _select(self, directory: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(directory, k.astype(np.uint32), "right") - 1
        x = self.upper[word]
        return (word.astype(np.uint64) << _W(6)) + select_in_word(~x if flip else x, k - directory[word].astype(np.uint64))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i, each below n."""
        i = i.astype(np.uint64)
        return ((self._select(self.ones, i, False) - i) << _W(self.low)) | unpacked(self.lows, i, self.low)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value at or above x (n if there is none), and whether it is x; each x below the universe."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = x >> _W(self.low)
        after = self._select(self.zeros, high, True) - high  # values of this high part end here
        lo = np.zeros(len(x), np.uint64)
        some = high > 0
        lo[some] = self._select(self.zeros, high[some] - _W(1), True) + _W(1) - high[some]
        lo, end, want = lo.astype(np.int64), after.astype(np.int64), x & _W((1 << self.low) - 1)
        hi, live = end.copy(), np.flatnonzero(lo < end)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = unpacked(self.lows, mid, self.low) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        hit = np.zeros(len(x), bool)
        some = np.flatnonzero(lo < end)
        hit[some] = unpacked(self.lows, lo[some], self.low) == want[some]
        return lo, hit
