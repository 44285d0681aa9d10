"""Elias-Fano sequences over numpy arrays, searched for many keys at once."""

from __future__ import annotations

import numpy as np

_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _SELECT[_b, _k] = _p
_HALVES = [(np.uint64(w), np.uint64((1 << w) - 1)) for w in (32, 16, 8)]
#: Bits of a 64-bit window that are sure to be there when it begins inside a byte.
_SURE = 57


def _select_in(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one in each word: halves by their counts down to a byte, then a table."""
    word, k, at = word.copy(), k.copy(), np.zeros(len(word), np.int64)
    for width, mask in _HALVES:
        count = np.bitwise_count(word & mask)
        high = k >= count
        k -= np.where(high, count, 0)
        word = np.where(high, word >> width, word)
        at += np.where(high, int(width), 0)
    return at + _SELECT[(word & np.uint64(255)).astype(np.uint8), k]


class EliasFano:
    """A non-decreasing sequence: ``bits`` low bits of each value packed, the high parts in unary."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low_bits = v & np.uint64((1 << bits) - 1)
        spread = ((low_bits[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if bits else np.zeros((n, 0), np.uint8)
        low = np.concatenate([np.packbits(spread.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)])
        top = (universe >> bits) + 1
        words = -(-(n + top + 1) // 64) + 1  # the last is for windows that begin in the one before
        flags = np.zeros(words * 64, np.uint8)
        flags[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        per = 64 - np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, np.concatenate([[0], np.cumsum(per)]).astype(np.uint32 if words < 1 << 26 else np.uint64))

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th (from 0) one, or zero, in the high bits; ``zeros`` counts those before each word."""
        before = self.zeros if zeros else np.arange(len(self.zeros)) * 64 - self.zeros.astype(np.int64)
        at = np.searchsorted(before, k.astype(before.dtype), side="right") - 1
        word = self.high[at]
        return at * 64 + _select_in(~word if zeros else word, k - before[at].astype(np.int64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        window = np.lib.stride_tricks.as_strided(self.low[:8].view(np.uint64), (len(self.low) - 7,), (1,))
        return ((window[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, zeros=False) - i << self.bits) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the index of the first value >= x within its bucket or behind it, and whether it is x."""
        h = x >> self.bits
        at = np.zeros(len(x), np.int64)  # where the bucket's ones begin
        some = h > 0
        at[some] = self._select(h[some] - 1, zeros=True) + 1
        start = at - h
        window = np.lib.stride_tricks.as_strided(self.high[:1], (8 * len(self.high) - 7,), (1,))[at >> 3] >> (at & 7).astype(np.uint64)
        ones = np.bitwise_count(window & ~(window + np.uint64(1))).astype(np.int64)
        end = start + ones
        more = np.flatnonzero(ones >= _SURE)
        if len(more):
            end[more] = self._select(h[more], zeros=True) - h[more]
        low = x & ((1 << self.bits) - 1)
        lo, hi = start.copy(), end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < low[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        hit = lo < end
        hit[hit] = self._low(lo[hit]) == low[hit]
        return lo, hit

    def arrays(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.bits], np.int64), "low": self.low, "high": self.high, "zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.meta"].tolist()
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.zeros"])
