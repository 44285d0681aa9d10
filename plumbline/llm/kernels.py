"""Vectorised text kernels shared by the corpus operators.

Everything here works on the UTF-8 bytes of an Arrow string column: a flat
``uint8`` buffer plus row offsets, cut into slices small enough for the CPU
caches.  Words are maximal runs of bytes other than the six ASCII white-space
bytes, the same rule as ``regexp_split(text, '[ \\t\\n\\v\\f\\r]+')`` in SQL.
Word hashes are polynomials over a table of random 64-bit byte codes (mod 2**64)
computed from one prefix sum, so no Python string is ever built.

Null text counts as the empty text: it has no bytes and no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space, control bytes and ASCII punctuation: what is left are letters, digits and non-ASCII bytes.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser; a bijection of 64-bit integers for each seed."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_CODE = mix(np.arange(256, dtype=U64), 7)


class Powers:
    """Powers of an odd base and of its inverse mod 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.full(n, U64(base))
        out[0] = U64(1)
        return np.cumprod(out, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = self._grow(self.base, n), self._grow(self.inverse, n)
        return self.up, self.down


_BYTES, _WORDS = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, end row, bytes, offsets from 0) of about ``limit`` bytes.

    A row is never cut, so a slice holds at least one row of any length.
    """
    if not len(column):
        return
    buf, offsets = string_buffer(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the Latin-1 letters; the length stays."""
    out = LOWER[buf]
    if len(buf) > 1:
        after = np.flatnonzero(buf[:-1] == 0xC3) + 1
        upper = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97)]
        out[upper] += 0x20
    return out


def word_spans(
    buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and row of every word; ``breaks`` marks the bytes between words."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    space = (SPACE if breaks is None else breaks)[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[0] = after[-1] = True
    firsts, lasts = offsets[:-1], offsets[1:]
    before[firsts[firsts < n]] = True
    after[lasts[lasts > 0] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return start, end, np.searchsorted(lasts, start, side="right")


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by its content alone."""
    up, down = _BYTES.upto(len(buf) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(buf) + 1, U64)
        np.cumsum(BYTE_CODE[buf] * up[: len(buf)], out=prefix[1:])
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def words(
    buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte, row and hash of every word."""
    start, end, row = word_spans(buf, offsets, breaks)
    return start, end, row, span_hashes(buf, start, end)


def window_hashes(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every window of ``k`` words inside one row."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = _WORDS.upto(len(hashes) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(hashes) + 1, U64)
        np.cumsum(hashes * up[: len(hashes)], out=prefix[1:])
        at = np.flatnonzero(row[:m] == row[k - 1 :])
        return at, mix((prefix[at + k] - prefix[at]) * down[at], 3)


def range_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range of words, of any length, by its content alone."""
    up, down = _WORDS.upto(len(hashes) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(hashes) + 1, U64)
        np.cumsum(hashes * up[: len(hashes)], out=prefix[1:])
        return mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(U64), 5)


def row_starts(row: np.ndarray, rows: int) -> np.ndarray:
    """For sorted ``row``: where each of ``rows`` rows begins, with the total at the end."""
    return np.searchsorted(row, np.arange(rows + 1))


def distinct_words(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows and 48-bit hashes of the distinct words of each row (a slice has fewer than 65,536 rows)."""
    key = np.sort((row.astype(U64) << U64(48)) | (hashes >> U64(16)))
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return (key >> U64(48)).astype(np.int64), key & U64((1 << 48) - 1)
