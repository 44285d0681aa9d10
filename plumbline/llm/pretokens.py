"""Pre-tokens of many texts at once, as arrays: where each begins, and how many tokens it has.

The split is that of ``vocab.SPLIT``, made from runs of characters of one class instead of a match at a time.  Equal pre-tokens
are told by a 64-bit polynomial hash of their characters and their length, so that each is merged once.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from .tokencount import merge_counts
from .vocab import NO_RANK, VOCABULARY, insert, lookup, vocabulary

LETTER, NUMBER, SPACE = 1, 2, 3
#: Slots of a worker's table of known counts, and how many are used before it is begun anew; that changes only speed.
SLOTS, REMEMBERED = 1 << 21, 700_000
BASE = np.uint64(0x9E6C63D0876A9A47)
_KNOWN: dict[str, tuple[np.ndarray, np.ndarray, list[int]]] = {}
_POWERS = [np.ones(1, np.uint64)]


@functools.cache
def classes() -> np.ndarray:
    """The class of every character; 0 for other signs."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def begins(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The places where pre-tokens begin, in the characters of texts with these bounds."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[code]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    mark = edge[:-1].copy()
    mark[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(mark)
    end = np.append(start[1:], n)
    runs, last = kind[start], edge[end]
    # white space leaves its last character to itself, or to what follows if that is a space
    after = end[(runs == SPACE) & ~last]
    mark[after - 1] = True
    mark[after[code[after - 1] == 32]] = False
    # contractions: an apostrophe alone that begins a pre-token takes one or two letters along
    k = np.flatnonzero((runs == 0) & (code[start] == 39) & (end - start == 1) & ~last & mark[start])
    k = k[runs[k + 1] == LETTER] if len(k) else k
    at, stop = end[k], end[k + 1] if len(k) else end[k]
    one = np.isin(code[at], [ord(c) for c in "stmd"])
    pair = code[at].astype(np.int64) << 32 | np.where(at + 1 < stop, code[np.minimum(at + 1, n - 1)], 0)
    two = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
    taken = np.where(one, 1, np.where(two, 2, 0))
    at, stop, taken = at[taken > 0], stop[taken > 0], taken[taken > 0]
    mark[at] = False
    rest = at + taken
    mark[rest[rest < stop]] = True
    return np.flatnonzero(mark)


def _hashes(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    length = np.diff(np.append(at, len(code)))
    if length.max() > len(_POWERS[0]):
        _POWERS[0] = np.r_[np.uint64(1), np.cumprod(np.full(int(length.max()) * 2, BASE))]
    place = np.arange(len(code)) - np.repeat(at, length)
    h = np.add.reduceat((code.astype(np.uint64) + np.uint64(1)) * _POWERS[0][place], at)
    h = (h ^ (h >> np.uint64(29)) ^ (length.astype(np.uint64) << np.uint64(40))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h[h == np.uint64(2**64 - 1)] = 0  # the table's sign for a free slot
    return h.view(np.int64)


def counted(texts: list[str | None], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each pre-token begins in the joined texts, its tokens, and the bounds of the texts."""
    bounds = np.append(0, np.cumsum(np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))))
    joined = "".join(t for t in texts if t)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = begins(code, bounds)
    if not len(at):
        return at, at, bounds
    uniq, first, which = np.unique(_hashes(code, at), return_index=True, return_inverse=True)
    if path not in _KNOWN or _KNOWN[path][2][0] + len(uniq) > REMEMBERED:
        size = max(SLOTS, 1 << (3 * len(uniq)).bit_length())
        _KNOWN[path] = np.full(size, -1, np.int64), np.zeros(size, np.int64), [0]
    table, value, used = _KNOWN[path]
    count = lookup(table, value, uniq, NO_RANK)
    new = np.flatnonzero(count == NO_RANK)
    if len(new):
        end = np.append(at[1:], len(code))
        a, b = at[first[new]].tolist(), end[first[new]].tolist()
        count[new] = merge_counts([joined[x:y].encode("utf-8", "surrogatepass") for x, y in zip(a, b, strict=True)], vocabulary(path))
        insert(table, value, uniq[new], count[new])
        used[0] += len(new)
    return at, count[which], bounds
