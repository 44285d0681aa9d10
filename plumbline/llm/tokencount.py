"""Token counts by rank-synchronous array merging.

The distinct new pre-tokens of a batch are one ragged numpy array of symbols.  In each round
every sequence finds the pair of neighbours of the lowest rank and all sequences merge theirs at
once, every occurrence that doesn't overlap one on its left; a sequence without a pair left leaves the array, and
the symbols it still has are its count.  Sequences of over ``LONG`` bytes go by rank instead: a round takes the lowest
rank there is and merges all its pairs in all of them, found in buckets by rank, so a sequence without an end costs
no more for each byte than a short one.  As each token of a vocabulary is made by merges of lower ranks, a merge never
makes a pair of a lower rank, and merging all pairs of one rank at once is merging them one by one.  Counts of pre-tokens are remembered by worker, up to
``REMEMBERED``; that changes only speed.

Defined results: null and empty texts have 0 tokens; any length is counted whole; repeated rows
are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .vocab import NO_RANK, SPLIT, VOCABULARY, Vocabulary, vocabulary
from .work import map_arrow

REMEMBERED, BATCH_CHARS, LONG = 400_000, 1 << 20, 256
_COUNTS: dict[str, dict[str, int]] = {}


def _apart(at: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Of sorted places, those that don't overlap a chosen one on their left; ``touches``: whether each overlaps the one before it."""
    k = np.arange(len(at))
    return at[(k - np.maximum.accumulate(np.where(touches, 0, k))) % 2 == 0]


def _by_rank(symbol: np.ndarray, owner: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> None:
    """Fill ``counts`` of the owners of long sequences."""
    n = len(symbol)
    symbol = np.r_[symbol, 0]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    last = np.r_[owner[1:] != owner[:-1], True]
    after[last], before[np.r_[True, last[:-1]]] = n, -1
    rank, alive = np.full(n + 1, NO_RANK, np.int64), np.ones(n, bool)
    buckets: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def place(at: np.ndarray) -> None:
        """Put places into the buckets of their ranks."""
        rank[at] = np.where(after[at] < n, vocab.join_ranks(symbol[at], symbol[after[at]]), NO_RANK)
        at = at[rank[at] < NO_RANK]
        at = at[np.argsort(rank[at], kind="stable")]
        first = np.flatnonzero(np.r_[True, rank[at][1:] != rank[at][:-1]]) if len(at) else at
        for r, part in zip(rank[at[first]].tolist(), np.split(at, first[1:]), strict=False):
            if r not in buckets:
                buckets[r] = []
                heapq.heappush(waiting, r)
            buckets[r].append(part)

    place(np.arange(n))
    while waiting:
        r = heapq.heappop(waiting)
        at = np.unique(np.concatenate(buckets.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        at = _apart(at, np.r_[False, after[at[:-1]] == at[1:]])
        right = after[at]
        symbol[at] = r
        alive[right] = False
        after[at] = after[right]
        inner = after[at] < n
        before[after[at[inner]]] = at[inner]
        left = before[at]
        place(np.unique(np.concatenate([at, left[left >= 0]])))
    counts += np.bincount(owner[alive], minlength=len(counts))


def merge_counts(pieces: list[bytes], vocab: Vocabulary) -> np.ndarray:
    """How many symbols survive in each (non-empty) piece."""
    n = len(pieces)
    counts = np.zeros(n, np.int64)
    lengths = np.array([len(p) for p in pieces], np.int64)
    symbol = vocab.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(n), lengths)
    if not len(symbol):
        return counts
    long = (lengths > LONG)[owner]
    if long.any():
        _by_rank(symbol[long], owner[long], counts, vocab)
        symbol, owner = symbol[~long], owner[~long]
    rank = np.full(len(symbol), NO_RANK, np.int64)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    rank[inner] = vocab.join_ranks(symbol[inner], symbol[inner + 1])
    while len(symbol):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[starts, len(symbol)])
        least = np.minimum.reduceat(rank, starts)
        done = least >= NO_RANK
        counts[owner[starts[done]]] = size[done]
        if done.any():
            keep = np.repeat(~done, size)
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            size, least = size[~done], least[~done]
            if not len(symbol):
                break
        least = np.repeat(least, size)
        at = np.flatnonzero(rank == least)
        at = _apart(at, np.r_[False, np.diff(at) == 1])
        symbol[at] = least[at]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))  # where they are when the symbols merged before are gone
        symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
        last = len(symbol) - 1
        for p in (moved, moved - 1):
            p = p[(p >= 0)]
            has = (p < last) & (owner[np.minimum(p + 1, last)] == owner[p])
            rank[p[~has]] = NO_RANK
            p = p[has]
            rank[p] = vocab.join_ranks(symbol[p], symbol[p + 1])
    return counts


def count_tokens(texts: list[str | None], path: str = VOCABULARY) -> list[int]:
    vocab, known = vocabulary(path), _COUNTS.setdefault(path, {})
    out: list[int] = []
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars < BATCH_CHARS):
            chars += len(texts[hi] or "")
            hi += 1
        split = [SPLIT.findall(t) if t else [] for t in texts[lo:hi]]
        new = list({p for pieces in split for p in pieces if p not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({p for pieces in split for p in pieces})
        if new:
            known.update(zip(new, merge_counts([p.encode("utf-8", "surrogatepass") for p in new], vocab).tolist(), strict=True))
        out += [sum(map(known.__getitem__, pieces)) for pieces in split]
        lo = hi
    return out


def count_piece(piece: str, path: str = VOCABULARY) -> int:
    """Tokens of a part of a pre-token."""
    return int(merge_counts([piece.encode("utf-8", "surrogatepass")], vocabulary(path))[0])


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = count_tokens(batch.column(1).to_pylist(), path)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), fn, f"doc_id {kind}, n_tokens bigint")
