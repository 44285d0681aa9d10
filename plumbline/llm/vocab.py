"""Rank files of byte-level BPE and the split of text into pre-tokens.

The vocabulary file is a parameter; each Python worker reads it once.  A token's rank is its id.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import regex

#: A public byte-level vocabulary; never copied, read from where it is.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Pre-tokens: contractions, words and numbers with an optional space before, runs of other signs, white space.
SPLIT = regex.compile(
    r"'(?:[stmd]|re|ve|ll)"
    r"| ?\p{L}+| ?\p{N}+"
    r"| ?[^\s\p{L}\p{N}]+"
    r"|\s+(?!\S)|\s+"
)


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            parts = (line.split() for line in lines if line.strip())
            self.rank: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in parts}
        self.size = max(self.rank.values()) + 1
        self.token: list[bytes] = [b""] * self.size
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.longest = max(map(len, self.rank))

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """An open-addressed table of (left << 32 | right) and the rank of the two joined."""
        keys, ranks = [], []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank)
        return _filled(np.array(keys, np.int64), np.array(ranks, np.int64))

    def join_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair joined, NO_RANK where it is no token."""
        return _lookup(*self.pairs, left << 32 | right, NO_RANK)

    @functools.cached_property
    def by_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """An open-addressed table of the polynomial hashes of tokens of up to SHORT bytes, and their ids."""
        short = [t for t in self.rank if len(t) <= SHORT]
        key = np.array([poly_hash(t) for t in short], np.uint64).view(np.int64)
        if len(np.unique(key)) < len(key):
            raise ValueError("two tokens have one hash")
        return _filled(key, np.array([self.rank[t] for t in short], np.int64))

    def find_hashes(self, key: np.ndarray) -> np.ndarray:
        """The token of each hash, -1 where there is none."""
        return _lookup(*self.by_hash, key, -1)

    @functools.cached_property
    def halves(self) -> list[tuple[int, int]]:
        """For each token the two it is merged from last; (itself, itself) for a byte."""
        out = [(i, i) for i in range(self.size)]
        for token, rank in self.rank.items():
            if len(token) > 1:
                parts = [self.rank[bytes([b])] for b in token]
                while len(parts) > 2:
                    best = min(range(len(parts) - 1), key=lambda k: self._joined(parts[k], parts[k + 1], rank))
                    parts[best : best + 2] = [self._joined(parts[best], parts[best + 1], rank)]
                    if parts[best] >= NO_RANK:
                        raise ValueError(f"token {rank} isn't made by merges of lower ranks")
                out[rank] = (parts[0], parts[1])
        return out

    def _joined(self, a: int, b: int, below: int) -> int:
        r = self.rank.get(self.token[a] + self.token[b], NO_RANK)
        return r if r < below else NO_RANK


NO_RANK = 1 << 40


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def insert(table: np.ndarray, value: np.ndarray, key: np.ndarray, what: np.ndarray) -> None:
    """Put distinct new keys into an open-addressed table with room for them."""
    slot = _slot(key, len(table))
    while len(key):
        free = table[slot] == -1
        table[slot[free]] = key[free]  # of several keys for one slot the last stays
        mine = table[slot] == key
        value[slot[mine]] = what[mine]
        key, what, slot = key[~mine], what[~mine], (slot[~mine] + 1) & (len(table) - 1)


def _filled(key: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << (4 * max(len(key), 1) - 1).bit_length()
    table, value = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    insert(table, value, key, what)
    return table, value


def _lookup(table: np.ndarray, value: np.ndarray, key: np.ndarray, missing: int) -> np.ndarray:
    slot = _slot(key, len(table))
    found = table[slot]
    hit = found == key
    out = np.where(hit, value[slot], missing)
    rest = np.flatnonzero(~hit & (found != -1))
    while len(rest):
        slot[rest] = (slot[rest] + 1) & (len(table) - 1)
        found = table[slot[rest]]
        hit = found == key[rest]
        out[rest[hit]] = value[slot[rest[hit]]]
        rest = rest[~hit & (found != -1)]
    return out


lookup = _lookup
HASH_BASE, SHORT = 0xD1342543DE82EF95, 24


def poly_hash(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * HASH_BASE + b + 1) & (2**64 - 1)
    return h


@functools.lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)
