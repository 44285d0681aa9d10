"""Language-model scoring with an Elias-Fano n-gram trie.

Words are counted over all documents; those seen less than ``MIN_COUNT`` times are one unknown word.  The
others are numbered by the order of their hashes.  Bigrams and trigrams are counted over
all documents too: each task sends, for each shard, one compressed block of its sorted n-grams.
A shard holds the n-grams whose first two words hash to it, so no frequent word makes a
large one, and it is a trie of three levels:

    words that start a bigram here -> second words -> third words

The children of a level are one Elias-Fano sequence ``context * V + child`` with monotone
Elias-Fano pointers to the first child of each context; a child is found by a successor search
relative to its context.  Beside them lie the smoothed probabilities, quantised to 8 bits:
absolute discounting, p(w|uv) = max(c - D, 0) / c(uv) + b(uv) p(w|v), where b(uv) is
the mass left by what is kept (n-grams seen less than ``PRUNE`` times aren't).  Shards are files
in the shared folder, written under another name and moved, and memory-mapped by the workers.

Defined results: null and empty texts have 0 words, log_prob 0 and no perplexity; the first words of a
document are scored with what context there is; any length is scored whole; repeated rows
count and are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import os
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .eliasfano import EliasFano
from .work import map_arrow, saved, shared_path

MIN_COUNT, PRUNE, DISCOUNT = 2, 2, 0.75
VOCAB_SHARDS, SHARD_WORDS, SLICE, BATCH_ROWS = 64, 1_500_000, (2 << 20) - 2, 1 << 20
#: Bundles that a worker holds in memory where they can't be mapped; the oldest goes first.
HELD = 128
FLOOR = -24.0


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 for probabilities in logarithmic steps, 0 for none."""
    with np.errstate(divide="ignore"):
        code = 255 + np.round(np.log(p) * (254 / -FLOOR))
    return np.where(p > 0, np.clip(code, 1, 255), 0).astype(np.uint8)


VALUE = np.concatenate([[0.0], np.exp((np.arange(1, 256) - 255) * (-FLOOR / 254))])


class Store:
    """Named bundles of arrays in the shared folder; mapped if it is a mounted one, else read."""

    def __init__(self, uri: str) -> None:
        self.uri, self.cache = uri, {}

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        head, at, body = {}, 0, []
        for key, a in arrays.items():
            raw = np.ascontiguousarray(a).tobytes()
            pad = -len(raw) % 8
            head[key] = (a.dtype.str, len(a), at)
            body += [raw, b"\0" * pad]
            at += len(raw) + pad
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path, recursive=True)
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(len(text).to_bytes(8, "little") + text)
            for raw in body:
                out.write(raw)
        system.move(part, f"{path}/{name}")

    def read(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.cache:
            system, path = fs.FileSystem.from_uri(self.uri)
            full = f"{path}/{name}"
            if isinstance(system, fs.LocalFileSystem):
                raw = np.memmap(full, np.uint8, "r") if os.path.exists(full) else None
            else:
                info = system.get_file_info(full)
                raw = np.frombuffer(system.open_input_file(full).read(), np.uint8) if info.is_file else None
                while len(self.cache) >= HELD:
                    self.cache.pop(next(iter(self.cache)))
            out = {}
            if raw is not None:
                n = int.from_bytes(raw[:8].tobytes(), "little")
                for key, (kind, count, at) in json.loads(raw[8 : 8 + n].tobytes()).items():
                    size = count * np.dtype(kind).itemsize
                    out[key] = np.asarray(raw[8 + n + at : 8 + n + at + size]).view(kind)
            self.cache[name] = out
        return self.cache[name]


_STORES: dict[str, Store] = {}


def store(uri: str) -> Store:
    if uri not in _STORES:
        _STORES.clear()
        _STORES[uri] = Store(uri)
    return _STORES[uri]


def _vocab_shard(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - VOCAB_SHARDS.bit_length() + 1)).astype(np.int64)


class Words:
    """Word numbers, counts and back-off weights by the hash of the word."""

    def __init__(self, uri: str, offsets: list[int], total: int, unknown: int) -> None:
        self.uri, self.offsets, self.total, self.unknown = uri, offsets, total, unknown

    @property
    def size(self) -> int:
        return self.offsets[-1] + 1

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the distinct words, 0 for the unknown word, and which of them each word is."""
        uniq, inverse = np.unique(hashes, return_inverse=True)
        out = np.zeros(len(uniq), np.int64)
        bounds = np.searchsorted(_vocab_shard(uniq), np.arange(VOCAB_SHARDS + 1))
        for s in range(VOCAB_SHARDS):
            lo, hi = bounds[s], bounds[s + 1]
            known = store(self.uri).read(f"words-{s}").get("hash")
            if lo < hi and known is not None:
                at = np.searchsorted(known, uniq[lo:hi])
                ok = known[np.minimum(at, len(known) - 1)] == uniq[lo:hi]
                out[lo:hi] = np.where(ok, self.offsets[s] + at + 1, 0)
        return out, inverse

    def column(self, ids: np.ndarray, what: str) -> np.ndarray:
        """Counts ("count") or back-off codes ("backoff") of word numbers."""
        out = np.zeros(len(ids), np.int64)
        if what == "count":
            out[ids == 0] = self.unknown
        shard = np.searchsorted(self.offsets, ids - 1, side="right") - 1
        for s in np.unique(shard[ids > 0]).tolist():
            pick = np.flatnonzero((shard == s) & (ids > 0))
            name = f"words-{s}" if what == "count" else f"backoff-{s}"
            values = store(self.uri).read(name).get(what)
            if values is not None:
                out[pick] = values[ids[pick] - 1 - self.offsets[s]]
        if what == "backoff":
            zero = store(self.uri).read("backoff-unknown").get("backoff")
            if zero is not None:
                out[ids == 0] = zero[0]
        return out


def count_words(docs: DataFrame, uri: str, min_count: int) -> Words:
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, buf, offsets in K.slices(batch.column(0), SLICE):
            k, c = np.unique(K.words(buf, offsets)[3], return_counts=True)
            keys.append(k)
            counts.append(c)
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["h", "n"])

    counted = map_arrow(docs.select("text"), fn, "h bigint, n bigint", BATCH_ROWS).groupBy("h").agg(F.sum("n").alias("n"))
    shift = 64 - VOCAB_SHARDS.bit_length() + 1
    counted = saved(counted.withColumn("shard", F.expr(f"cast(shiftrightunsigned(h, {shift}) as int)")), "words")

    def write(key: tuple, table: pa.Table) -> pa.Table:
        h = table["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        Store(uri).write(f"words-{key[0].as_py()}", {"hash": h[order], "count": table["n"].to_numpy()[order]})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(h)], pa.int64())})

    kept = counted.where(F.col("n") >= min_count)
    sizes = {r["shard"]: r["size"] for r in kept.groupBy("shard").applyInArrow(write, "shard int, size bigint").collect()}
    offsets = np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(VOCAB_SHARDS)])]).tolist()
    row = counted.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") < min_count, F.col("n"))).alias("rare")).first()
    return Words(uri, offsets, row["all"] or 0, row["rare"] or 0)


def _pair_shard(pair: np.ndarray, shards: int) -> np.ndarray:
    return (K.mix(pair.astype(np.uint64), 31) % np.uint64(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray, shards: int) -> np.ndarray:
    """Places in the order of their shards; 16-bit numbers are sorted by radix."""
    return np.argsort(shard.astype(np.uint16 if shards <= 1 << 16 else np.int64), kind="stable")


def _pairs(buf: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, ...]:
    """Word numbers (of the distinct words, and which each is), rows, the distinct bigrams, where each word's bigram is among them (-1: none)."""
    _, _, row, hashes = K.words(buf, offsets)
    numbers, is_word = words.numbers(hashes)
    ids = numbers[is_word]
    at = np.flatnonzero(row[1:] == row[:-1]) + 1 if len(row) else np.zeros(0, np.int64)
    uniq, inverse = np.unique(ids[at - 1] << 32 | ids[at], return_inverse=True)
    which = np.full(len(ids), -1, np.int64)
    which[at] = inverse
    return numbers, is_word, row, uniq, which


def _pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        top = int(a.max(initial=0))
        kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64
        # the bytes of one significance together compress better
        raw = np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()
        out.write(len(a).to_bytes(8, "little") + np.dtype(kind).itemsize.to_bytes(8, "little") + raw)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, size = int.from_bytes(raw[at : at + 8], "little"), int.from_bytes(raw[at + 8 : at + 16], "little")
        planes = np.frombuffer(raw, np.uint8, n * size, at + 16).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(-1).astype(np.int64))
        at += 16 + n * size
    return out


def _blocks(docs: DataFrame, words: Words, shards: int) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        to, blobs = [], []
        for _, _, buf, offsets in K.slices(batch.column(0), SLICE):
            numbers, is_word, row, pair, which = _pairs(buf, offsets, words)
            if not len(pair):
                continue
            ids = numbers[is_word]
            count = np.bincount(which[which >= 0], minlength=len(pair))
            at = np.flatnonzero((row[2:] == row[:-2])) + 2
            tri, tri_count = np.unique(which[at - 1] << 32 | ids[at], return_counts=True)
            shard = _pair_shard(pair, shards)
            parent, child = tri >> 32, tri & 0xFFFFFFFF
            order, tri_order = _by_shard(shard, shards), _by_shard(shard[parent], shards)
            b2 = np.searchsorted(shard[order], np.arange(shards + 1))
            b3 = np.searchsorted(shard[parent][tri_order], np.arange(shards + 1))
            local = np.empty(len(pair), np.int64)
            local[order] = np.arange(len(pair)) - b2[shard[order]]
            for s in np.flatnonzero(np.diff(b2)).tolist():  # those that have some
                p, t = order[b2[s] : b2[s + 1]], tri_order[b3[s] : b3[s + 1]]
                first, up = pair[p] >> 32, local[parent[t]]
                to.append(s)
                blobs.append(_pack(np.diff(first, prepend=0), pair[p] & 0xFFFFFFFF, count[p], np.diff(up, prepend=0), child[t], tri_count[t]))
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "block"])

    return map_arrow(docs.select("text"), fn, "shard int, block binary", BATCH_ROWS)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    if not len(key):
        return key, count
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(count, first)


def build_shard(blocks: list[bytes], words: Words, prune: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The arrays of a shard's trie, and the mass kept for each first word."""
    pairs, counts, tri_pairs, thirds, tri_counts = [], [], [], [], []
    for block in blocks:
        first, second, count, up, third, tri_count = _unpack(block)
        pair = np.cumsum(first) << 32 | second
        pairs.append(pair)
        counts.append(count)
        tri_pairs.append(pair[np.cumsum(up)] if len(up) else up)
        thirds.append(third)
        tri_counts.append(tri_count)
    pair, count = _summed(np.concatenate(pairs), np.concatenate(counts))
    del pairs, counts
    key = np.searchsorted(pair, np.concatenate(tri_pairs)) << 32
    del tri_pairs
    key |= np.concatenate(thirds)
    del thirds
    tri, tri_count = _summed(key, np.concatenate(tri_counts))
    del key, tri_counts
    kept = count >= prune
    strong = (tri_count >= prune) & kept[tri >> 32]
    number = np.cumsum(kept) - 1
    tri, tri_count = tri[strong], tri_count[strong]
    parent = number[tri >> 32]
    pair, count = pair[kept], count[kept]
    v, n = words.size, len(pair)
    share3 = (tri_count - DISCOUNT) / count[parent]
    mass3 = np.bincount(parent, share3, n)
    firsts, ctx = np.unique(pair >> 32, return_inverse=True)
    share2 = (count - DISCOUNT) / words.column(pair >> 32, "count")
    mass2 = np.bincount(ctx, share2, len(firsts))
    has = np.bincount(parent, minlength=n) > 0
    levels = {
        "first": EliasFano.build(firsts, v),
        "second": EliasFano.build(ctx * v + (pair & 0xFFFFFFFF), max(1, len(firsts)) * v),
        "third": EliasFano.build(parent * v + (tri & 0xFFFFFFFF), max(1, n) * v),
        "first_ptr": EliasFano.build(np.searchsorted(ctx, np.arange(len(firsts) + 1)), n + 1),
        "second_ptr": EliasFano.build(np.searchsorted(parent, np.arange(n + 1)), len(tri) + 1),
    }
    arrays = {f"{name}.{k}": a for name, level in levels.items() for k, a in level.arrays().items()}
    arrays["second.p"], arrays["third.p"] = quantise(share2), quantise(share3)
    arrays["second.backoff"] = np.where(has, quantise(np.maximum(1 - mass3, 1e-9)), 0).astype(np.uint8)
    return arrays, firsts, mass2


class Trie:
    """Look-ups over the shards of a built model."""

    def __init__(self, words: Words, shards: int) -> None:
        self.words, self.shards = words, shards

    def _level(self, shard: int) -> dict:
        s = store(self.words.uri)
        key = f"open-{shard}"
        if key not in s.cache:
            arrays = s.read(f"shard-{shard}")
            names = ("first", "second", "third") if arrays else ()
            s.cache[key] = {n: EliasFano.of(arrays, n) for n in names} | {k: a for k, a in arrays.items() if k.endswith((".p", ".backoff"))}
        return s.cache[key]

    def bigrams(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct pairs: node (-1: none), direct probability, weight left for shorter contexts (1: no children)."""
        node, p, backoff = np.full(len(pair), -1, np.int64), np.zeros(len(pair)), np.ones(len(pair))
        shard = _pair_shard(pair, self.shards)
        order = _by_shard(shard, self.shards)
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            level = self._level(s)
            if not level:
                continue
            pick = order[bounds[s] : bounds[s + 1]]
            firsts, inverse = np.unique(pair[pick] >> 32, return_inverse=True)
            ctx, known = (x[inverse] for x in level["first"].successor(firsts))
            pick, ctx = pick[known], ctx[known]
            if not level["second"].n or not len(pick):
                continue
            at, hit = level["second"].successor(ctx * self.words.size + (pair[pick] & 0xFFFFFFFF))
            pick, at = pick[hit], at[hit]
            node[pick] = at
            p[pick] = VALUE[level["second.p"][at]]
            code = level["second.backoff"][at]
            backoff[pick] = np.where(code > 0, VALUE[code], 1.0)
            node[pick[code == 0]] = -2  # it is there and has no children
        return node, p, backoff

    def trigrams(self, pair: np.ndarray, node: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Direct probability of third words after bigram nodes."""
        out = np.zeros(len(pair))
        shard = _pair_shard(pair, self.shards)
        order = _by_shard(shard, self.shards)
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.unique(shard).tolist():
            level = self._level(s)
            pick = order[bounds[s] : bounds[s + 1]]
            key = node[pick] * self.words.size + third[pick]
            at, hit = level["third"].successor(key)
            out[pick[hit]] = VALUE[level["third.p"][at[hit]]]
        return out

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and log probability of each row."""
        n = len(offsets) - 1
        uniq, inverse, row, pair, which = _pairs(buf, offsets, self.words)
        if not len(row):
            return np.zeros(n, np.int64), np.zeros(n)
        one = (np.maximum(self.words.column(uniq, "count"), 1) / self.words.total)[inverse]
        p = one.copy()
        if len(pair):
            node, direct, backoff = self.bigrams(pair)
            left = self.words.column(uniq, "backoff")
            weight1 = np.where(left > 0, VALUE[left], 1.0)[inverse]
            second = np.flatnonzero(which >= 0)
            p[second] = direct[which[second]] + weight1[second - 1] * one[second]
            third = np.flatnonzero(row[2:] == row[:-2]) + 2
            before = which[third - 1]
            third, before = third[node[before] >= 0], before[node[before] >= 0]
            if len(third):
                p[third] = self.trigrams(pair[before], node[before], uniq[inverse[third]]) + backoff[before] * p[third]
        return np.bincount(row, minlength=n), np.bincount(row, np.log(p), n)


def build(docs: DataFrame, min_count: int = MIN_COUNT, prune: int = PRUNE) -> Trie:
    """Count over all documents and write the model to the shared folder."""
    uri = shared_path(docs.sparkSession, "lm")
    words = count_words(docs, uri, min_count)
    shards = max(1, -(-words.total // SHARD_WORDS))

    def write(key: tuple, table: pa.Table) -> pa.Table:
        arrays, firsts, mass = build_shard(table["block"].to_pylist(), words, prune)
        Store(uri).write(f"shard-{key[0].as_py()}", arrays)
        return pa.table({"id": pa.array(firsts, pa.int64()), "mass": pa.array(mass, pa.float64())})

    blocks = _blocks(docs, words, shards).repartition(shards, "shard")
    mass = saved(blocks.groupBy("shard").applyInArrow(write, "id bigint, mass double"), "mass").groupBy("id").agg(F.sum("mass").alias("mass"))
    bounds = ", ".join(map(str, words.offsets[1:-1])) if VOCAB_SHARDS > 1 else ""
    shard = F.when(F.col("id") == 0, -1).otherwise(F.expr(f"size(filter(array({bounds}), b -> b < id))"))

    def weights(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        ids, kept = table["id"].to_numpy(), table["mass"].to_numpy()
        code = quantise(np.maximum(1 - kept, 1e-9))
        if s < 0:
            Store(uri).write("backoff-unknown", {"backoff": code[:1]})
        else:
            every = np.zeros(words.offsets[s + 1] - words.offsets[s], np.uint8)
            every[ids - 1 - words.offsets[s]] = code
            Store(uri).write(f"backoff-{s}", {"backoff": every})
        return pa.table({"n": pa.array([len(ids)], pa.int64())})

    mass.withColumn("shard", shard.cast("int")).groupBy("shard").applyInArrow(weights, "n bigint").agg(F.sum("n")).collect()
    return Trie(words, shards)


def scores(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, n_words, log_prob (natural) and perplexity of every row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, lp = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for lo, hi, buf, offsets in K.slices(batch.column(1), SLICE):
            n[lo:hi], lp[lo:hi] = trie.score(buf, offsets)
        with np.errstate(divide="ignore", invalid="ignore"):
            ppl = pa.array(np.exp(-lp / n), mask=n == 0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(lp), ppl], names=["doc_id", "n_words", "log_prob", "perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), fn, f"doc_id {kind}, n_words bigint, log_prob double, perplexity double", BATCH_ROWS)
