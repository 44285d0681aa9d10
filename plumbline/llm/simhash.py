"""SimHash near-deduplication by an exact Hamming join.

A fingerprint has 320 bits, the majority votes of the document's distinct words (lower
case, without punctuation).  Two documents are near if their fingerprints differ in at most
``DISTANCE`` bits, and no such link is lost: a fingerprint is cut into 11 blocks of 29 or 30
bits, and two within 54 bits differ in at most 4 bits of some block.  Each goes to every value
within 2 bits of its own in a block, so the two meet on one.  Pairs that meet are
verified by their full Hamming distance.

Equal fingerprints are merged before the join into one node with a number of its own.  Nodes are
cut into chunks of about ``CHUNK``; a task joins two chunks, or while there is one, some of its blocks.
A task reports a spanning forest of its verified pairs instead of all of them, so a group of
thousands costs thousands of edges.  Groups are the connected components of verified pairs.

Defined results: a null text counts as empty, and a document without a word is near to
nothing; the smallest doc_id of a group is kept (null last; of repeated rows one); an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .work import map_arrow, saved, sized

BITS, DISTANCE = 320, 54
#: Bits of a block that each row of a pair flips to meet the other.
FLIPS = 2
#: Nodes of a chunk, nodes for which one task is enough, keys of a slice, pairs verified at once, rows of a run looked at without regard to components.
CHUNK, ALONE, KEYS, PAIRS, LONG = 500_000, 16_384, 1 << 20, 1 << 19, 32
WORDS64 = BITS // 64
MAX_VOTES = 60_000
F_NAMES = [f"f{i}" for i in range(WORDS64)]
F_SCHEMA = ", ".join(f"{f} bigint" for f in F_NAMES)

_LANE = np.uint64(0x0001000100010001)


def _votes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of set bits by segment, (segments, BITS); every segment has 1 to MAX_VOTES hashes."""
    # bits s, s + 16, s + 32 and s + 48 of a hash are summed in one 64-bit word, as four 16-bit counters
    votes = np.empty((len(starts), WORDS64, 4, 16), np.int64)
    for k in range(WORDS64):
        mixed = K.mix(hashes, 20 + k)
        for s in range(16):
            lanes = np.add.reduceat((mixed >> np.uint64(s)) & _LANE, starts)
            votes[:, k, :, s] = lanes.view(np.uint16).reshape(-1, 4)
    return votes.reshape(len(starts), BITS)


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, WORDS64) fingerprints as uint64 and the number of distinct words of each row."""
    n = len(column)
    out, count = np.zeros((n, WORDS64), np.uint64), np.zeros(n, np.int64)
    for lo, hi, buf, offsets in K.slices(column, 1 << 18):
        _, _, row, hashes = K.words(K.folded(buf), offsets, K.PUNCTUATION)
        if not len(row):
            continue
        row, hashes = K.distinct_words(row, hashes)
        at = K.row_starts(row, hi - lo)
        size = np.diff(at)
        count[lo:hi] = size
        per = -(-size // MAX_VOTES)
        seg_row = np.repeat(np.arange(hi - lo), per)
        first = np.cumsum(per) - per
        starts = at[:-1][seg_row] + (np.arange(len(seg_row)) - first[seg_row]) * MAX_VOTES
        votes = np.add.reduceat(_votes(hashes, starts), first[per > 0], axis=0)
        bits = votes * 2 > size[size > 0][:, None]
        out[lo:hi][size > 0] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out, count


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, whether there are words, and the fingerprint of every row."""

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp, count = fingerprints(batch.column(1))
        cols = [batch.column(0), batch.column(2), pa.array(count > 0), *(pa.array(fp[:, k].view(np.int64)) for k in range(WORDS64))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "worded", *F_NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return map_arrow(slim, add, f"doc_id {kind}, text_hash bigint, worded boolean, {F_SCHEMA}")


class Forest:
    """Components of rows, and the edges that span them."""

    def __init__(self, rows: int):
        self.label = np.arange(rows)
        self.found: list[np.ndarray] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.label, high, low)
            used = np.flatnonzero(low == self.label[high])
            used = used[np.unique(high[used], return_index=True)[1]]
            self.found.append(np.stack([i[used], j[used]]))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.concatenate([np.zeros((2, 0), np.int64), *self.found], 1)
        return i, j


def _near(fp: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs of columns lie within ``limit``; after each word only those that still can are looked at."""
    live = np.arange(len(i))
    distance = np.bitwise_count(fp[0][i] ^ fp[0][j]).astype(np.int16)
    for k in range(1, WORDS64):
        distance = distance + np.bitwise_count(fp[k][i] ^ fp[k][j])
        ok = np.flatnonzero(distance <= limit)
        live, distance, i, j = live[ok], distance[ok], i[ok], j[ok]
    return live


def _link(keys: np.ndarray, row: np.ndarray, fp: np.ndarray, limit: int, forest: Forest) -> None:
    """Add those near pairs that join each row to the one before or to the first of its run of equal sorted keys; it makes close groups one component cheaply."""
    at = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    first = start[np.searchsorted(start, at, "right") - 1]
    for other in (at - 1, first):
        a, b = row[other], row[at]
        near = _near(fp, a, b, limit)
        forest.add(a[near], b[near])


def _join(keys: np.ndarray, row: np.ndarray, fp: np.ndarray, limit: int, forest: Forest) -> None:
    """Add every near pair of two components in a run of equal sorted keys; in a run, rows of one component should adjoin."""
    new = np.r_[True, keys[1:] != keys[:-1]]
    label = forest.label[row]
    bounds = np.r_[np.flatnonzero(new), len(keys)]
    group = np.r_[np.flatnonzero(new | np.r_[True, label[1:] != label[:-1]]), len(keys)]
    after = np.repeat(group[1:], np.diff(group))
    count = np.repeat(bounds[1:], np.diff(bounds)) - after
    at = np.flatnonzero(count)
    after, count = after[at], count[at]
    total = np.cumsum(count)
    known = len(forest.found)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - count[lo] + PAIRS, "right")))
        c = count[lo:hi]
        a = np.repeat(row[at[lo:hi]], c)
        b = row[np.arange(int(c.sum())) + np.repeat(after[lo:hi] - np.cumsum(c) + c, c)]
        if len(forest.found) > known:
            apart = forest.label[a] != forest.label[b]
            a, b = a[apart], b[apart]
        near = _near(fp, a, b, limit)
        forest.add(a[near], b[near])
        lo = hi


def bucket_edges(keys: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (i, j) that span the components of each run of equal sorted keys."""
    forest, fp, row = Forest(len(keys)), np.ascontiguousarray(fp.T), np.arange(len(keys))
    _link(keys, row, fp, limit, forest)
    row = np.lexsort((forest.label, keys))
    _join(keys[row], row, fp, limit, forest)
    return forest.edges()


def blocks_for(limit: int) -> list[tuple[int, int]]:
    """First bit and width of each block: so many that within ``limit`` bits one block differs in at most 2 * FLIPS."""
    n = max(BITS // 32, limit // (2 * FLIPS + 1) + 1)
    cut = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def _value(fp: np.ndarray, first: int, width: int) -> np.ndarray:
    """Bits of every column from ``first`` on, up to 64; the first bit follows the last."""
    word, shift = divmod(first % BITS, 64)
    value = fp[word] >> np.uint64(shift)
    if shift + width > 64:
        value = value | fp[(word + 1) % WORDS64] << np.uint64(64 - shift)
    return value & np.uint64((1 << width) - 1)


def _masks(width: int, flips: int) -> np.ndarray:
    """All numbers of ``width`` bits with exactly ``flips`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), flips)], np.uint64)


def _sift(keys: np.ndarray, row: np.ndarray, ring: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in runs of equal sorted keys that differ in at most ``most`` bits of ``ring``."""
    lag, i = 1, np.flatnonzero(keys[1:] == keys[:-1])
    while len(i):
        a, b = row[i], row[i + lag]
        near = np.flatnonzero(np.bitwise_count(ring[a] ^ ring[b]) <= most)
        yield a[near], b[near]
        lag += 1
        i = i[: np.searchsorted(i, len(keys) - lag)]
        i = i[keys[i] == keys[i + lag]]


def _meet(fp: np.ndarray, blocks: list[tuple[int, int]], k: int, limit: int, forest: Forest) -> None:
    """Add every near pair of two components for which block ``k`` begins a ring.

    Going round the blocks, some block of a near pair begins a ring: any number of blocks from there
    on differ in no more bits than their share of ``limit`` (cycle lemma).  So the first
    differs in at most 2 * FLIPS bits, and the first three in three shares.
    Each row goes to all values within FLIPS of its own, so two such rows meet.  A slice holds the
    values with equal upper bits: what a row flips there, it can't flip below.
    """
    rows, (first, width) = fp.shape[1], blocks[k]
    order = np.argsort(forest.label, kind="stable")
    value = _value(fp, first, width)[order]
    following = sum(blocks[(k + n) % len(blocks)][1] for n in (1, 2))
    ring, most = _value(fp, first + width, following)[order], 3 * limit // len(blocks)
    keys = rows * sum(comb(width, f) for f in range(FLIPS + 1))
    upper = min(width - 1, max(0, (keys // KEYS).bit_length()))
    lower = np.uint64(width - upper)
    top, low = (value >> lower).astype(np.int64), (value & ((np.uint64(1) << lower) - np.uint64(1))) << np.uint64(32)
    low |= np.arange(rows, dtype=np.uint64)
    by_top = np.argsort(top, kind="stable")
    low = low[by_top]
    bounds = np.searchsorted(top[by_top], np.arange((1 << upper) + 1))
    tops = [_masks(upper, f).astype(np.int64) for f in range(FLIPS + 1)]
    lows = [np.concatenate([_masks(int(lower), f) for f in range(r + 1)]) << np.uint64(32) for r in range(FLIPS + 1)]
    for part in range(1 << upper):
        found = []
        for flips, mask in enumerate(tops):
            own = [low[bounds[t] : bounds[t + 1]] for t in (part ^ mask).tolist()]
            if own:
                found.append((np.concatenate(own) ^ lows[FLIPS - flips][:, None]).reshape(-1))
        packed = np.concatenate(found)
        packed.sort()
        key, row = (packed >> np.uint64(32)).astype(np.uint32), packed.astype(np.uint32)
        if (key[LONG:] == key[:-LONG]).any():
            bound = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
            size = np.diff(bound)
            crowded = np.repeat(size > LONG, size)
            _join(key[crowded], order[row[crowded]], fp, limit, forest)
            key, row = key[~crowded], row[~crowded]
        for a, b in _sift(key, row, ring, most):
            a, b = order[a], order[b]
            apart = forest.label[a] != forest.label[b]
            a, b = a[apart], b[apart]
            near = _near(fp, a, b, limit)
            forest.add(a[near], b[near])


def near_pairs(fp: np.ndarray, limit: int, share: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (i, j) of rows of ``fp``; those of all shares span every component of the pairs within ``limit`` bits.

    A share looks at every ``shares``-th block, but all link what is close in any block first, so a large group isn't compared again and again.
    """
    blocks, fp = blocks_for(limit), np.ascontiguousarray(fp.T)
    forest = Forest(fp.shape[1])
    for first, width in blocks:
        value = _value(fp, first, width)
        order = np.argsort(value)
        _link(value[order], order, fp, limit, forest)
    for k in range(share, len(blocks), shares):
        _meet(fp, blocks, k, limit, forest)
    return forest.edges()


def _spread(chunks: int, shares: int):
    """Rows for tasks: each pair of chunks by each share of the blocks; one chunk is a pair by itself."""
    pairs = list(combinations(range(chunks), 2)) or [(0, 0)]
    tasks = [np.array([p * shares + s for p, pair in enumerate(pairs) if c in pair for s in range(shares)], np.int32) for c in range(chunks)]
    tasks = np.stack(tasks)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = batch.column(0).to_numpy()
        chunk = (K.mix(node.view(np.uint64), 7) % np.uint64(chunks)).astype(np.int64)
        at = pa.array(np.repeat(np.arange(len(node)), tasks.shape[1]))
        cols = [pa.array(tasks[chunk].reshape(-1)), *(batch.column(i).take(at) for i in range(1 + WORDS64))]
        return pa.RecordBatch.from_arrays(cols, names=["task", "node", *F_NAMES])

    return run, len(pairs) * shares


def _verify(limit: int, shares: int):
    def run(table: pa.Table) -> pa.Table:
        task, node = table.column(0)[0].as_py(), table.column(1).to_numpy()
        fp = np.stack([table.column(2 + k).to_numpy().view(np.uint64) for k in range(WORDS64)], 1)
        i, j = near_pairs(fp, limit, task % shares, shares)
        return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    return run


def near_edges(nodes: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of nodes (rows of node and fingerprint) within ``limit`` bits, enough of them to connect every group."""
    count, blocks = nodes.count(), len(blocks_for(limit))
    chunks = max(1, -(-count // CHUNK))
    shares = min(blocks, 1 + count // ALONE) if chunks == 1 else max(1, blocks // (chunks - 1))
    spread, tasks = _spread(chunks, shares)
    rows = map_arrow(nodes.select("node", *F_NAMES), spread, f"task int, node bigint, {F_SCHEMA}")
    # more ranges than tasks, so that no two tasks share one
    rows = rows.repartitionByRange(4 * tasks, "task").groupBy("task")
    return rows.applyInArrow(_verify(limit, shares), "a bigint, b bigint").distinct()


def _groups(docs: DataFrame, limit: int) -> DataFrame:
    """Saved: doc_id, text_hash, node and group (a node) of every row; a row without words has neither node nor group."""
    hashed = saved(_hashed(docs), "simhash")
    # a fingerprint's number is its place in a saved table, so no two share one
    distinct = hashed.where("worded").select(*F_NAMES).distinct()
    nodes = saved(distinct.withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    member = saved(components(near_edges(nodes, limit)), "simhash-members")
    grouped = nodes.join(sized(member, 64), nodes["node"] == member["id"], "left").select(*(nodes[f].alias(f"n_{f}") for f in F_NAMES), "node", F.coalesce("component", "node").alias("group"))
    on = hashed["worded"]
    for f in F_NAMES:
        on = on & (hashed[f] == grouped[f"n_{f}"])
    return saved(hashed.join(grouped, on, "left").select("doc_id", "text_hash", "node", "group"), "simhash-groups")


def near_groups(docs: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of its group) and keep for every row."""
    rows = _groups(docs, limit)
    grouped = rows.where("group is not null").groupBy("group", "doc_id").agg(F.count("*").alias("times"))
    best = grouped.groupBy("group").agg(F.min("doc_id").alias("group_id"))
    out = grouped.join(best, "group").select(
        "doc_id", "group_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")
    )
    out = out.select("doc_id", "group_id", (F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("nth") == 1)).alias("keep"))
    alone = rows.where("group is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(True).alias("keep"))
    return out.unionByName(alone)


def near_dedup(docs: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group of near copies.

    Rows are told apart by doc_id and a hash of the text, which are cheap to have again, so
    only rows of groups of two or more are looked up, and no text is shuffled but that of kept copies.
    """
    rows = _groups(docs, limit).where("group is not null")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    crowded = rows.groupBy("group").agg(F.count("*").alias("n"), F.min(order).alias("best")).where("n > 1")
    crowded = saved(crowded.select("group", F.col("best.doc_id").alias("kept_id"), F.col("best.text_hash").alias("kept_hash")), "simhash-kept")
    drop = rows.join(crowded, "group").select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash"))
    drop = sized(saved(drop, "simhash-drop"), 96)
    kept = sized(crowded.select("kept_id", "kept_hash"), 96)
    own = F.xxhash64(docs["text"])
    alone = docs.join(drop, (own == drop["drop_hash"]) & docs["doc_id"].eqNullSafe(drop["drop_id"]), "left_anti")
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    chosen = inner.withColumn("own", F.xxhash64(text))
    chosen = chosen.join(kept, (chosen["own"] == kept["kept_hash"]) & chosen[doc_id].eqNullSafe(kept["kept_id"]), "left_semi")
    return alone.unionAll(chosen.dropDuplicates(["own", doc_id]).drop("own").toDF(*docs.columns))
