"""Exact deduplication by composable polynomial fingerprints.

A document is cut into chunks of ``CHUNK`` bytes.  Each chunk is hashed by two
polynomials modulo the Mersenne prime 2**61 - 1, all chunks of a batch at once, and
``combine`` joins neighbours by shifting the left hash by the length of the right:
``H(a + b) = H(a) * B**len(b) + H(b)``, so a huge document needs no sequential pass.
A document of over ``HUGE`` bytes is cut into pieces that are hashed in separate tasks and combined.
Only (fingerprints, length, doc_id) are grouped over the whole table.  Texts are moved for documents
with an equal fingerprint alone.  Each fingerprint has one representative, the row with its smallest
doc_id.  Its copies are spread over salts of about ``PER_SALT`` rows, the representative's text goes once to
each salt, and the copies stream past it and are compared chunk by chunk.  Rows that only collide
with their representative get one of their own in a further round, so no two texts are ever merged and
no task holds a group.

Defined results: a null text equals other null texts and nothing else; empty texts are copies
of each other; the copy kept has the smallest doc_id (a null doc_id comes last), and of
repeated rows one stays; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .work import ROWS_AT_ONCE, map_arrow, saved, sized

P = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % P, 0x0F58476D1CE4E5B9 % P)
CHUNK = 1 << 16
HUGE, PIECE, PER_SALT = 32 << 20, 1 << 22, 512
KEYS = ["fp_a", "fp_b", "fp_bytes"]
FP = "fp_a bigint, fp_b bigint, fp_bytes bigint"


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    powers, x = [], 1
    for _ in range(CHUNK):
        powers.append(x)
        x = x * base % P
    p = np.array(powers, np.uint64)
    return p & np.uint64((1 << 31) - 1), p >> np.uint64(31)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def combine(left: int, right: int, right_len: int, base: int = BASES[0]) -> int:
    """The hash of two joined strings from their hashes and the length of the second."""
    return (left * pow(base, right_len, P) + right) % P


def chunk_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each base, the hash of every (non-empty) chunk of at most CHUNK bytes; the chunks tile ``buf``."""
    if not _POWERS:
        _POWERS.extend(_tables(b) for b in BASES)
    left = np.repeat(ends - 1, ends - starts) - np.arange(starts[0], ends[-1])
    symbols = buf[starts[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    at = starts - starts[0]
    out = []
    for low, high in _POWERS:
        lo = np.add.reduceat(symbols * low[left], at).tolist()
        hi = np.add.reduceat(symbols * high[left], at).tolist()
        out.append([((h << 31) + x) % P for h, x in zip(hi, lo, strict=True)])
    return out


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 61-bit fingerprints and the byte length (-1 for null) of every text."""
    n = len(column)
    fps = np.zeros((2, n), np.int64)
    size = np.zeros(n, np.int64)
    for lo, hi, buf, offsets in K.slices(column):
        length = np.diff(offsets)
        size[lo:hi] = length
        per = -(-length // CHUNK)
        if not per.sum():
            continue
        row = np.repeat(np.arange(hi - lo), per)
        first = np.cumsum(per) - per
        starts = offsets[:-1][row] + (np.arange(len(row)) - first[row]) * CHUNK
        ends = np.minimum(starts + CHUNK, offsets[1:][row])
        for k, hashes in enumerate(chunk_hashes(buf, starts, ends)):
            for i in np.flatnonzero(per).tolist():
                a, m = int(first[i]), int(per[i])
                h = hashes[a]
                for j in range(a + 1, a + m):
                    h = combine(h, hashes[j], int(ends[j] - starts[j]), BASES[k])
                fps[k, lo + i] = h
    if column.null_count:
        size[column.is_null().to_numpy(zero_copy_only=False)] = -1
    return fps[0], fps[1], size


def huge_fingerprints(docs: DataFrame, limit: int = HUGE, piece: int = PIECE) -> DataFrame | None:
    """huge_id, huge_hash and fingerprints of the documents of over ``limit`` bytes, hashed piece by piece; None without any.

    A document is known by its doc_id and a hash of its text here, as these are cheap to have again.
    """
    slim = docs.select("doc_id", "text").where(F.octet_length("text") > limit)
    big = slim.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("t"))
    pieces = big.select("doc_id", "hash", "t", F.explode(F.expr(f"sequence(0, (length(t) - 1) div {piece})")).alias("k"))
    pieces = pieces.select("doc_id", "hash", "k", F.expr(f"substring(t, cast(k * {piece} + 1 as int), {piece})").alias("t"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = fingerprints(batch.column(3))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, fps)], names=["doc_id", "hash", "k", *KEYS])

    def combined(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for parts in batch.column(2).to_pylist():
            parts.sort(key=lambda p: p["k"])
            out.append(reduce(lambda x, p: (*(combine(x[i], p[KEYS[i]], p["fp_bytes"], BASES[i]) for i in (0, 1)), x[2] + p["fp_bytes"]), parts, (0, 0, 0)))
        columns = [*batch.columns[:2], *(pa.array([x[i] for x in out], pa.int64()) for i in range(3))]
        return pa.RecordBatch.from_arrays(columns, names=["huge_id", "huge_hash", *KEYS])

    parts = map_arrow(pieces.repartition("doc_id", "hash", "k"), hashed, f"doc_id {kind}, hash bigint, k bigint, {FP}", 4)
    # repeated rows have the same parts
    whole = parts.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("k", *KEYS)).alias("parts"))
    found = saved(map_arrow(whole, combined, f"huge_id {kind}, huge_hash bigint, {FP}"), "huge")
    return None if found.isEmpty() else found


def with_fingerprints(docs: DataFrame, huge: DataFrame | None = None, limit: int = HUGE) -> DataFrame:
    """``docs`` with the fingerprint columns and a lane, a number that no other row has, before its own; ``text`` may have any place."""
    kept = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(kept))])
    text = kept.index("text")
    own = "".join(f", c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                lane = np.arange(at, at + batch.num_rows, dtype=np.int64)
                at += batch.num_rows
                columns = [*map(pa.array, fingerprints(batch.column(text))), pa.array(lane), *batch.columns]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, "lane", *batch.schema.names])

    schema = f"{FP}, lane bigint{own}"
    if huge is None:
        return inner.mapInArrow(run, schema)
    doc_id = kept.index("doc_id")
    here = F.coalesce(F.octet_length(f"c{text}"), F.lit(0)) <= limit
    match = (F.xxhash64(f"c{text}") == huge["huge_hash"]) & F.col(f"c{doc_id}").eqNullSafe(huge["huge_id"])
    wide = inner.where(~here).join(sized(huge, 192), match).withColumn("lane", -1 - F.monotonically_increasing_id())
    return inner.where(here).mapInArrow(run, schema).unionByName(wide.select(*KEYS, "lane", *inner.columns))


def _same(a: bytes | None, b: bytes | None) -> bool:
    """Chunkwise comparison: stops at the first chunk that differs."""
    if a is None or b is None:
        return a is b
    # an Arrow buffer has signed bytes, and a view compares values
    x, y = memoryview(a).cast("B"), memoryview(b).cast("B")
    return len(x) == len(y) and all(x[i : i + CHUNK] == y[i : i + CHUNK] for i in range(0, len(x), CHUNK))


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (fingerprint, salt, copy, lane, doc_id, text), each salt led by its representative (copy = 0): what each copy is.

    lane, doc_id, group_id (the representative's), whether it is that row itself and whether the texts are equal.
    """
    group, lane, text = None, None, None
    for batch in batches:
        copy, lanes, ids, texts = (batch.column(i) for i in range(4, 8))
        at, groups, first, same = [], [], [], []
        for i, (c, its) in enumerate(zip(copy.to_pylist(), lanes.to_pylist(), strict=True)):
            raw = texts[i].as_buffer() if texts[i].is_valid else None
            if c == 0:
                group, lane, text = ids[i].as_py(), its, None if raw is None else bytes(raw)
                continue
            at.append(i)
            groups.append(group)
            first.append(its == lane)
            same.append(_same(raw, text))
        at = pa.array(at, pa.int64())
        columns = [lanes.take(at), ids.take(at), pa.array(groups, ids.type), pa.array(first, pa.bool_()), pa.array(same, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["lane", "doc_id", "group_id", "first_copy", "same"])


def _on(left: DataFrame, right: DataFrame) -> Column:
    return (left["fp_a"] == right["fp_a"]) & (left["fp_b"] == right["fp_b"]) & (left["fp_bytes"] == right["fp_bytes"])


def _round(copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (fingerprint, n, lane, doc_id, text): the representatives, and every row held against its own."""
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "lane")
    best = copies.groupBy(*KEYS).agg(F.min(order).alias("best"))
    best = saved(best.select(F.col("best.lane").alias("rep_lane")), "exact-kept")
    chosen = sized(best, 64)
    led = copies.join(chosen, copies["lane"] == chosen["rep_lane"], "left_semi")
    salts = F.expr(f"1 + (n - 1) div {PER_SALT}")
    led = led.select(*KEYS, F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"), F.lit(0).alias("copy"), "lane", "doc_id", "text")
    rest = copies.select(*KEYS, F.pmod(F.xxhash64("lane"), salts).alias("salt"), F.lit(1).alias("copy"), "lane", "doc_id", "text")
    rows = led.unionByName(rest).repartition(*KEYS, "salt").sortWithinPartitions(*KEYS, "salt", "copy")
    kind = copies.schema["doc_id"].dataType.simpleString()
    return best, saved(rows.mapInArrow(verify, f"lane bigint, doc_id {kind}, group_id {kind}, first_copy boolean, same boolean"), "exact-verified")


def _held(copies: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Lanes of the rows to keep, and lane, doc_id, group_id, first_copy, same of all; rounds go on while some row only collides."""
    left = copies.select(*KEYS, "n", "lane", F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept, every = _round(left)
    wrong = every.where("NOT same").select("lane")
    while not wrong.isEmpty():
        left = left.join(sized(wrong, 64).withColumnRenamed("lane", "wrong"), F.col("lane") == F.col("wrong"), "left_semi")
        more, found = _round(left)
        kept, every = kept.unionByName(more), every.where("same").unionByName(found)
        wrong = found.where("NOT same").select("lane")
    return kept, every


def _shared(prints: DataFrame) -> DataFrame:
    """Saved: the fingerprints that two or more rows have, with the number of rows."""
    return saved(prints.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1"), "exact")


def _copies(docs: DataFrame, shared: DataFrame, huge: DataFrame | None, limit: int) -> DataFrame:
    """Saved: the rows whose fingerprint is shared, with n; only saved rows have lanes that stay."""
    marked = with_fingerprints(docs, huge, limit)
    own = [f"c{i}" for i in range(len(docs.columns))]
    return saved(marked.join(shared, _on(marked, shared)).select(*(marked[k] for k in KEYS), "n", "lane", *own), "exact-copies")


def exact_groups(docs: DataFrame, limit: int = HUGE) -> DataFrame:
    """doc_id, group_id (the smallest doc_id with the same text) and keep (one row of each group) for every row."""
    docs = docs.select("doc_id", "text")
    huge = huge_fingerprints(docs, limit)
    prints = saved(with_fingerprints(docs, huge, limit).select(*KEYS, "c0"), "exact-prints")
    shared = sized(_shared(prints), 192)
    one = prints.join(shared, _on(prints, shared), "left_anti")
    one = one.select(F.col("c0").alias("doc_id"), F.col("c0").alias("group_id"), F.lit(True).alias("keep"))
    _, every = _held(_copies(docs, shared, huge, limit), "c0", "c1")
    return one.unionByName(every.select("doc_id", "group_id", F.col("first_copy").alias("keep")))


def exact_dedup(docs: DataFrame, limit: int = HUGE) -> DataFrame:
    """``docs`` with one row of each distinct text."""
    names = docs.columns
    huge = huge_fingerprints(docs, limit)
    shared = sized(_shared(with_fingerprints(docs.select("doc_id", "text"), huge, limit)), 192)
    marked = with_fingerprints(docs, huge, limit)
    single = marked.join(shared, _on(marked, shared), "left_anti").drop(*KEYS, "lane")
    copies = _copies(docs, shared, huge, limit)
    kept, _ = _held(copies, *(f"c{names.index(c)}" for c in ("doc_id", "text")))
    kept = copies.join(kept, copies["lane"] == kept["rep_lane"], "left_semi").drop(*KEYS, "n", "lane")
    return single.unionByName(kept).toDF(*names)


ORACLE = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id,
       row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS keep
FROM documents
"""
