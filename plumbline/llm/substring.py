"""Substring deduplication with a log-structured fingerprint index.

Documents are read as words.  Fingerprints are hashes of windows of ``ANCHOR`` words, thinned
by winnowing (the smallest of every ``WINDOW - ANCHOR + 1`` neighbours), so that two documents that
share ``WINDOW`` words share at least one.  A fingerprint is indexed with the ``CONTEXT`` words on its
left, and again with those on its right: wherever it lies in ``WINDOW`` shared words, one of the
two sides is shared as well.

The index is a list of immutable runs, tables bucketed and sorted by key, each with the earliest
occurrence of every key of its batch.  A new batch is merge-joined with each older run and itself,
bucket by bucket, and its own run is added.  When more than ``FANOUT`` runs stand, they are
compacted into one.

A key leads to one earlier occurrence.  That is enough where all its occurrences have the same ``WINDOW - ANCHOR`` words
on either side, which a second hash tells.  Where they differ, an occurrence and the one its key leads to also enter
the hashes of all windows of ``WINDOW`` words around the fingerprint into a second list of runs, with exact windows for keys; so
occurrences that share a passage meet there, whichever document holds the key first, and none is left out.

Windows that lie in a passage already found in their document are done.  Each other match is verified on the words themselves: both documents send the stretch around the
matched fingerprints, the words are compared, and the common stretch is kept if it has ``WINDOW``
words or more.

Defined results: null and empty texts have no passages; a document is a doc_id with a text, so
a repeated row is no second document, while equal texts of different doc_ids are; occurrences are
ordered by batch, then by a hash of the document, then by place; passages inside one document
count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .work import map_arrow, saved, shared_dir, sized

WINDOW, ANCHOR, CONTEXT, BATCHES, FANOUT = 50, 10, 20, 3, 2
#: Cuts of one document that go to one task.
PER_CUT = 128


def _sliding(values: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """The best of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = better(out[:-step], out[step:])
        have += step
    return out


def winnow(hashes: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Places of the hashes that are smallest in some run of ``width`` neighbours of one row."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, width, np.minimum)
    least = np.where(row[: len(least)] == row[width - 1 :], least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((most == hashes) & (hashes > 0))
    if not len(at):
        return at
    # of a chain of equal hashes (a repeated phrase) a few are enough: one each half width, and the last
    fresh = np.r_[True, (hashes[at[1:]] != hashes[at[:-1]]) | (row[at[1:]] != row[at[:-1]]) | (np.diff(at) >= width)]
    begin = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    step = (at - begin) // (width // 2)
    return at[fresh | np.r_[True, step[1:] != step[:-1]] | np.r_[fresh[1:], True]]


def anchors(column: pa.Array) -> list[tuple[np.ndarray, ...]]:
    """Row, place and key of every thinned fingerprint with each of its sides, and a hash of all that a passage may share with it, by slice."""
    out = []
    for lo, hi, buf, offsets in K.slices(column):
        _, _, row, hashes = K.words(buf, offsets)
        at, window = K.window_hashes(hashes, row, ANCHOR)
        if not len(at):
            continue
        picked = winnow(np.maximum(window, np.uint64(1)), row[at], WINDOW - ANCHOR + 1)
        begin = K.row_starts(row, hi - lo)
        by_place = np.zeros(len(hashes) + 1, np.uint64)
        side_at, side = K.window_hashes(hashes, row, CONTEXT)
        by_place[side_at] = side
        place = at[picked]
        r = row[place]
        left = np.where(place - CONTEXT >= begin[r], by_place[np.maximum(place - CONTEXT, 0)], np.uint64(0))
        after = place + ANCHOR
        right = np.where(after + CONTEXT <= begin[r + 1], by_place[np.minimum(after, len(hashes))], np.uint64(0))
        # one key for each side that is there
        mark = window[picked]
        keys = np.concatenate([K.mix(mark + K.mix(left, 41), 42), K.mix(mark + K.mix(right, 43), 44)])
        there = np.concatenate([left, right]) > 0
        low, high = np.maximum(place - WINDOW + ANCHOR, begin[r]), np.minimum(place + WINDOW, begin[r + 1])
        around = K.mix(K.range_hashes(hashes, low, high) + (place - low).astype(np.uint64), 45)
        out.append(tuple(np.concatenate([x, x])[there] for x in (r + lo, place - begin[r])) + (keys[there], np.concatenate([around] * 2)[there]))
    return out


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and rid, a hash of both."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("rid"))


def _keys(docs: DataFrame) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = anchors(batch.column(0))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        cols = [batch.column(1).take(pa.array(parts[0].astype(np.int64))), pa.array(parts[1].astype(np.int32)), *(pa.array(x.astype(np.uint64).view(np.int64)) for x in parts[2:])]
        return pa.RecordBatch.from_arrays(cols, names=["rid", "place", "key", "around"])

    return map_arrow(docs.select("text", "rid"), fn, "rid bigint, place int, key bigint, around bigint")


def _windows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """rid, place and key (their hash) of all windows of ``WINDOW`` words that hold the fingerprints at (rid, place)."""
    # a document has fewer places than words
    grouped = saved(places.groupBy(F.col("rid").alias("at_rid")).agg(F.collect_set("place").alias("places")), "places")
    there = docs.join(sized(grouped.select("at_rid"), 64), F.col("rid") == F.col("at_rid"), "left_semi")
    # a repeated row gives the same windows again, which meet nothing new
    there = there.join(grouped, F.col("rid") == F.col("at_rid"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, place, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        back = np.arange(WINDOW - ANCHOR + 1)
        for lo, hi, buf, offsets in K.slices(batch.column(0)):
            _, _, its, hashes = K.words(buf, offsets)
            begin = K.row_starts(its, hi - lo)
            for i in range(hi - lo):
                anchor = np.array(batch.column(2)[lo + i].as_py(), np.int64)
                first = np.unique(anchor[:, None] - back)
                first = first[(first >= 0) & (first + WINDOW <= begin[i + 1] - begin[i])]
                row.append(np.full(len(first), lo + i))
                place.append(first)
                key.append(np.zeros(0, np.uint64) if not len(first) else K.range_hashes(hashes[begin[i] : begin[i + 1]], first, first + WINDOW))
        cols = [batch.column(1).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(key).view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=["rid", "place", "key"])

    return map_arrow(there.select("text", "rid", "places"), fn, "rid bigint, place int, key bigint", 64)


class Index:
    """The runs of fingerprints and those of windows; every run is a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.dir, self.made = spark, f"{shared_dir(spark)}/plumbline", {}
        self.runs: list[DataFrame] = []
        self.windows: list[DataFrame] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(self, rows: DataFrame, shuffled: bool = True) -> DataFrame:
        """Rows with a key as an immutable run, sorted within its buckets."""
        name = f"run_{uuid.uuid4().hex}"
        placed = rows.repartition(self.buckets, "key") if shuffled else rows
        writer = placed.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet")
        writer.option("path", f"{self.dir}/{name}").saveAsTable(name)
        run = self.spark.table(name)
        self.made[name] = run
        return run

    def drop(self, runs: list[DataFrame]) -> None:
        """Drop runs that nothing reads any more, with their files."""
        for name in [name for name, run in self.made.items() if any(run is r for r in runs)]:
            del self.made[name]
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _met(self, batch: DataFrame, runs: list[DataFrame], ref: list[str]) -> DataFrame:
        """Occurrences of a batch (a run) with an earlier one in it or in an older run; its own run is added."""
        first = self.written(batch.groupBy("key").agg(F.min(F.struct(*ref)).alias("ref")), shuffled=False)
        out = batch.join(first, "key").where("NOT (rid = ref.rid AND place = ref.place)")
        for run in runs:
            out = out.unionByName(batch.join(run, "key"))
        runs.append(first)
        return out

    def add(self, docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Match a batch of documents with the older ones and itself; ``known`` holds all documents so far.

        Returns stretches with an earlier occurrence: of fingerprints, and of windows.
        """
        batch = self.written(_keys(docs))
        met = saved(self._met(batch, self.runs, ["rid", "place", "around"]), "met")
        apart = met.where("around <> ref.around")
        places = apart.select("rid", "place").unionByName(apart.select("ref.rid", "ref.place"))
        windows = self.written(_windows(known, places))
        exact = self._met(windows, self.windows, ["rid", "place"]).where("NOT (rid = ref.rid AND place = ref.place)")
        led = ["rid", "place", F.col("ref.rid").alias("ref_rid"), (F.col("ref.place") - F.col("place")).alias("shift")]
        out = saved(_folded(met.select(*led)), "matches"), saved(_folded(exact.select(*led)), "exact")
        self.drop([batch, windows])
        self.compact()
        return out

    def compact(self) -> None:
        """Merge more than FANOUT runs into one; of equal keys the older run's occurrence stays."""
        for runs in (self.runs, self.windows):
            if len(runs) > FANOUT:
                aged = [run.withColumn("age", F.lit(k)) for k, run in enumerate(runs)]
                every = aged[0]
                for run in aged[1:]:
                    every = every.unionByName(run)
                merged = self.written(every.groupBy("key").agg(F.min_by("ref", "age").alias("ref")), shuffled=False)
                self.drop(runs)
                runs[:] = [merged]

    def close(self) -> None:
        """Drop the runs and their files."""
        self.drop(list(self.made.values()))


def _stretches(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """For each span twice (side 0 its document, 1 the earlier one): doc_id and the words of the stretch, as joined bytes."""
    mine = F.struct(F.col("rid"), F.lit(0).alias("side"), F.col("lo"), F.col("hi"))
    theirs = F.struct(F.col("ref_rid").alias("rid"), F.lit(1).alias("side"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))
    wanted = spans.select("span", F.explode(F.array(mine, theirs)).alias("c")).select("span", "c.*")
    # the earliest holder of a common passage has a cut for each later one, so its cuts are spread over salts
    hot = saved(wanted.groupBy(F.col("rid").alias("hot_rid")).agg(F.count("*").alias("n")).where(f"n > {PER_CUT}"), "hot-cuts")
    wanted = wanted.join(sized(hot, 64), F.col("rid") == F.col("hot_rid"), "left")
    salt = F.coalesce(F.pmod(F.xxhash64("span", "side"), F.expr(f"1 + n div {PER_CUT}")), F.lit(0))
    grouped = wanted.groupBy(F.col("rid").alias("cut_rid"), salt.alias("salt")).agg(F.collect_list(F.struct("span", "side", "lo", "hi")).alias("cuts"))
    grouped = saved(grouped, "cuts")
    ids = sized(grouped.select("cut_rid"), 64)
    every = _identified(docs)
    # documents without a match go before the rest are shuffled to their cuts
    there = every.join(ids, F.col("rid") == F.col("cut_rid"), "left_semi").join(grouped, F.col("rid") == F.col("cut_rid"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, span, side, words = [], [], [], []
        for i, cuts in enumerate(batch.column(2).to_pylist()):
            raw = batch.column(1)[i].as_buffer()
            buf = np.frombuffer(raw, np.uint8)
            start, end, _ = K.word_spans(buf, np.array([0, len(buf)]))
            data = bytes(raw)
            for cut in cuts:
                a, b = max(0, cut["lo"]), min(cut["hi"], len(start))
                row.append(i)
                span.append(cut["span"])
                side.append(cut["side"])
                words.append(b" ".join(data[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)) if b > a else b"")
        cols = [pa.array(span, pa.int64()), pa.array(side, pa.int32()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(words, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["span", "side", "doc_id", "words"])

    return map_arrow(there.select("doc_id", "text", "cuts"), fn, f"span bigint, side int, doc_id {kind}, words binary", 8)


def common_runs(a: list[bytes], b: list[bytes], least: int) -> list[tuple[int, int]]:
    """Maximal stretches of at least ``least`` places where both lists agree."""
    n = min(len(a), len(b))
    same = np.fromiter((a[i] == b[i] for i in range(n)), bool, n)
    edge = np.flatnonzero(np.diff(np.r_[0, same.astype(np.int8), 0]))
    return [(x, y) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if y - x >= least]


def _verified(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Common stretches of each (document, earlier document, shift) around the places first to last."""
    lo = F.greatest(F.col("first") - WINDOW, F.lit(0), -F.col("shift"))
    spans = spans.select(
        F.xxhash64("rid", "ref_rid", "shift", "first").alias("span"), "rid", "ref_rid", "shift", lo.cast("int").alias("lo"),
        (F.col("last") + ANCHOR + WINDOW).cast("int").alias("hi"),
    )
    spans = saved(spans, "spans")
    cut = _stretches(docs, spans)
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.struct(c))).alias(f"{c}{k}")
    both = cut.groupBy("span").agg(side(0, "doc_id"), side(1, "doc_id"), side(0, "words"), side(1, "words"))
    both = both.join(spans.select("span", "lo", "shift", "rid"), "span")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, begin, end = [], [], []
        for i, (x, y, lo) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
            for a, b in common_runs(x.split(b" "), y.split(b" "), WINDOW):
                at.append(i)
                begin.append(lo + a)
                end.append(lo + b)
        row = pa.array(at, pa.int64())
        b, e = np.array(begin, np.int32), np.array(end, np.int32)
        cols = [batch.column(0).take(row), batch.column(1).take(row), pa.array(b), pa.array(e), pa.array(b + batch.column(5).to_numpy()[at].astype(np.int32) if at else b), batch.column(6).take(row)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "ref_doc_id", "start_word", "end_word", "ref_start_word", "rid"])

    slim = both.select("doc_id0.doc_id", F.col("doc_id1.doc_id").alias("ref_doc_id"), F.col("words0.words").alias("words"), F.col("words1.words").alias("ref_words"), "lo", "shift", "rid")
    out = map_arrow(slim, fn, f"doc_id {kind}, ref_doc_id {kind}, start_word int, end_word int, ref_start_word int, rid bigint", 64)
    return saved(out.distinct(), "verified")


def _folded(found: DataFrame) -> DataFrame:
    """Matches of one pair of documents at one shift as stretches of places; a gap of over WINDOW words splits them."""
    places = found.groupBy("rid", "ref_rid", "shift").agg(F.sort_array(F.collect_set("place")).alias("p"))
    edge = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get("p", i) - F.get("p", i - 1) > WINDOW))
    cut = places.withColumn("e", edge)
    part = F.posexplode("e")
    rows = cut.select("rid", "ref_rid", "shift", "p", "e", part)
    last = F.get("p", F.coalesce(F.get("e", F.col("pos") + 1), F.size("p")) - 1)
    return rows.select("rid", "ref_rid", "shift", F.get("p", F.col("col")).alias("first"), last.alias("last"))


def _uncovered(stretches: DataFrame, found: DataFrame) -> DataFrame:
    """Stretches of windows (each from its first to its last place) that don't lie in a passage already found in their document."""
    # a document's own passages, as long as it is
    held = found.groupBy(F.col("rid").alias("held_rid")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("held"))
    joined = stretches.join(held, F.col("rid") == F.col("held_rid"), "left")
    inside = F.exists("held", lambda h: (h["start_word"] <= F.col("first")) & (F.col("last") + WINDOW <= h["end_word"]))
    return joined.where(~F.coalesce(inside, F.lit(False))).select(*stretches.columns)


def repeated_passages(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, ref_doc_id, start_word, end_word, ref_start_word of every repeated passage and its earlier occurrence."""
    index = Index(docs.sparkSession)
    try:
        parts = []
        every = _identified(docs)
        for k in range(batches):
            part = F.pmod("rid", F.lit(batches))
            parts.append(index.add(every.where(part == k), every.where(part <= k)))
        matches, windows = (reduce(DataFrame.unionByName, x) for x in zip(*parts, strict=True))
        found = _verified(matches, docs)
        return found.unionByName(_verified(_uncovered(windows, found), docs)).drop("rid").distinct()
    finally:
        index.close()
