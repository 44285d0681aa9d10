"""Best-fit packing by a grouping genetic algorithm on islands.

A document goes into bins of ``CAPACITY`` tokens, counted like ``tokencount`` does.  A longer one is cut between pre-tokens (one that alone
is longer, between characters) into pieces that fill a bin as far as that goes, and a rest.  A piece is a range of characters, so
``sequences`` can write what a bin holds.  Pieces are hashed into
regions of about ``REGION`` pieces; each region is bred on ``ISLANDS`` islands, which are
separate tasks with their own seeds.  Chromosomes are lists of bins.  Crossover injects the
best-filled bins of one parent into the other, removes the bins that now hold a piece twice and
best-fits the pieces displaced by that; mutation dissolves the emptiest bins.  Fewer bins are fitter; among
equals the mean squared fill decides, which favours full bins.  After each epoch the elite of every
island migrates to the next one in a ring.  The best island of each region gives the bins.

Populations start from best-fit decreasing, so a result is never worse than it.  An island whose best
has as few bins as the tokens need (their sum over the capacity, rounded up) stops, as no other can have fewer.
Seeds depend on the region and island alone: a lost task is repeated with the same result.

Defined results: null and empty texts have size 0 and get bin -1 (nothing to pack); ties of size go by doc_id and piece; repeated
rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import counted
from .tokencount import BATCH_CHARS, count_piece
from .vocab import VOCABULARY
from .work import map_arrow, saved

CAPACITY, REGION, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 4096, 3, 3, 16, 6

Bin = list[int]


def best_fit(order: list[int], sizes: list[int], bins: list[Bin], capacity: int) -> list[Bin]:
    """Put each piece into the fullest bin that still takes it, opening new ones as needed."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, k = capacity - sizes[i], len(bins) - 1
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            left -= sizes[i]
        if left:
            bisect.insort(room, (left, k))
    return bins


def fitness(bins: list[Bin], sizes: list[int], capacity: int) -> float:
    """Larger is fitter: a bin less outweighs any difference of the mean squared fill, which is below 1."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1) - len(bins)


def crossover(a: list[Bin], b: list[Bin], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[Bin]:
    """Inject well-filled bins of ``b`` into ``a``."""
    fill = [sum(sizes[i] for i in x) for x in b]
    best = sorted(range(len(b)), key=lambda k: -fill[k])[: max(1, len(b) // 2)]
    injected = [b[k] for k in best if rng.random() < 0.5] or [b[best[0]]]
    there = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if there.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in there]
    displaced.sort(key=lambda i: (-sizes[i], i))
    return best_fit(displaced, sizes, kept + [list(x) for x in injected], capacity)


def mutate(bins: list[Bin], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[Bin]:
    """Dissolve some of the emptiest bins and fit their pieces again in a random order."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = set(order[: max(1, len(bins) // 20)])
    gone |= {k for k in order if rng.random() < 0.02}
    loose = [i for k in gone for i in bins[k]]
    loose = [loose[k] for k in rng.permutation(len(loose))]
    return best_fit(loose, sizes, [list(b) for k, b in enumerate(bins) if k not in gone], capacity)


def evolve(sizes: list[int], start: list[list[Bin]], capacity: int, seed: int) -> list[Bin]:
    """The best chromosome after GENERATIONS, or one with the fewest bins there can be; ``start`` may hold none."""
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    down = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    population = list(start) or [best_fit(down, sizes, [], capacity)]
    rate = lambda c: fitness(c, sizes, capacity)
    if (best := max(population, key=rate)) and len(best) <= least:
        return best
    while len(population) < POPULATION:
        population.append(best_fit(rng.permutation(len(sizes)).tolist(), sizes, [], capacity))
    ranked = sorted(population, key=rate, reverse=True)
    for _ in range(GENERATIONS):
        if len(ranked[0]) <= least:
            break
        i, j = rng.choice(len(ranked), 2, replace=False).tolist()
        child = crossover(ranked[min(i, j)], ranked[max(i, j)], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        ranked = sorted([*ranked, child], key=rate, reverse=True)[:POPULATION]
    return ranked[0]


def _numbers(bins: list[Bin], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(numbers: list[int]) -> list[Bin]:
    out: list[Bin] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        out[k].append(i)
    return out


def _epoch(capacity: int, epoch: int):
    """Over one island: its own solution (none at first) and that of the island before it, by region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                sizes = list(map(int, r.sizes))
                start = [_bins(list(map(int, s))) for s in (r.own, r.elite) if s is not None and len(s)]
                best = evolve(sizes, start, capacity, (int(r.region) * 31 + int(r.island)) * 31 + epoch)
                out.append((r.region, r.island, _numbers(best, len(sizes)), fitness(best, sizes, capacity)))
            yield pd.DataFrame(out, columns=["region", "island", "own", "fit"])

    return run


def _fitting(part: str, capacity: int, path: str) -> int:
    """How many characters of a long pre-token to take: near as many as fit.  A character has at most four bytes, and so tokens."""
    low, high = max(1, capacity // 4), min(len(part), 16 * capacity)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if count_piece(part[:middle], path) <= capacity else (low, middle - 1)
    return low


def _cut(text: str, begin: np.ndarray, count: np.ndarray, capacity: int, path: str) -> list[tuple[int, int, int]]:
    """(first character, end, tokens) of the pieces of a text, from the places and tokens of its pre-tokens."""
    out: list[tuple[int, int, int]] = []
    end, total = np.append(begin[1:], len(text)).tolist(), np.append(0, np.cumsum(count))
    reach = lambda k, room: int(np.searchsorted(total, total[k] + room, "right")) - 1
    k = 0
    while k < len(count):
        if count[k] > capacity:  # its parts begin pieces
            at, part = int(begin[k]), text[int(begin[k]) : end[k]]
            while part:
                n = _fitting(part, capacity, path)
                out.append((at, at + n, count_piece(part[:n], path)))
                at, part = at + n, part[n:]
            j = reach(k + 1, capacity - out[-1][2])
            if j > k + 1:
                out[-1] = (out[-1][0], end[j - 1], out[-1][2] + int(total[j] - total[k + 1]))
        else:
            j = reach(k, capacity)
            out.append((int(begin[k]), end[j - 1], int(total[j] - total[k])))
        k = max(j, k + 1)
    return out


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_CHARS characters."""
    lo, chars = 0, 0
    for hi, text in enumerate(texts, 1):
        chars += len(text or "")
        if chars >= BATCH_CHARS or hi == len(texts):
            yield lo, hi
            lo, chars = hi, 0


def cuts(texts: list[str | None], capacity: int, path: str = VOCABULARY) -> list[list[tuple[int, int, int]]]:
    """(first character, end, tokens) of the pieces, each of at most ``capacity`` tokens, of every text."""
    out = []
    for lo, hi in _batches(texts):
        begin, count, bounds = counted(texts[lo:hi], path)
        total, own = np.append(0, np.cumsum(count)), np.searchsorted(begin, bounds)
        size = np.diff(total[own]).tolist()
        for i, n in enumerate(size):
            text = texts[lo + i] or ""
            if n <= capacity:
                out.append([(0, len(text), n)])
            else:
                a, b = own[i], own[i + 1]
                out.append(_cut(text, begin[a:b] - bounds[i], count[a:b], capacity, path))
    return out


def pieces(docs: DataFrame, capacity: int, path: str = VOCABULARY) -> DataFrame:
    """doc_id, piece (its number), from_char, to_char and size (in tokens) of what has to be packed."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, number, spans = [], [], []
        for i, own in enumerate(cuts(batch.column(1).to_pylist(), capacity, path)):
            row += [i] * len(own)
            number += range(len(own))
            spans += own
        cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array([x[k] for x in spans], pa.int32()) for k in range(3))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "from_char", "to_char", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), fn, f"doc_id {kind}, piece int, from_char int, to_char int, size int")


def pack(docs: DataFrame, capacity: int = CAPACITY, region: int = REGION, path: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, from_char, to_char, size, bin_id and start (the token in its bin) of every piece of every row."""
    # the number of regions follows the number of pieces
    every = saved(pieces(docs, capacity, path), "pieces")
    loose = every.where(f"size > 0 and size < {capacity}")
    n = max(1, -(-loose.count() // region))
    keyed = loose.withColumn("region", F.pmod(F.xxhash64("doc_id", "piece", "size", F.monotonically_increasing_id()), F.lit(n)))
    item = F.struct("size", "doc_id", "piece", "from_char", "to_char")
    grouped = keyed.groupBy("region").agg(F.sort_array(F.collect_list(item)).alias("items"))
    grouped = saved(grouped.withColumn("sizes", F.expr("transform(items, x -> x.size)")), "regions")
    islands = grouped.select("region", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    none = F.lit(None).cast("array<int>")
    state = islands.select("region", "island", "sizes", none.alias("own"), none.alias("elite"))
    schema = "region bigint, island int, own array<int>, fit double"
    tasks = min(n * ISLANDS, 20_000)
    for epoch in range(EPOCHS):
        solved = saved(state.repartition(tasks, "region", "island").mapInPandas(_epoch(capacity, epoch), schema), "islands")
        if epoch + 1 < EPOCHS:
            ring = solved.select("region", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("own").alias("elite"))
            state = islands.join(solved.drop("fit"), ["region", "island"]).join(ring, ["region", "island"])
            state = state.select("region", "island", "sizes", "own", "elite")
    best = solved.groupBy("region").agg(F.max_by("own", F.struct("fit", -F.col("island"))).alias("best"))
    own = ["doc_id", "piece", "from_char", "to_char", "size"]
    placed = grouped.join(best, "region").select("region", F.explode(F.arrays_zip("items", "best")).alias("p"))
    placed = placed.select(*(F.col(f"p.items.{c}").alias(c) for c in own), F.concat_ws("-", "region", "p.best").alias("bin_id"))
    start = F.expr("sum(size) over (partition by bin_id order by size desc, doc_id, piece rows unbounded preceding) - size")
    placed = placed.select(*own, "bin_id", start.cast("int").alias("start"))
    whole = every.where(f"size = {capacity}")
    whole = whole.select(*own, F.concat_ws("-", F.lit("full"), F.monotonically_increasing_id()).alias("bin_id"), F.lit(0).alias("start"))
    empty = every.where("size = 0").select(*own, F.lit("-1").alias("bin_id"), F.lit(0).alias("start"))
    return placed.unionByName(whole).unionByName(empty)


def sequences(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """bin_id, n_tokens, doc_ids and texts (of the pieces, in order of start) of every bin of ``pack``; doc_id must tell rows apart.

    A bin is bounded by the capacity, so its texts fit in one row.
    """
    there = placed.where("bin_id <> '-1'").withColumnRenamed("doc_id", "placed_id")
    joined = docs.select("doc_id", "text").join(there, F.col("doc_id").eqNullSafe(F.col("placed_id")))
    text = F.expr("substring(text, from_char + 1, to_char - from_char)")
    held = joined.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("start", "doc_id", "piece", text.alias("text")))).alias("held"), F.sum("size").alias("n_tokens"))
    return held.select("bin_id", "n_tokens", F.col("held.doc_id").alias("doc_ids"), F.col("held.text").alias("texts"))
