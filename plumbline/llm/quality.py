"""Quality classifier: a factorisation machine over words, structure and metadata.

The features of a document are its distinct hashed words (each 1 / sqrt(number of words)),
structure statistics (their values and the interval each falls in) and hashed metadata
(``lang``, ``source``).  The score is

    b + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2 ],

linear in the number of features by the sum-of-squares identity.  A second machine is trained
on ``toxic``, over those hashed words and beginnings of words (``STEMS``, without case) that stand out in
toxic or in other documents; a document is kept if it is good and not toxic.  Training uses at most
``SAMPLE`` labelled documents, drawn by a hash of doc_id (this bound is a parameter and the only
one; scoring covers every document).  Training is seeded and repeatable.

Defined results: a null or empty text has no words and the score of its structure and
metadata; null metadata is a value of its own; label rows without the label trained on or document are
left out, repeated ones count again; without any label of quality every document is kept with score 0.5;
without any of toxicity no document is toxic and that score is null; an empty
table gives an empty result; extra columns pass through ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .work import map_arrow

SAMPLE, WORD_SPACE, META_SPACE, RANK, EPOCHS = 8000, 1 << 15, 1 << 10, 8, 8
THRESHOLD = 0.5
#: Lengths of the beginnings in bytes (0: the word), and the z value from which a feature stands out.
STEMS, STANDS_OUT, STEM_VALUE = (0, 4, 5, 6, 8), 4.0, 0.7

STATS = (
    "words", "word_len", "distinct", "upper", "digit", "symbol", "pipe_bang", "punct", "lines", "line_len",
    "top_run", "odd_end", "non_ascii", "space",
)
BINS = 8
_N_STRUCT = len(STATS) * (1 + BINS)
FEATURES = WORD_SPACE + META_SPACE + _N_STRUCT
_EDGES = {
    "words": [5, 20, 50, 150, 400, 1000, 3000], "word_len": [2.5, 3.5, 4.5, 5.5, 6.5, 8, 12],
    "distinct": [0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8], "lines": [1.5, 3, 6, 10, 20, 50, 200],
    "line_len": [10, 25, 50, 100, 200, 400, 1000],
}
_SHARE = [0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.6]
_CLASS = {}
for _name, _chars in {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "symbol": "#$%&*@^~_=+<>{}[]\\/", "pipe_bang": "|!",
    "punct": ".,;:?'\"-()", "space": " \t",
}.items():
    _CLASS[_name] = np.zeros(256, np.int64)
    _CLASS[_name][[ord(c) for c in _chars]] = 1
_CLASS["non_ascii"] = (np.arange(256) >= 128).astype(np.int64)
_CLASS["newline"] = (np.arange(256) == 10).astype(np.int64)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _structure(buf: np.ndarray, offsets: np.ndarray, start, end, row, hashes, distinct: np.ndarray) -> np.ndarray:
    """(rows, len(STATS)) statistics."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    at = K.row_starts(row, n)
    words = np.diff(at)
    count = np.maximum(words, 1)
    share = {name: _per_row(table[buf], offsets) / size for name, table in _CLASS.items() if name != "newline"}
    lines = _per_row(_CLASS["newline"][buf], offsets) + 1
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    odd = _CLASS["symbol"][buf[end - 1]] if len(end) else np.zeros(0, np.int64)
    odd = odd + (_CLASS["pipe_bang"][buf[end - 1]] if len(end) else 0)
    columns = {
        "words": words, "word_len": _per_row(end - start, at) / count, "distinct": distinct / count, "lines": lines,
        "line_len": np.diff(offsets) / lines, "top_run": _per_row(same, at) / count, "odd_end": _per_row(odd, at) / count,
    } | share
    return np.stack([np.asarray(columns[s], float) for s in STATS], 1)


def features(text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in sparse form: (row starts, feature numbers, values)."""
    sizes, ids, values = [], [], []
    metadata = [lang.cast(pa.string()), source.cast(pa.string())]
    for lo, hi, buf, offsets in K.slices(text):
        n = hi - lo
        start, end, row, hashes = K.words(buf, offsets)
        word_row, word = K.distinct_words(row, hashes)
        distinct = np.bincount(word_row, minlength=n)
        stats = _structure(buf, offsets, start, end, row, hashes, distinct)
        base = WORD_SPACE + META_SPACE
        rows = [word_row]
        cols = [(word % np.uint64(WORD_SPACE)).astype(np.int64)]
        vals = [1 / np.sqrt(np.maximum(distinct, 1))[word_row]]
        for k, column in enumerate(metadata):
            cut = column.slice(lo, n).fill_null("\x00")
            b, o = K.string_buffer(cut)
            h = K.mix(K.span_hashes(b[o[0] : o[-1]], o[:-1] - o[0], o[1:] - o[0]), 11 + k)
            rows.append(np.arange(n))
            cols.append(WORD_SPACE + (h % np.uint64(META_SPACE)).astype(np.int64))
            vals.append(np.full(n, 0.5))
        for k, name in enumerate(STATS):
            x = stats[:, k]
            scaled = np.log1p(x) / 4 if name in ("words", "word_len", "lines", "line_len") else x
            rows += [np.arange(n), np.arange(n)]
            cols += [np.full(n, base + k), base + len(STATS) + k * BINS + np.searchsorted(_EDGES.get(name, _SHARE), x)]
            vals += [scaled, np.full(n, 0.5)]
        r = np.concatenate(rows)
        order = np.argsort(r, kind="stable")
        sizes.append(np.bincount(r, minlength=n))
        ids.append(np.concatenate(cols)[order])
        values.append(np.concatenate(vals)[order])
    if not sizes:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return starts, np.concatenate(ids), np.concatenate(values).astype(np.float32)


def stems(text: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in sparse form: the hashed words and beginnings of words (those ``wanted``), each once, and the last feature."""
    sizes, ids = [], []
    for lo, hi, buf, offsets in K.slices(text):
        n = hi - lo
        start, end, row, _ = K.words(buf, offsets)
        small = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        found = [np.arange(n) * FEATURES + FEATURES - 1]
        for width in STEMS:
            long = end - start >= width
            hashes = K.mix(K.span_hashes(small, start[long], start[long] + width if width else end[long]), 70 + width)
            feature = (hashes % np.uint64(WORD_SPACE)).astype(np.int64)
            r = row[long]
            if wanted is not None:
                r, feature = r[wanted[feature]], feature[wanted[feature]]
            found.append(r * FEATURES + feature)
        pair = np.unique(np.concatenate(found))
        sizes.append(np.bincount(pair // FEATURES, minlength=n))
        ids.append(pair % FEATURES)
    if not sizes:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    every = np.concatenate(ids)
    return np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), every, np.ones(len(every), np.float32)


def score(model: Model, starts: np.ndarray, ids: np.ndarray, values: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Probability of good quality of each row; every row has at least its structure features."""
    out = np.empty(len(starts) - 1)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step, side="right")) - 1)
        cut = slice(starts[lo], starts[hi])
        at = starts[lo:hi] - starts[lo]
        x = values[cut]
        vx = model.factors[ids[cut]] * x[:, None]
        total = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), at)
        linear = np.add.reduceat(model.linear[ids[cut]] * x, at)
        raw = model.bias + linear + 0.5 * ((total**2).sum(1) - squares)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        lo = hi
    return out


def train(starts: np.ndarray, ids: np.ndarray, values: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Logistic loss, Adagrad over batches of rows, L2."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32))
    n = len(labels)
    if not n:
        return model
    p = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    model.bias = float(np.log(p / (1 - p)))
    gb, gl, gf = 1e-6, np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, RANK), 1e-6, np.float32)
    rate, l2 = 0.08, 1e-4
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 128):
            rows = order[lo : lo + 128]
            size = starts[rows + 1] - starts[rows]
            at = np.cumsum(size) - size
            pick = np.repeat(starts[rows] - at, size) + np.arange(size.sum())
            i, x = ids[pick], values[pick]
            vx = model.factors[i] * x[:, None]
            total = np.add.reduceat(vx, at, axis=0)
            raw = model.bias + np.add.reduceat(model.linear[i] * x, at)
            raw = raw + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), at))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            e = np.repeat(error, size)
            uniq, inverse = np.unique(i, return_inverse=True)
            g1 = np.bincount(inverse, e * x, len(uniq)) + l2 * model.linear[uniq]
            inner = (np.repeat(total, size, axis=0) - vx) * (e * x)[:, None]
            g2 = np.stack([np.bincount(inverse, inner[:, f], len(uniq)) for f in range(RANK)], 1) + l2 * model.factors[uniq]
            gl[uniq] += g1**2
            gf[uniq] += g2**2
            gb += error.sum() ** 2
            model.linear[uniq] -= rate * g1 / np.sqrt(gl[uniq])
            model.factors[uniq] -= 0.5 * rate * g2 / np.sqrt(gf[uniq])
            model.bias -= rate * error.sum() / np.sqrt(gb)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on up to ``sample`` labelled documents; only their features reach the driver."""
    return train(*_labelled(docs, labels, "quality", sample))


def fit_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The same for toxicity; None without any label of it."""
    if "toxic" not in labels.columns:
        return None
    starts, ids, _, y = _labelled(docs, labels, "toxic", sample, lambda text, lang, source: stems(text))
    if not len(y):
        return None
    share = y.mean()
    seen = np.bincount(ids, minlength=FEATURES)
    toxic = np.bincount(ids, np.repeat(y, np.diff(starts)), FEATURES)
    wanted = np.abs(toxic - share * seen) > STANDS_OUT * np.sqrt(share * (1 - share) * seen + 1)
    wanted[FEATURES - 1] = True
    kept = wanted[ids]
    starts = np.concatenate([[0], np.cumsum(kept)])[starts]
    ids = ids[kept]
    model = train(starts, ids, np.where(ids == FEATURES - 1, 1, STEM_VALUE).astype(np.float32), y)
    scale = np.where(wanted, STEM_VALUE, 0).astype(np.float32)
    scale[FEATURES - 1] = 1
    return Model(model.bias, model.linear * scale, model.factors * scale[:, None])


def _labelled(docs: DataFrame, labels: DataFrame, target: str, sample: int, features=features) -> tuple[np.ndarray, ...]:
    """Features and labels (0 or 1) of the documents to train on."""
    ok = labels.where(f"doc_id is not null and {target} is not null").select("doc_id", target)
    chosen = ok.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id", target).limit(sample)
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("label_id"), F.col(target).alias("label")))
    docs = _with_columns(docs).select("doc_id", "text", "lang", "source")
    rows = docs.join(chosen, docs["doc_id"] == chosen["label_id"]).select("text", "lang", "source", "label", "label_id")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, ids, values = features(batch.column(0), batch.column(1), batch.column(2))
        split = lambda x, kind: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, kind))
        cols = [batch.column(3).cast(pa.int32()), batch.column(4).cast(pa.int64()), split(ids, pa.int32()), split(values, pa.float32())]
        return pa.RecordBatch.from_arrays(cols, names=["label", "label_id", "ids", "vals"])

    got = map_arrow(rows, fn, "label int, label_id bigint, ids array<int>, vals array<float>").toArrow()
    got = got.sort_by([("label_id", "ascending"), ("label", "ascending")]).combine_chunks()
    if not got.num_rows:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0)
    ids, vals = got["ids"].chunk(0), got["vals"].chunk(0)
    starts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
    y = (got["label"].to_numpy() > 0).astype(float)
    return starts, ids.flatten().to_numpy().astype(np.int64), vals.flatten().to_numpy(), y


def _with_columns(docs: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in ("lang", "source") if c not in docs.columns}
    return docs.withColumns(missing) if missing else docs


def _judged(model: Model, toxic: Model | None, threshold: float, text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Probability of good quality and of toxicity, and what is kept."""
    p = score(model, *features(text, lang, source))
    if toxic is None:
        return p, None, p >= threshold
    q = score(toxic, *stems(text, toxic.linear != 0))
    return p, q, (p >= threshold) & (q < THRESHOLD)


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD, toxic: Model | None = None) -> DataFrame:
    """doc_id, score (probability of good quality), toxic_score (null without a model of it) and keep for every row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, q, keep = _judged(model, toxic, threshold, *(batch.column(i) for i in (1, 2, 3)))
        bad = pa.nulls(len(p), pa.float64()) if q is None else pa.array(q)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), bad, pa.array(keep)], names=["doc_id", "score", "toxic_score", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = _with_columns(docs).select("doc_id", "text", "lang", "source")
    return map_arrow(slim, fn, f"doc_id {kind}, score double, toxic_score double, keep boolean")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, toxic: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifiers accept."""
    added = [c for c in ("lang", "source") if c not in docs.columns]
    full = _with_columns(docs)
    at = [full.columns.index(c) for c in ("text", "lang", "source")]
    inner = full.toDF(*[f"c{i}" for i in range(len(full.columns))])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_judged(model, toxic, threshold, *(batch.column(i) for i in at))[2]))

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(full.schema.fields))
    return map_arrow(inner, fn, schema).toDF(*full.columns).drop(*added)
