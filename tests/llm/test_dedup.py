import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import exact, simhash
from plumbline.llm import kernels as K

from .common import CLASH, LONG, awkward, clashing, empty, prose, table


def test_fingerprints_compose_and_are_the_polynomial():
    text = (prose(5, 3000) * 12).encode()
    a, _, n = exact.fingerprints(pa.array([text.decode()]))
    h = 0
    for byte in text:
        h = (h * exact.BASES[0] + byte + 1) % exact.P
    assert a[0] == h and n[0] == len(text) > exact.CHUNK
    cut = 70_001
    parts = [int(exact.fingerprints(pa.array([t.decode()]))[0][0]) for t in (text[:cut], text[cut:])]
    assert exact.combine(parts[0], parts[1], len(text) - cut) == h


def _want(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text, []).append(doc_id)
    out = []
    for ids in groups.values():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], k == 0) for k, i in enumerate(ids)]
    return sorted(map(str, out))


def test_exact_groups_match_brute_force(spark):
    got = exact.exact_groups(table(spark)).select("doc_id", "group_id", "keep").collect()
    assert sorted(str(tuple(r)) for r in got) == _want(awkward())


def test_exact_dedup_keeps_one_of_each_text(spark):
    out = exact.exact_dedup(clashing(spark)).collect()
    assert sorted(str(r["text"]) for r in out) == sorted({str(r[1]) for r in awkward()} | set())
    assert list(out[0].asDict())[: len(CLASH)] == CLASH
    assert exact.exact_dedup(empty(spark)).count() == 0 and exact.exact_groups(empty(spark)).count() == 0


def test_a_collision_is_not_merged(monkeypatch, spark):
    text = ["abc", "abd", "abc", "caf\u00e9", "\u6f22\u5b57", "abc"]
    rows = [(1, 2, 3, 6, k, 7 + k, t) for k, t in enumerate(text)]
    copies = spark.createDataFrame(rows, f"{exact.FP}, n bigint, lane bigint, c0 bigint, c1 string")
    for per in (512, 2):
        monkeypatch.setattr(exact, "PER_SALT", per)
        kept, every = exact._held(copies, "c0", "c1")
        assert sorted(r[0] for r in kept.collect()) == [0, 1, 3, 4]
        got = sorted((r["doc_id"], r["group_id"], r["first_copy"]) for r in every.collect())
        assert got == [(7, 7, True), (8, 8, True), (9, 7, False), (10, 10, True), (11, 11, True), (12, 7, False)]


@pytest.mark.parametrize("text", ["abc", "caf\u00e9", "\u6f22\u5b57 \U0001f642", ""])
def test_equal_bytes_are_equal(text):
    raw = pa.array([text])[0].as_buffer()
    assert exact._same(raw, text.encode()) and not exact._same(raw, text.encode() + b"x")


def test_huge_documents_are_hashed_in_pieces(spark, monkeypatch):
    docs = table(spark, [*awkward(), (20, LONG + "x", "en", "s", 1), (20, LONG + "x", "en", "s", 1)])
    found = exact.huge_fingerprints(docs, 1000, 70_000).collect()
    texts = {LONG, LONG + "x", *(r[1] for r in awkward() if r[1] and len(r[1].encode()) > 1000)}
    want = list(zip(*(x.tolist() for x in exact.fingerprints(pa.array(sorted(texts)))), strict=True))
    assert {(r["fp_a"], r["fp_b"], r["fp_bytes"]) for r in found} == set(want) and len(found) > 2
    whole = exact.exact_groups(docs).select("doc_id", "group_id", "keep").collect()
    cut = exact.exact_groups(docs, 1000).select("doc_id", "group_id", "keep").collect()
    assert sorted(map(str, whole)) == sorted(map(str, cut))
    assert sorted(str(r["text"]) for r in exact.exact_dedup(docs, 1000).collect()) == sorted(str(r["text"]) for r in exact.exact_dedup(docs).collect())


def test_exact_groups_equal_sql(spark):
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'" if os.path.isdir(f"{d}/documents.parquet") else f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(db.execute(exact.ORACLE).fetchall())
    got = exact.exact_groups(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "group_id", "keep").collect()
    assert sorted(map(tuple, got)) == want
    assert any(not r[2] for r in want)


def _corpus():
    rows = []
    for g in range(12):
        base = prose(100 + g, 200).split()
        for k in range(6):
            words = list(base)
            for i in np.random.default_rng(g * 10 + k).choice(200, 2 * k, replace=False):
                words[i] = prose(int(i) * 100 + g * 7 + k, 1)
            rows.append((g * 10 + k, " ".join(words), "en", "s", 0))
    return rows


def test_simhash_is_the_majority_vote():
    column = pa.array([prose(9, 50), "", None, "Same same, SAME!"])
    fp, count = simhash.fingerprints(column)
    for i, text in enumerate(column.to_pylist()):
        words = {w.strip(".,!").lower() for w in (text or "").split()}
        assert count[i] == len(words)
    buf, offsets = K.string_buffer(column)
    _, _, row, hashes = K.words(K.folded(buf[offsets[0] : offsets[-1]]), offsets - offsets[0], K.PUNCTUATION)
    row, hashes = K.distinct_words(row, hashes)
    mine = hashes[row == 0]
    bits = np.concatenate([((K.mix(mine, 20 + k)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)) for k in range(5)], 1)
    votes = bits.astype(int).sum(0) * 2 > len(mine)
    got = np.unpackbits(fp[0].view(np.uint8), bitorder="little").astype(bool)
    order = np.array([k * 64 + (j % 16) + 16 * (j // 16) for k in range(5) for j in range(64)])
    assert (got == votes[order]).all()


def _components(n, edges):
    label = list(range(n))
    for i, j in edges:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_near_groups_against_brute_force(spark):
    rows = _corpus()
    fp, _ = simhash.fingerprints(pa.array([r[1] for r in rows]))
    d = sum(np.bitwise_count(fp[:, None, k] ^ fp[None, :, k]).astype(int) for k in range(5))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if d[i, j] <= simhash.DISTANCE]
    label = _components(len(rows), pairs)
    got = {r["doc_id"]: (r["group_id"], r["keep"]) for r in simhash.near_groups(table(spark, rows)).collect()}
    together = [(i, j) for i, j in pairs if got[rows[i][0]][0] == got[rows[j][0]][0]]
    assert len(together) >= 0.9 * len(pairs) and len(pairs) > 30
    for i, r in enumerate(rows):  # nothing beyond the components is joined
        assert label[i] == label[[x[0] for x in rows].index(got[r[0]][0])]
    kept = {r["doc_id"] for r in simhash.near_dedup(table(spark, rows)).collect()}
    assert kept == {i for i, (_, keep) in got.items() if keep}


def test_near_awkward_rows(spark):
    got = simhash.near_groups(table(spark)).collect()
    assert len(got) == len(awkward())
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["group_id"], r["keep"]))
    assert by_id[3] == [(1, False)] and sorted(by_id[2]) == [(1, False), (1, False)] and by_id[1] == [(1, True)]
    assert by_id[6] == [(6, True)] and by_id[7] == [(7, True)] and by_id[8] == [(8, True)]  # no word, no neighbour
    assert by_id[10] == [(10, True)] and by_id[11] == [(10, False)]
    out = simhash.near_dedup(clashing(spark)).collect()
    assert len(out) == sum(r["keep"] for r in got) and list(out[0].asDict())[: len(CLASH)] == CLASH
    assert simhash.near_groups(empty(spark)).count() == 0 and simhash.near_dedup(empty(spark)).count() == 0


def test_large_buckets_report_a_spanning_forest():
    base = np.random.default_rng(3).integers(0, 2**63, 5).astype(np.uint64)
    fp = np.repeat(base[None], 300, 0)
    fp[150:] = ~fp[150:]
    for i in range(300):
        fp[i, 0] ^= np.uint64(i)
    i, j = simhash.bucket_edges(np.zeros(300, np.int64), fp, 54)
    label = _components(300, list(zip(i.tolist(), j.tolist(), strict=True)))
    assert len(i) == 298 and len(set(label)) == 2


def _within(fp, limit):
    found = []
    for lo in range(0, len(fp), 500):
        d = sum(np.bitwise_count(fp[lo : lo + 500, None, k] ^ fp[None, :, k]).astype(np.int16) for k in range(5))
        i, j = np.nonzero(d <= limit)
        found.append(np.stack([i + lo, j])[:, i + lo < j])
    return np.concatenate(found, 1)


def _apart(bits, seed):
    """Two fingerprints that differ in ``bits`` bits, spread evenly, so that they agree on no short block."""
    a = np.random.default_rng(seed).integers(0, 2, 320).astype(np.uint8)
    b = a.copy()
    b[(np.arange(bits) * 320 // bits + seed) % 320] ^= 1
    return np.packbits(np.stack([a, b]), axis=1, bitorder="little").view(np.uint64)


def _nodes(spark, fp):
    rows = [(i, *f) for i, f in enumerate(fp.view(np.int64).tolist())]
    return spark.createDataFrame(rows, f"node bigint, {simhash.F_SCHEMA}")


@pytest.mark.parametrize("sizes", [{}, {"ALONE": 50}, {"CHUNK": 70}, {"CHUNK": 20, "KEYS": 999}])
def test_no_link_within_the_threshold_is_lost(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(simhash, name, value)
    fp = np.concatenate([_apart(54 if s % 2 else 55, s) for s in range(80)])
    got = {(r["a"], r["b"]) for r in simhash.near_edges(_nodes(spark, fp)).collect()}
    assert got == {(2 * s, 2 * s + 1) for s in range(80) if s % 2}


def test_near_pairs_are_those_of_brute_force(spark, monkeypatch):
    text = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(6000).toArrow().column(0).combine_chunks()
    fp, count = simhash.fingerprints(text)
    fp = np.unique(fp[count > 0], axis=0)
    want = simhash.Forest(len(fp))
    want.add(*_within(fp, simhash.DISTANCE))
    for long, shares in ((32, 1), (2, 3)):
        monkeypatch.setattr(simhash, "LONG", long)
        got = simhash.Forest(len(fp))
        for s in range(shares):
            i, j = simhash.near_pairs(fp, simhash.DISTANCE, s, shares)
            assert (np.bitwise_count(fp[i] ^ fp[j]).sum(1) <= simhash.DISTANCE).all()
            got.add(i, j)
        assert (got.label == want.label).all() and len(set(want.label)) < len(fp)


@pytest.mark.parametrize("limit", [0, 3, 15, 54, 70])
def test_other_thresholds_lose_nothing_either(limit):
    fp = np.concatenate([_apart(max(1, limit + s % 2), s) for s in range(30)])
    i, j = simhash.near_pairs(fp, limit)
    assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == set(map(tuple, _within(fp, limit).T.tolist()))
    assert simhash.near_pairs(fp[:0], limit)[0].size == 0
