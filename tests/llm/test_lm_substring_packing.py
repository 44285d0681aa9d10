import collections
import itertools
import math

import numpy as np
import pytest

from plumbline.llm import lm, packing, substring, tokencount
from plumbline.llm.eliasfano import EliasFano

from .common import LONG, awkward, clashing, empty, prose, table


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0, 7], sorted(np.random.default_rng(1).integers(0, 10**9, 3000).tolist()), list(range(5000)), [2**40, 2**40 + 1]])
def test_elias_fano(values):
    v = np.array(values, np.int64)
    ef = EliasFano.build(v, int(v.max(initial=0)) + 1)
    assert ef.access(np.arange(len(v))).tolist() == values
    if len(v):
        at, hit = ef.successor(v)
        assert hit.all() and (v[at] == v).all()
        probe = np.random.default_rng(2).integers(0, int(v.max()) + 1, 500)
        assert (ef.successor(probe)[1] == np.isin(probe, v)).all()


def _brute(rows, min_count=2, prune=2, discount=0.75):
    texts = [(r[1] or "").split() for r in rows]
    seen = collections.Counter(w for t in texts for w in t)
    texts = [[w if seen[w] >= min_count else None for w in t] for t in texts]
    c1 = collections.Counter(w for t in texts for w in t)
    c2 = collections.Counter(p for t in texts for p in zip(t, t[1:], strict=False))
    c3 = collections.Counter(p for t in texts for p in zip(t, t[1:], t[2:], strict=False))
    k2 = {k: (v - discount) / c1[k[0]] for k, v in c2.items() if v >= prune}
    k3 = {k: (v - discount) / c2[k[:2]] for k, v in c3.items() if v >= prune and k[:2] in k2}
    left2, left3 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for kept, left in ((k2, left2), (k3, left3)):
        for k, p in kept.items():
            left[k[:-1]] -= p
    out = []
    for t in texts:
        total = 0.0
        for i, w in enumerate(t):
            p = c1[w] / sum(c1.values())
            if i:
                p = k2.get((t[i - 1], w), 0) + left2[(t[i - 1],)] * p
            if i > 1:
                p = k3.get((t[i - 2], t[i - 1], w), 0) + left3[(t[i - 2], t[i - 1])] * p
            total += math.log(p)
        out.append((len(t), total))
    return out


def test_scores_equal_brute_force_up_to_quantisation(spark):
    rows = [*awkward(), *[(100 + i, prose(i % 7, 80) + " " + prose(i, 30), "en", "s", 0) for i in range(20)]]
    docs = clashing(spark, rows)
    got = lm.scores(docs, lm.build(docs)).collect()
    want = _brute(rows)
    key = lambda r: (str(r[0]), r[1], round(r[2]))
    a = sorted(((r["doc_id"], r["n_words"], r["log_prob"]) for r in got), key=key)
    b = sorted(((r[0], n, lp) for r, (n, lp) in zip(rows, want, strict=True)), key=key)
    for x, y in zip(a, b, strict=True):
        assert x[:2] == y[:2] and abs(x[2] - y[2]) <= 0.05 * max(1, x[1])
    assert all(r["perplexity"] is None for r in got if not r["n_words"])


def test_lm_of_an_empty_table(spark):
    trie = lm.build(empty(spark))
    assert lm.scores(empty(spark), trie).count() == 0
    assert lm.scores(table(spark, [(1, "a b c", "en", "s", 5)]), lm.build(table(spark, [(1, "a b c", "en", "s", 5)]))).first()["n_words"] == 3


def _windows(rows):
    seen, where = {}, collections.defaultdict(set)
    for doc_id, text in {(r[0], r[1] or "") for r in rows}:
        words = text.split()
        for p in range(len(words) - substring.WINDOW + 1):
            where[tuple(words[p : p + substring.WINDOW])].add((doc_id, p))
    del seen
    return [w for w in where.values() if len(w) > 1]


def _found(got):
    cover = collections.defaultdict(set)
    for r in got:
        n = r["end_word"] - r["start_word"] - substring.WINDOW + 1
        cover[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + n))
        cover[r["ref_doc_id"]] |= set(range(r["ref_start_word"], r["ref_start_word"] + n))
    return cover


def _passages():
    shared = [prose(900 + i, 50 + 7 * i) for i in range(6)]
    rows = [(i, f"{prose(i, 90)} {shared[i % 6]} {prose(1000 + i, 40)}", "en", "s", 0) for i in range(30)]
    return [*rows, *[(40 + i, prose(2000 + i, 300), "en", "s", 0) for i in range(5)], (60, "so " * 400, "en", "s", 0)]


@pytest.mark.parametrize("batches", [1, 5])
def test_passages_against_brute_force(spark, batches):
    rows = _passages()
    got = substring.repeated_passages(table(spark, rows), batches).collect()
    texts = {r[0]: (r[1] or "").split() for r in rows}
    for r in got:
        n = r["end_word"] - r["start_word"]
        assert n >= substring.WINDOW
        assert texts[r["doc_id"]][r["start_word"] : r["end_word"]] == texts[r["ref_doc_id"]][r["ref_start_word"] : r["ref_start_word"] + n]
    cover = _found(got)
    want = [(d, p) for w in _windows(rows) for d, p in w]
    found = sum(p in cover[d] for d, p in want)
    assert found >= 0.98 * len(want) > 0
    assert not any(cover[40 + i] for i in range(5))


@pytest.mark.parametrize("batches", [1, 4])
def test_no_passage_is_lost_to_an_earlier_holder_of_a_part_of_it(spark, batches):
    """Quotes of 30 to 49 words and edited copies besides whole passages of 50 to 60: whichever comes first, every whole one is found."""
    rows = []
    for g in range(8):
        passage = prose(5000 + g, 50 + g % 4 * 3).split()
        for i in range(24):
            part = passage
            if i % 3 == 1:
                a = i % 12
                part = passage[a : a + 38]
            elif i % 3 == 2:
                part = [*passage[: 30 + i % 8], "edited", *passage[31 + i % 8 :]]
            rows.append((g * 100 + i, f"{prose(6000 + g * 100 + i, 60)} {' '.join(part)} {prose(9000 + g * 100 + i, 50)}", "en", "s", 0))
    cover = _found(substring.repeated_passages(table(spark, rows), batches).collect())
    want = [(d, p) for w in _windows(rows) for d, p in w]
    assert len(want) > 300 and all(p in cover[d] for d, p in want)


def test_passages_on_awkward_rows(spark):
    got = substring.repeated_passages(clashing(spark)).collect()
    pairs = {frozenset((r["doc_id"], r["ref_doc_id"])) for r in got}
    assert any({10, 11} >= p for p in pairs) and frozenset((1, 2)) in {p for p in pairs} | {frozenset((1, 3)), frozenset((1, 2))}
    assert not any(i in p for p in pairs for i in (5, 6, 7, 8, 9, 12))
    assert substring.repeated_passages(empty(spark)).count() == 0
    assert LONG


def _check_bins(rows, got, capacity):
    """Brute force: every token is placed once, within the capacity, and the pieces are the texts."""
    spans, fill = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append((r["piece"], r["from_char"], r["to_char"], r["size"]))
        if r["bin_id"] != "-1":
            fill[r["bin_id"]].append((r["start"], r["size"]))
    want = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        want[doc_id] += [(k, a, b, tokencount.count_tokens([text[a:b] if text else ""])[0]) for k, (a, b, _) in enumerate(packing.cuts([text], capacity)[0])]
        assert "".join(text[a:b] for a, b, _ in packing.cuts([text], capacity)[0]) == text if text else True
    assert {d: sorted(x) for d, x in spans.items()} == {d: sorted(x) for d, x in want.items()}
    for pieces in fill.values():
        at = 0
        for start, size in sorted(pieces):
            assert start == at
            at += size
        assert at <= capacity
    return fill


def test_packing_on_awkward_rows(spark):
    got = packing.pack(clashing(spark), 200, 8).collect()
    _check_bins(awkward(), got, 200)
    assert sum(r["bin_id"] == "-1" for r in got) == sum(not r[1] for r in awkward())
    assert packing.pack(empty(spark)).count() == 0


def _ties():
    return [(i, "a" + " b" * (137 * i % 190), "en", "s", 0) for i in range(150)] + [(200 + i, "a" + " b" * 99, "en", "s", 0) for i in range(50)]


def test_packing_is_no_worse_than_best_fit_decreasing(spark):
    rows = _ties()
    got = packing.pack(table(spark, rows), 200, 1000).collect()
    fill = _check_bins(rows, got, 200)
    sizes = [n for r in rows for _, _, n in packing.cuts([r[1]], 200)[0]]
    assert sizes == tokencount.count_tokens([r[1] for r in rows])
    down = packing.best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, [], 200)
    assert -(-sum(sizes) // 200) <= len(fill) <= len(down)
    again = packing.pack(table(spark, rows), 200, 1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_packed_sequences_hold_the_texts(spark):
    rows = [*_ties()[:40], (300, LONG[:4000], "en", "s", 0), (301, "é 漢字🙂" * 300, "en", "s", 0), (302, "x" * 3000 + "🙂" * 400, "en", "s", 0)]
    docs = table(spark, rows)
    placed = packing.pack(docs, 200, 1000)
    out = packing.sequences(docs, placed).collect()
    assert sum(len(t) for r in out for t in r["texts"]) == sum(len(r[1]) for r in rows) and all(r["n_tokens"] <= 200 for r in out)
    _check_bins(rows, placed.collect(), 200)


def test_a_small_case_is_packed_as_well_as_can_be():
    """Against every assignment of pieces to bins."""
    rng = np.random.default_rng(1)
    for seed in range(12):
        sizes = rng.integers(20, 70, 7).tolist()
        best = min(
            max(a) + 1 for a in itertools.product(*(range(k + 1) for k in range(7)))
            if all(sum(s for s, x in zip(sizes, a, strict=True) if x == b) <= 100 for b in range(7))
        )
        assert len(packing.evolve(sizes, [], 100, seed)) == best


def test_breeding_finds_fewer_bins_than_best_fit_decreasing():
    sizes = np.random.default_rng(5).integers(180, 420, 400).tolist()
    down = packing.best_fit(sorted(range(400), key=lambda i: (-sizes[i], i)), sizes, [], 1000)
    assert len(packing.evolve(sizes, [], 1000, 3)) < len(down)


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 900, 200).tolist()
    a = packing.best_fit(list(range(200)), sizes, [], 1000)
    b = packing.best_fit(rng.permutation(200).tolist(), sizes, [], 1000)
    for child in (packing.crossover(a, b, sizes, 1000, rng), packing.mutate(a, sizes, 1000, rng)):
        assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(sizes[i] for i in x) <= 1000 for x in child)
