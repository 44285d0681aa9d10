import base64
import random

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bpe, pretokens, tokencount
from plumbline.llm.vocab import SPLIT, VOCABULARY, vocabulary

from .common import awkward, clashing, empty, table

with open(VOCABULARY, "rb") as _f:
    _RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _f)}
ORACLE = tiktoken.Encoding("own", pat_str=SPLIT.pattern, mergeable_ranks=_RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_and_ids_equal_another_implementation(text):
    want = ORACLE.encode_ordinary(text)
    assert tokencount.count_tokens([text]) == [len(want)]
    assert np.frombuffer(bpe.codec().encode(text), "<i4").tolist() == want
    back = bpe.codec().decode(np.array(want, np.int64)).tobytes().decode()
    assert back == text


def test_merging_is_synchronous_over_ragged_pieces():
    pieces = [b"a", b"hello", b" there", b"x" * 300, "é".encode(), b" antidisestablishmentarianism"]
    want = [len(ORACLE.encode_ordinary(p.decode())) for p in pieces]
    assert tokencount.merge_counts(pieces, vocabulary()).tolist() == want


def test_long_pieces_go_by_rank():
    rng = random.Random(8)
    pieces = [b"x" * 300, b"ab" * 500, b"a" * tokencount.LONG, b"a" * (tokencount.LONG + 1)]
    pieces += ["".join(rng.choice("aab") for _ in range(rng.randint(1, 500))).encode() for _ in range(200)]
    pieces += ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(250, 3000))).encode() for _ in range(40)]
    want = [len(ORACLE.encode_ordinary(p.decode())) for p in pieces]
    assert tokencount.merge_counts(pieces, vocabulary()).tolist() == want
    one = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    assert tokencount.count_tokens([one]) == [len(ORACLE.encode_ordinary(one))]


def test_edits_and_appends_encode_only_nearby():
    rng = random.Random(2)
    text = bpe.EditableText(bpe.codec(), "The quick brown fox. " * 300)
    alphabet = "ab é'st12  \n\t!?the "
    for k in range(120):
        n = len(text.text)
        a = rng.randrange(n + 1)
        before = text.encoded
        if k % 3:
            text.replace(a, min(n, a + rng.randrange(6)), "".join(rng.choice(alphabet) for _ in range(rng.randrange(9))))
        else:
            text.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(9))))
        assert text.ids() == ORACLE.encode_ordinary(text.text)
        assert text.encoded - before < 200
    prefixes = bpe.Prefixes(bpe.codec(), b" uncon")
    prefixes.append(b"ditional")
    assert prefixes.ids() == ORACLE.encode_ordinary(" unconditional")


def test_queries_on_awkward_rows(spark):
    want = sorted((str(r[0]), len(ORACLE.encode_ordinary(r[1] or ""))) for r in awkward())
    counts = tokencount.token_counts(clashing(spark)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in counts) == want
    rows = bpe.encoded(clashing(spark)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == want and all(r["round_trip"] for r in rows)
    assert sorted(map(str, (r["token_ids"] for r in rows))) == sorted(str(ORACLE.encode_ordinary(r[1] or "")) for r in awkward())
    back = bpe.decoded(bpe.encoded(table(spark))).collect()
    assert sorted(str(r["text"]) for r in back) == sorted(str(r[1] or "") for r in awkward())
    assert tokencount.token_counts(empty(spark)).count() == 0 and bpe.encoded(empty(spark)).count() == 0


_BITS = ["a", "don", "'", "'s", "'re", "'ve", "'street", " ", "  ", "\n", " \n", "\t", "1", "23", "!", "''", "é", "漢", "🙂", "²", "x'd", "\x1c", "\u0301", "b" * 300]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_BITS), max_size=9), max_size=4))
def test_pre_tokens_of_many_texts_are_those_of_the_pattern(parts):
    texts = [None, *map("".join, parts)]
    at, count, bounds = pretokens.counted(texts)
    joined, end = "".join(texts[1:]), [*at.tolist(), bounds[-1]]
    assert [joined[a:b] for a, b in zip(end, end[1:], strict=False)] == [p for t in texts[1:] for p in SPLIT.findall(t)]
    total, own = np.append(0, np.cumsum(count)), np.searchsorted(at, bounds)
    assert np.diff(total[own]).tolist() == tokencount.count_tokens(texts)


def test_known_counts_may_be_begun_anew(monkeypatch):
    monkeypatch.setattr(pretokens, "REMEMBERED", 3)
    for text in ("one two three four five", "six seven eight", "one two nine"):
        assert pretokens.counted([text])[1].sum() == tokencount.count_tokens([text])[0]
