"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every prefix of a pre-token has exactly one valid encoding, and so one last token.  The table
``last`` stores it for each prefix: ``last[i]`` is the token t ending at byte i whose predecessor
``last[i - len(t)]`` may stand before it, that is, BPE would not merge across the two.
The encoding is read backwards from the end.  As prefixes never change, appended bytes only extend
the table (``Prefixes.append``), and ``EditableText`` encodes anew only the pre-tokens near an edit.

Decoding joins the bytes of the tokens.  Each document is decoded and compared with its text.

Defined results: null and empty texts have no tokens and decode to the empty text; any length is
encoded whole; repeated rows are encoded each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .vocab import HASH_BASE, SHORT, SPLIT, VOCABULARY, Vocabulary, insert, lookup, vocabulary
from .work import map_arrow

REMEMBERED, BATCH_CHARS, PAIRS = 500_000, 1 << 20, 1 << 21


class Codec:
    """Encoder with its memory of token pairs and pre-tokens, one for each worker and vocabulary."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.merged = {halves: t for t, halves in enumerate(vocab.halves) if halves[0] != t}
        self._pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self._table, self._verdict, self._filled = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, np.int64), 0
        self.lengths = np.array([len(t) for t in vocab.token], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(vocab.token), np.uint8)

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE keeps tokens ``a`` and ``b`` apart when their bytes stand side by side."""
        key = (a, b)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2 * REMEMBERED:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Undo the merges of both tokens, latest first; a merge across that comes earlier would have won."""
        halves, limit = self.vocab.halves, self.vocab.size
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                limit, a = a, halves[a][1]
                if a == limit:
                    limit, b = b + 1, halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, halves[b][0]
                if b + 1 == limit:
                    limit, a = a, halves[a][1]
                    if a == limit:
                        return True

    def extend(self, last: list[int], data: bytes) -> list[int]:
        """Fill ``last`` (token by prefix, from the empty one) up to the end of ``data``."""
        get, pairs, longest = self.vocab.rank.get, self._pairs.get, self.vocab.longest
        for end in range(len(last), len(data) + 1):
            for begin in range(end - longest if end > longest else 0, end):
                token = get(data[begin:end])
                if token is not None:
                    if begin:
                        pair = (last[begin], token)
                        apart = pairs(pair)
                        if apart is None:
                            apart = self.may_follow(*pair)
                        if not apart:
                            continue
                    last.append(token)
                    break
        return last

    def read(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.vocab.token[last[end]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> bytes:
        """The ids of a pre-token as little-endian int32."""
        ids = self.read(self.extend([-1], data))
        return struct.pack(f"<{len(ids)}i", *ids)

    def _apart_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``may_follow`` for arrays; pairs are remembered in a hash table."""
        key = a << 32 | b
        out = lookup(self._table, self._verdict, key, -1)
        new = np.unique(key[out < 0])
        if len(new):
            self._filled += len(new)
            if 2 * self._filled > len(self._table):
                self._table[:] = -1
                self._filled = len(new)
            verdict = np.array([self._apart(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], np.int64)
            if 2 * self._filled <= len(self._table):
                insert(self._table, self._verdict, new, verdict)
            missing = np.flatnonzero(out < 0)
            out[missing] = verdict[np.searchsorted(new, key[missing])]
        return out == 1

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The same for many pre-tokens: those of one length fill their prefix tables in step."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            groups.setdefault(len(piece), []).append(k)
        for n, members in groups.items():
            if n > SHORT:
                for k in members:
                    out[k] = self.encode_piece(pieces[k])
                continue
            rows = len(members)
            byte = np.frombuffer(b"".join(pieces[k] for k in members), np.uint8).reshape(rows, n).astype(np.uint64)
            base = np.uint64(HASH_BASE)
            prefix, power = np.zeros((n + 1, rows), np.uint64), np.ones(n + 1, np.uint64)
            for i in range(n):
                prefix[i + 1] = prefix[i] * base + byte[:, i] + np.uint64(1)
                power[i + 1 :] *= base
            last = np.full((n + 1, rows), -1, np.int64)
            for end in range(1, n + 1):
                todo = np.arange(rows)
                for begin in range(end):
                    key = prefix[end, todo] - prefix[begin, todo] * power[end - begin]
                    token = self.vocab.find_hashes(key.view(np.int64))
                    ok = np.flatnonzero(token >= 0)
                    if begin and len(ok):
                        ok = ok[self._apart_many(last[begin, todo[ok]], token[ok])]
                    if len(ok):
                        last[end, todo[ok]] = token[ok]
                        todo = todo[last[end, todo] < 0]
                        if not len(todo):
                            break
            back = np.full((rows, n), -1, np.int64)
            place, live = np.full(rows, n), np.arange(rows)
            for step in range(n - 1, -1, -1):
                token = last[place[live], live]
                back[live, step] = token
                place[live] -= self.lengths[token]
                live = live[place[live] > 0]
                if not len(live):
                    break
            taken = back >= 0
            ends = (np.cumsum(taken.sum(1)) * 4).tolist()
            flat = back[taken].astype("<i4").tobytes()
            for k, a, b in zip(members, [0, *ends], ends, strict=False):
                out[k] = flat[a:b]
        return out

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; the distinct new pre-tokens of about a million characters are encoded at once."""
        known, out, lo = self.known, [], 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars < BATCH_CHARS):
                chars += len(texts[hi] or "")
                hi += 1
            split = [SPLIT.findall(t) if t else [] for t in texts[lo:hi]]
            new = list({p for pieces in split for p in pieces if p not in known})
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list({p for pieces in split for p in pieces})
            known.update(zip(new, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
            out += [b"".join(map(known.__getitem__, pieces)) for pieces in split]
            lo = hi
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_texts([text])[0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, as an array."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        if not len(end):
            return np.zeros(0, np.uint8)
        at = np.repeat(self.starts[ids] - (end - size), size) + np.arange(end[-1])
        return self.bytes[at]


class Prefixes:
    """The prefix table of one pre-token; it can grow and be cut at its end."""

    def __init__(self, codec: Codec, data: bytes = b"") -> None:
        self.codec, self.data, self.last = codec, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.codec.extend(self.last, self.data)

    def cut(self, size: int) -> None:
        self.data, self.last = self.data[:size], self.last[: size + 1]

    def ids(self) -> list[int]:
        return self.codec.read(self.last)


class EditableText:
    """A text with its encoding; an edit splits and encodes anew only near it."""

    def __init__(self, codec: Codec, text: str = "") -> None:
        self.codec, self.text = codec, ""
        self.pieces: list[tuple[int, str, Prefixes]] = []
        self.encoded = 0
        self.replace(0, 0, text)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of text[start:end].

        A pre-token depends on its own characters and the two after it, so those that end two
        before the edit stay; after it, splitting stops where an old boundary is met again.
        """
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        left = 0
        while left < len(self.pieces) and self.pieces[left][0] + len(self.pieces[left][1]) + 2 <= start:
            left += 1
        old_right = {at + shift: k for k, (at, _, _) in enumerate(self.pieces) if at >= end}
        pos = self.pieces[left - 1][0] + len(self.pieces[left - 1][1]) if left else 0
        fresh, right = [], len(self.pieces)
        while pos < len(self.text):
            if pos >= start + len(new) and pos in old_right:
                right = old_right[pos]
                break
            m = SPLIT.match(self.text, pos)
            fresh.append((pos, m.group()))
            pos = m.end()
        reuse = self.pieces[left] if left < len(self.pieces) else None
        made = []
        for at, piece in fresh:
            data = piece.encode("utf-8", "surrogatepass")
            if reuse and at == reuse[0]:
                table, same = reuse[2], 0
                while same < min(len(data), len(table.data)) and data[same] == table.data[same]:
                    same += 1
                table.cut(same)
                table.append(data[same:])
                self.encoded += len(data) - same
            else:
                table = Prefixes(self.codec, data)
                self.encoded += len(data)
            made.append((at, piece, table))
        tail = [(at + shift, p, t) for at, p, t in self.pieces[right:]]
        self.pieces = self.pieces[:left] + made + tail

    def append(self, new: str) -> None:
        self.replace(len(self.text), len(self.text), new)

    def ids(self) -> list[int]:
        return [i for _, _, table in self.pieces for i in table.ids()]


_CODECS: dict[str, Codec] = {}


def codec(path: str = VOCABULARY) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(vocabulary(path))
    return _CODECS[path]


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, token_ids, n_tokens and round_trip (decoding gives the text back) of every row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(path)
        ids = coder.encode_texts(batch.column(1).to_pylist())
        size = np.array([len(x) // 4 for x in ids], np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(ids), "<i4")
        same = np.ones(len(ids), bool)
        for lo, hi, buf, offsets in K.slices(batch.column(1)):
            back = coder.decode(flat[ends[lo] : ends[hi]].astype(np.int64))
            if len(back) == len(buf) and np.array_equal(back, buf):
                continue
            for i in range(lo, hi):
                one = coder.decode(flat[ends[i] : ends[i + 1]].astype(np.int64))
                same[i] = np.array_equal(one, buf[offsets[i - lo] : offsets[i - lo + 1]])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        cols = [batch.column(0), lists, pa.array(size.astype(np.int32)), pa.array(same)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), fn, f"doc_id {kind}, token_ids array<int>, n_tokens int, round_trip boolean")


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text from doc_id and token_ids; bytes that are no UTF-8 become U+FFFD."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(path)
        texts = [coder.decode(np.array(x or [], np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return map_arrow(tokens.select("doc_id", "token_ids"), fn, f"doc_id {kind}, text string")
