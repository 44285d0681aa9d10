"""Personal data and secrets: regular expressions propose, validators confirm, context decides.

Every proposal has a base score by kind.  Checksums (Luhn for cards, mod-97 for IBANs, the
reserved ranges of SSNs, octet ranges of IPv4) raise or sink it; the words within
``CONTEXT`` characters before and after add to it.  A span is taken from ``THRESHOLD`` on.
Overlapping spans go to the higher score, then the longer, then the earlier.

Defined results: a null text stays null and has no spans; an empty text has none; any length
is scanned whole; an empty table gives an empty result; extra columns pass through ``redact``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .work import map_arrow

THRESHOLD, CONTEXT = 0.5, 48
SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _card(m: re.Match[str]) -> float:
    digits = re.sub(r"\D", "", m.group())
    if not 13 <= len(digits) <= 19 or len(set(digits)) < 2:
        return -1.0
    return 0.8 if luhn(digits) else 0.3


def _iban(m: re.Match[str]) -> float:
    code = m.group().replace(" ", "").upper()
    return 0.9 if 15 <= len(code) <= 34 and mod97(code) else -1.0


def _ssn(m: re.Match[str]) -> float:
    area, group, serial = m.group().split("-")
    return -1.0 if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else 0.55


def _ipv4(m: re.Match[str]) -> float:
    return 0.6 if all(int(x) < 256 for x in m.group().split(".")) else -1.0


def _phone(m: re.Match[str]) -> float:
    raw = m.group()
    n = sum(c.isdigit() for c in raw)
    if not 8 <= n <= 15:
        return -1.0
    return 0.6 if raw[0] == "+" or "(" in raw else 0.4


def _secret(m: re.Match[str]) -> float:
    value = m.group("v")
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return 0.8 if mixed or len(set(value)) >= 12 else 0.3


def _always(score: float) -> Callable[[re.Match[str]], float]:
    return lambda m: score


_PHONES = ("phone", "tel", "call", "mobile", "fax", "cell")
#: Kind, what must be in the text ("digit": the pattern holds one near its ends, so stretches around digits are enough), pattern,
#: score of a match, words nearby that raise it.  What must be there is a part of the pattern, so no match is lost by looking for it first.
_KINDS = [
    ("EMAIL", "@", r"[\w.%+'-]+@[\w-]+(?:\.[\w-]+)+", _always(0.9), ()),
    ("IBAN", "digit", r"(?i)(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])", _iban, ("iban", "account", "bank")),
    ("CARD", "digit", r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])", _card, ("card", "visa", "mastercard", "amex", "credit", "carte", "karte", "tarjeta")),
    ("SSN", "digit", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn, ("ssn", "social", "security")),
    ("IPV4", "digit", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ipv4, ("ip", "address", "host", "server")),
    ("PHONE", "digit", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){1,4}(?![\w]|[.-]\d)", _phone, _PHONES),
    ("PHONE", "+", r"(?<![\w.+])\+\d(?:[ .-]?\(?\d\)?){7,14}(?![\w]|[.-]\d)", _phone, ()),
    ("PHONE", "digit", r"(?<![\w.+-])\d(?:[ .-]?\d){7,14}(?![\w]|[.-]\d)", _always(0.35), _PHONES),
    ("SECRET", "=:", r"""(?i)\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passw(?:or)?d|pwd|key)["']?\s*[:=]\s*["']?(?P<v>[\w+/.~-]{8,})=*["']?""", _secret, ("bearer", "authorization", "credential")),
    ("SECRET", "AKIA", r"\bAKIA[0-9A-Z]{16}\b", _always(0.95), ()),
    ("SECRET", "-----BEGIN", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", _always(0.95), ()),
    ("SECRET", "eyJ", r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*", _always(0.9), ()),
    ("SECRET", "hex", r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}(?![0-9A-Za-z])", _always(0.6), ()),
]
_RULES = [(kind, need, re.compile(p), score, re.compile(r"(?i)\b(?:%s)" % "|".join(near)) if near else None) for kind, need, p, score, near in _KINDS]
_DIGIT, _HEX = re.compile(r"\d"), re.compile(r"[0-9a-fA-F]{32,}")
#: The two sides of an address, looked for from its sign.
_LOCAL, _AFTER = re.compile(r"[\w.%+'-]"), re.compile(r"[\w-]+(?:\.[\w-]+)+")
#: No span of a kind that needs digits has more than FAR characters before its first or behind its last digit, nor GAP between two.
FAR, GAP = 160, 200


def _near_digits(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, far enough to hold any span with one."""
    out: list[tuple[int, int]] = []
    pos = 0
    while m := _DIGIT.search(text, pos):
        lo, hi = max(0, m.start() - FAR), m.start()
        while nxt := _DIGIT.search(text, hi, hi + GAP):
            hi = nxt.end()
        hi = min(len(text), hi + FAR)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
        pos = hi
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    """What the pattern of e-mail addresses matches, of any length, in linear time: each sign is looked at once."""
    out: list[tuple[int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > end and _LOCAL.match(text, begin - 1):
            begin -= 1
        if begin < at and (m := _AFTER.match(text, at + 1)):
            end = m.end()
            out.append((begin, end))
        at = text.find("@", at + 1)
    return out


def _proposed(text: str, need: str, pattern: re.Pattern[str], stretches: list[tuple[int, int]]) -> Iterator[re.Match[str]]:
    if need == "@":
        for a, b in _addresses(text) if "@" in text else ():
            yield pattern.match(text, a, b)
    elif need == "digit":
        for lo, hi in stretches:
            yield from pattern.finditer(text, lo, hi)
    elif need == "hex":
        for m in _HEX.finditer(text):
            # the run is whole, so only its surroundings are left to see
            if found := pattern.match(text, m.start()):
                yield found
    elif ("=" in text or ":" in text) if need == "=:" else need in text:
        yield from pattern.finditer(text)


def find_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of every span taken, by place; offsets are in characters."""
    found: list[tuple[float, int, int, str]] = []
    stretches = _near_digits(text)
    for kind, need, pattern, score, near in _RULES:
        for m in _proposed(text, need, pattern, stretches):
            s = score(m)
            if s >= 0 and near is not None and (
                near.search(text, max(0, m.start() - CONTEXT), m.start()) or near.search(text, m.end(), m.end() + CONTEXT)
            ):
                s += 0.25
            if s >= THRESHOLD:
                found.append((min(s, 1.0), m.start(), m.end(), kind))
    taken: list[tuple[int, int, str, float]] = []
    for s, a, b, kind in sorted(set(found), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        i = bisect.bisect_left(taken, (a,))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b, kind, s))
    return taken


def redacted(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def _scan(column: pa.Array) -> tuple[list[str | None], list[list[dict]]]:
    texts, all_spans = [], []
    for text in column.to_pylist():
        spans = find_spans(text) if text else []
        texts.append(redacted(text, spans) if spans else text)
        all_spans.append([{"start": a, "end": b, "kind": k, "score": round(s, 3)} for a, b, k, s in spans])
    return texts, all_spans


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, text (redacted), n_spans and spans of every row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = _scan(batch.column(1))
        counts = np.fromiter((len(s) for s in spans), np.int32, len(spans))
        cols = [batch.column(0), pa.array(texts, pa.string()), pa.array(counts), pa.array(spans, _SPAN_TYPE)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_spans", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), fn, f"doc_id {kind}, text string, n_spans int, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets, and n_chars, if there, brought up to date."""
    text = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(batch.columns)
        texts, spans = _scan(cols[text])
        cols[text] = pa.array(texts, cols[text].type)
        if chars is not None:
            old = cols[chars].to_pylist()
            new = [len(t) if s else n for t, s, n in zip(texts, spans, old, strict=True)]
            cols[chars] = pa.array(new, cols[chars].type)
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return map_arrow(inner, fn, schema).toDF(*docs.columns)
