"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger stores the measurements and, in
``failed``, one bit for each rule that the document fails.  A policy is a version and a mask of rules:
applying another version, or asking what a rule alone rejects, is arithmetic on the bits and never
reads a text again.

Defined results: a null text counts as empty (0 words, ratios 0); words are runs of characters
other than space, tab and line ends; any length is measured whole; repeated rows are ledgered each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STOP = "the be to of and that have with is in le la les des et que der die und das ist el los de del un en".split()
_SYMBOLS, _UPPER, _DIGITS = "#$%&*@^~_=+<>{}[]|!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

# name, condition of failing over the measurements; the place is the bit
RULES = [
    ("too_few_words", "n_words < 5"),
    ("too_many_words", "n_words > 100000"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 13 * n_words)"),
    ("symbols", "n_symbols * 10 > word_chars"),
    ("upper_case", "n_upper * 2 > word_chars AND word_chars > 20"),
    ("digits", "n_words >= 20 AND n_digits * 2 > word_chars"),
    ("few_distinct_words", "n_words >= 50 AND n_distinct_words * 5 < n_words"),
    ("repeated_lines", "n_lines >= 4 AND n_distinct_lines * 10 < n_lines * 3"),
    ("no_stop_words", "n_words >= 50 AND n_stop_words < 2"),
    ("long_lines", "n_words >= 50 AND n_chars > 20000 * n_lines"),
    ("no_sentence_end", "n_words >= 20 AND n_ends = 0"),
    ("placeholder_text", "has_placeholder"),
]
BIT = {name: k for k, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


#: Versioned policies: the rules that reject.
POLICIES = {
    1: mask("too_few_words", "too_many_words", "word_length", "symbols", "repeated_lines", "no_stop_words"),
    2: mask("word_length", "symbols", "upper_case", "digits", "few_distinct_words", "no_stop_words", "placeholder_text"),
}
CURRENT = 2
MEASURES = [
    "n_chars", "n_words", "word_chars", "n_distinct_words", "n_lines", "n_distinct_lines", "n_symbols", "n_upper",
    "n_digits", "n_stop_words", "n_ends", "has_placeholder",
]


def _without(column: str, chars: str) -> str:
    return f"length(translate({column}, '{chars}', ''))"


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, failed (bits), the measurements, keep_v1, keep_v2 and keep (the current policy)."""
    stop = ", ".join(f"'{w}'" for w in _STOP)
    base = docs.select("doc_id", F.expr("coalesce(text, '')").alias("t"))
    base = base.select("doc_id", "t", F.expr(r"regexp_extract_all(t, '[^ \\t\\n\\r]+', 0)").alias("w"), F.expr(r"split(t, '\\n')").alias("l"))
    out = base.select(
        "doc_id",
        F.expr("length(t)").alias("n_chars"),
        F.expr("size(w)").alias("n_words"),
        F.expr("length(array_join(w, ''))").alias("word_chars"),
        F.expr("size(array_distinct(w))").alias("n_distinct_words"),
        F.expr("size(l)").alias("n_lines"),
        F.expr("size(array_distinct(l))").alias("n_distinct_lines"),
        F.expr(f"length(t) - {_without('t', _SYMBOLS)}").alias("n_symbols"),
        F.expr(f"length(t) - {_without('t', _UPPER)}").alias("n_upper"),
        F.expr(f"length(t) - {_without('t', _DIGITS)}").alias("n_digits"),
        F.expr(f"size(array_intersect(array_distinct(w), array({stop})))").alias("n_stop_words"),
        F.expr(f"length(t) - {_without('t', '.?')}").alias("n_ends"),
        F.expr("contains(lower(t), 'lorem ipsum')").alias("has_placeholder"),
    )
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k}L ELSE 0L END" for k, (_, rule) in enumerate(RULES))
    out = out.withColumn("failed", F.expr(bits))
    for version, rules in POLICIES.items():
        out = out.withColumn(f"keep_v{version}", F.col("failed").bitwiseAND(F.lit(rules)) == 0)
    return out.withColumn("keep", F.col(f"keep_v{CURRENT}"))


def apply_policy(rows: DataFrame, rules: int) -> DataFrame:
    """The ledger rows that a policy keeps."""
    return rows.where(F.col("failed").bitwiseAND(F.lit(rules)) == 0)


def ablation(rows: DataFrame, rules: int) -> DataFrame:
    """For each rule: documents that fail it, that a policy rejects for it alone, and what is kept without it.

    One aggregate over the bits, so the shuffle is a row for each task.
    """
    hit = F.col("failed").bitwiseAND(F.lit(rules))
    cols = [F.count("*").alias("docs"), F.count_if(hit == 0).alias("kept")]
    for k, (name, _) in enumerate(RULES):
        bit = 1 << k
        cols += [
            F.count_if(F.col("failed").bitwiseAND(F.lit(bit)) != 0).alias(f"fail_{name}"),
            F.count_if(hit == bit).alias(f"alone_{name}"),
            F.bit_or(F.when(F.col("failed").bitwiseAND(F.lit(bit)) != 0, F.col("failed"))).alias(f"with_{name}"),
        ]
    one = rows.agg(*cols)
    entry = [
        F.struct(
            F.lit(name).alias("rule"), F.lit(bool(rules >> k & 1)).alias("in_policy"), F.col(f"fail_{name}").alias("failing"),
            F.col(f"alone_{name}").alias("rejected_alone"), (F.col("kept") + F.col(f"alone_{name}")).alias("kept_without"),
            F.coalesce(F.col(f"with_{name}"), F.lit(0).cast("long")).alias("seen_with"),
        )
        for k, (name, _) in enumerate(RULES)
    ]
    return one.select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def _ledger_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in _STOP)
    gone = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))
    keeps = ", ".join(f"(failed & {rules}) = 0 AS keep_v{v}" for v, rules in POLICIES.items())
    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, t, regexp_extract_all(t, '[^ \t\n\r]+') AS w, string_split(t, chr(10)) AS l FROM base),
m AS (SELECT doc_id, length(t) AS n_chars, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  len(list_distinct(w)) AS n_distinct_words, len(l) AS n_lines, len(list_distinct(l)) AS n_distinct_lines,
  {gone(_SYMBOLS)} AS n_symbols, {gone(_UPPER)} AS n_upper, {gone(_DIGITS)} AS n_digits,
  len(list_intersect(list_distinct(w), [{stop}])) AS n_stop_words, {gone('.?')} AS n_ends,
  contains(lower(t), 'lorem ipsum') AS has_placeholder FROM parts),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT *, {keeps}, (failed & {POLICIES[CURRENT]}) = 0 AS keep FROM b
"""


ORACLE = _ledger_sql()
_ABLATE = " UNION ALL ".join(
    f"SELECT '{name}' AS rule, {bool(POLICIES[CURRENT] >> k & 1)} AS in_policy, count(*) FILTER (failed & {1 << k} <> 0) AS failing,"
    f" count(*) FILTER (failed & {POLICIES[CURRENT]} = {1 << k}) AS rejected_alone,"
    f" count(*) FILTER (failed & {POLICIES[CURRENT]} = 0 OR failed & {POLICIES[CURRENT]} = {1 << k}) AS kept_without,"
    f" coalesce(bit_or(failed) FILTER (failed & {1 << k} <> 0), 0) AS seen_with FROM ledger"
    for k, (name, _) in enumerate(RULES)
)
ABLATION_ORACLE = f"WITH ledger AS ({ORACLE}) {_ABLATE}"
