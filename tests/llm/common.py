"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def awkward():
    a, b = prose(1), prose(2)
    near = a.split()
    near[5], near[50] = "changed", "words"
    rows = [
        (1, a, "en", "s"), (2, a, "en", "s"), (2, a, "en", "s"), (3, " ".join(near), "en", None), (4, b, None, "t"), (None, b, "en", "s"),
        (None, None, None, None), (5, None, "en", "s"), (6, "", "en", "s"), (7, "", "de", "s"), (8, " \n\t ", "en", "s"), (9, "one", "en", "s"),
        (10, LONG, "en", "s"), (11, LONG, "en", "s"), (12, prose(3), "fr", "s"), (13, "é ü ñ 漢字 🙂 " + prose(4), "en", "s"),
        (14, "é ü ñ 漢字 🙂 " + prose(4), "en", "s"), (15, "café", "fr", "s"), (16, "café", "fr", "s"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that the operators use inside.
CLASH = ["node", "block", "group", "keep", "c0", "fp_a", "score", "rid", "key", "label", "own", "h", "n", "size", "piece", "span", "doc", "f0", "a", "b", "drop_hash", "kept_id"]


def clashing(spark, rows=None):
    from pyspark.sql import functions as F

    return table(spark, rows).select(*[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH)], "*")
