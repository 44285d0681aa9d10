"""The corpus queries do their whole job."""

import pytest
import pytest
from pyspark.sql import functions as F

from plumbline.llm import pii, quality, queries

from .common import SCHEMA, prose, table
from .test_lm_substring_packing import _brute


def test_held_out_toxic_documents_are_not_kept(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    known, rest = labels.where(~held), labels.where(held).dropDuplicates(["doc_id"])
    model, toxic = quality.fit(docs, known), quality.fit_toxic(docs, known)
    rows = quality.scores(docs, model, toxic=toxic).join(rest, "doc_id").select("keep", "score", "toxic_score", "quality", "toxic").collect()
    bad = [r for r in rows if r["toxic"]]
    good = [r for r in rows if r["quality"] and not r["toxic"]]
    caught, kept = sum(not r["keep"] for r in bad) / len(bad), sum(r["keep"] for r in good) / len(good)
    print(len(bad), caught, len(good), kept)
    assert len(bad) > 80 and caught >= 0.8 and kept >= 0.95
    assert sum(r["score"] >= 0.5 for r in bad) > 0.5 * len(bad)


def test_without_labels_of_toxicity_nothing_is_toxic(spark):
    labels = spark.createDataFrame([(1, 1, None), (9, 0, None)], "doc_id long, quality int, toxic int")
    assert quality.fit_toxic(table(spark), labels) is None and quality.fit_toxic(table(spark), labels.drop("toxic")) is None
    assert {r["toxic_score"] for r in quality.scores(table(spark), quality.fit(table(spark), labels)).collect()} == {None}


@pytest.mark.parametrize("number", ["+14155552671", "+442079460958", "tel +442079460958", "phone 4155552671", "+33 1 23 45 67 89", "tel 01 23 45 67 89", "+1 (974) 555-3436"])
def test_phone_numbers_without_separators_or_with_short_groups(number):
    text = f"so {number} it is"
    spans = pii.find_spans(text)
    assert [k for _, _, k, _ in spans] == ["PHONE"]
    assert not any(c.isdigit() for c in pii.redacted(text, spans))


def test_numbers_that_are_no_phone_numbers_stay():
    for text in ("order 4155552671 of", "on 2024-01-15 it", "1234567890123456789012345"):
        assert pii.find_spans(text) == []


def test_a_long_hex_secret_is_found_whole():
    for n in (64, 128, 129, 5000):
        assert [x[:3] for x in pii.find_spans("x " + "0a" * n + " y")] == [(2, 2 + 2 * n, "SECRET")]


def test_the_language_model_query_keeps_ngrams_seen_once(spark, tmp_path):
    rows = [(i, prose(i % 7, 60) + " " + prose(i, 30), "en", "s", 0) for i in range(20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_prob"] for r in queries.op7_lm_scores(spark, str(tmp_path)).collect()}
    whole, cut = _brute(rows, prune=1), _brute(rows, prune=2)
    for (doc_id, *_), (n, lp) in zip(rows, whole, strict=True):
        assert abs(got[doc_id] - lp) <= 0.05 * n
    assert any(abs(a[1] - b[1]) > 0.1 * a[0] for a, b in zip(whole, cut, strict=True))
