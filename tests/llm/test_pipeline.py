import collections
import importlib
import inspect

import numpy as np
import pyarrow as pa

import corpus_pipeline
from plumbline.llm import simhash, work

from .common import prose

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_the_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            docs = work.saved(docs, "test")
            assert docs.columns == columns
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[1] > 0.8 * seen[0]
    texts = collections.Counter(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert seen[2] <= len(texts)
    assert {"doc_id", "bin_id", "size"} <= set(docs.columns)


def test_near_copies_leave_one(spark, tmp_path):
    base = prose(1, 300).split()
    rows = [(1, " ".join(base), "en", "s", 9), (2, " ".join([*base[:100], "edit", *base[101:]]), "en", "s", 9), (3, prose(2, 300), "en", "s", 9), (4, prose(2, 300), "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.dedup_exact(spark, docs, SF)
    assert sorted(r["doc_id"] for r in once.collect()) == [1, 2, 3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_near(spark, once, SF).collect()) == [1, 3]


def test_near_copies_without_a_common_block_leave_one(spark):
    rows = []
    for seed in (2, 15, 120, 144, 181, 219, 338):  # 46 to 52 bits apart, but no 12 bits agree with one of their 8
        base = prose(seed, 120).split()
        edited = list(base)
        for at in np.random.default_rng(seed).choice(120, 20 + seed % 12, replace=False):
            edited[at] = prose(9000 + seed * 200 + int(at), 1)
        rows += [(2 * seed, " ".join(base), "en", "s", 9), (2 * seed + 1, " ".join(edited), "en", "s", 9)]
    fp, _ = simhash.fingerprints(pa.array([r[1] for r in rows]))
    assert (np.bitwise_count(fp[::2] ^ fp[1::2]).sum(1) <= simhash.DISTANCE).all()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.dedup_exact(spark, docs, SF)
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_near(spark, once, SF).collect()) == [r[0] for r in rows[::2]]


def test_the_shared_folder_is_the_session_s_setting(spark):
    assert work.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    for name in ("exact", "simhash", "substring", "lm", "packing", "quality", "pii", "rules", "components"):
        text = inspect.getsource(importlib.import_module(f"plumbline.llm.{name}"))
        assert "localCheckpoint" not in text and "except ImportError" not in text
