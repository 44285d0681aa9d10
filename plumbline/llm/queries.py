"""The corpus queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact, lm, packing, pii, quality, rules, simhash, substring, tokencount
from .work import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scores(docs, quality.fit(docs, labels), toxic=quality.fit_toxic(docs, labels))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ledger(documents(spark, sf_dir))


def op6_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablation(rules.ledger(documents(spark, sf_dir)), rules.POLICIES[rules.CURRENT])


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return lm.scores(docs, lm.build(docs, prune=1))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    every = (
        op1_token_counts, op2_simhash, op3_bpe, op4_quality, op5_exact_dedup, op6_quality_rules, op6_ablation,
        op7_lm_scores, op8_substring_dedup, op9_packing, op10_pii,
    )
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact.ORACLE, "op6_quality_rules": rules.ORACLE, "op6_ablation": rules.ABLATION_ORACLE}
