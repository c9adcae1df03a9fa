"""Queries of the training-data operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, licenses, neardup, oracles, packing, pii, quality, suffixtree, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(spark, toxicity.train(spark, docs, _table(spark, sf_dir, "labels")), docs)


def op2_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, _table(spark, sf_dir, "documents"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = chat.windows(chat.with_probe(spark, _table(spark, sf_dir, "conversations")))
    return chat.digests(chat.read_back(windows))


def op4_isolation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, _table(spark, sf_dir, "documents"), width=3, num=85, den=100, band_rows=5)


def op8_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.write(spark, _table(spark, sf_dir, "pages"))
    return warc.read(index, folder).drop("url", "payload")


def op9_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.train_and_score(spark, _table(spark, sf_dir, "documents"))


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(spark, _table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_toxicity_chain,
        op2_license_dice,
        op3_chat_windows,
        op4_isolation_quality,
        op5_spaced_seed_decontamination,
        op6_certified_packing,
        op7_minhash_neardup,
        op8_seekable_warc,
        op9_suffix_tree_scores,
        op10_weak_pii,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries whose whole result follows from their contract; the others hold a model's verdicts."""
    return dict(oracles.ORACLES)
