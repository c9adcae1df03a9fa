"""A training corpus from documents, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its
result is written as Parquet in the shared folder and read again.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import decontaminate, neardup, packing, pii, quality
from inkstone.llm.workspace import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the isolation forest.

    Every row is judged by its own text, whatever its id: null and empty texts go, rows with
    a null or repeated id stay if their text is good, ties of scores are decided alike.
    """
    return quality.good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, a null one last.

    Rows are numbered, so exactly one stays however ids repeat or are null.  Texts without
    words are linked with nothing and stay.
    """
    work = Workspace(spark, "near-duplicates")
    key = "row"
    while key in docs.columns:
        key = f"_{key}"
    numbered = work.save(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    groups = neardup.near_duplicates(spark, numbered, id_column=key).select(F.col("doc_id").alias(key), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(key).alias("row"))).alias("first")
    stay = numbered.select(key, "doc_id").join(groups, key).groupBy("component_id").agg(first).select(F.col("first.row").alias(key))
    return numbered.join(stay, key, "left_semi").drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; every row is judged by its own text, null and empty ones stay."""
    return decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars to match; null texts stay null."""
    redacted = pii.redact(spark, docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in a training sequence; a null text is one closing id, repeated rows are packed once each."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", best_fit_packing),
]

#: SQL cannot express the stages; each operator is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; an empty table gives an empty result."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
