"""An inverted index as tables, and weighted BM25 over it.

Postings, document and term statistics are DataFrames; a query joins only the postings of
its own terms, so the rest of the index is never read (postings are written sorted by term).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .spread import spread

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Score from which a document is a result; scores of 0 count.
MIN_SCORE = -30.0


@dataclass
class Index:
    """postings (term, doc_id, tf), docs (doc_id, dl, weight), terms (term, df, cf, raw_idf, idf), corpus (one row).

    weights (doc_id, weight) and epsilon are what the other tables were made with, for ``write``.
    """

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame
    weights: DataFrame | None = None
    epsilon: float = EPSILON

    def write(self, path: str) -> None:
        """Postings first, sorted by term within files; the other tables are made from what is written."""
        spark = self.postings.sparkSession
        self.postings.repartition("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        written = _from_postings(spark.read.parquet(f"{path}/postings"), self.weights, self.epsilon) if self.weights is not None else self
        written.docs.write.mode("overwrite").parquet(f"{path}/docs")
        written.corpus.write.mode("overwrite").parquet(f"{path}/corpus")
        written.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "docs", "terms", "corpus")))


def tokenized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stopwords: Iterable[str] = T.STOPWORDS, weight: Column | None = None) -> DataFrame:
    """doc_id, tokens, weight (1 without one) of each document."""
    return spread(docs).select(F.col(id_column).alias("doc_id"), T.index_tokens(F.coalesce(F.col(text_column), F.lit("")), stopwords).alias("tokens"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))


def build_index(tokens: DataFrame, *, epsilon: float = EPSILON, strict: bool = False) -> Index:
    """Index documents (doc_id, tokens, weight); those without tokens are left out, or raise an error if ``strict``.

    Everything follows from the postings, so a query tokenizes the texts once.
    """
    if strict:
        tokens = tokens.filter(F.when(F.size("tokens") == 0, F.raise_error(F.lit("a document has no tokens")).cast("boolean")).otherwise(True))
    # the filter stands here, so that joins add none of their own and one shuffle serves all; explode would count tokens first
    postings = tokens.select("doc_id", F.explode_outer("tokens").alias("term")).filter("doc_id is not null and term is not null").groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return _from_postings(postings, tokens.select("doc_id", "weight"), epsilon)


def _from_postings(postings: DataFrame, weights: DataFrame, epsilon: float) -> Index:
    # counts look at tf and dl, so that every table needs the same columns and shares the postings' shuffle
    lengths = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    docs = lengths.join(weights.groupBy("doc_id").agg(F.max("weight").alias("weight")), "doc_id")
    corpus = lengths.agg(F.count_if(F.col("dl") > 0).alias("n_docs"), F.sum("dl").alias("total_tokens"), F.avg("dl").alias("avgdl"))
    counted = postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("cf"))
    raw = counted.crossJoin(F.broadcast(corpus.select("n_docs"))).select("term", "df", "cf", (F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw_idf"))
    mean = raw.agg(F.avg("raw_idf").alias("avg_idf"))
    corpus = corpus.crossJoin(mean).withColumn("eps", epsilon * F.col("avg_idf"))
    terms = raw.crossJoin(F.broadcast(corpus.select("eps"))).select("term", "df", "cf", "raw_idf", F.when(F.col("raw_idf") < 0, F.col("eps")).otherwise(F.col("raw_idf")).alias("idf"))
    return Index(postings, docs, terms, corpus, weights, epsilon)


def statistics(index: Index) -> DataFrame:
    """One row: n_docs, vocabulary, avg_tokens, avg_idf."""
    vocabulary = index.terms.agg(F.count("*").alias("vocabulary"))
    return index.corpus.crossJoin(vocabulary).select("n_docs", "vocabulary", F.col("avgdl").alias("avg_tokens"), "avg_idf")


def report(index: Index, documents: DataFrame, metadata: Column, path: str = "", similarity: int = 80) -> DataFrame:
    """``statistics`` with whether every document has metadata, the index's path and the least similarity of fuzzy matches."""
    known = documents.agg(F.coalesce(F.bool_and(metadata.isNotNull()), F.lit(True)).alias("has_metadata"))
    return statistics(index).crossJoin(known).select("*", F.lit(path).alias("index_path"), F.lit(similarity).alias("fuzzy_similarity_threshold"))


def scores(index: Index, query: DataFrame, *, k1: float = K1, b: float = B, doc_ids: DataFrame | None = None) -> DataFrame:
    """doc_id, score of every indexed document for query terms (term, qtf); documents without one score 0.

    ``doc_ids`` restricts to its documents; they are filtered before anything is scored.
    """
    docs = index.docs if doc_ids is None else index.docs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    terms = index.terms.join(F.broadcast(query), "term").select("term", "qtf", "idf")
    hits = index.postings.join(F.broadcast(terms), "term").join(docs, "doc_id").crossJoin(F.broadcast(index.corpus.select("avgdl")))
    part = F.col("qtf") * F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    summed = hits.groupBy("doc_id").agg(F.sum(part).alias("sum"))
    return docs.join(summed, "doc_id", "left").select("doc_id", (F.col("weight") * F.coalesce("sum", F.lit(0.0))).alias("score"))


def top(scored: DataFrame, k: int = 5, min_score: float = MIN_SCORE) -> DataFrame:
    """The k best documents above ``min_score`` with their rank; of equal scores the later document first.

    Scores are compared to nine places, so that the order in which a sum was formed does not
    part equal ones.
    """
    best = scored.withColumn("rounded", F.round("score", 9)).orderBy(F.desc("rounded"), F.desc("doc_id")).limit(k).filter(F.col("score") > min_score)
    return best.select("doc_id", "score", F.row_number().over(Window.orderBy(F.desc("rounded"), F.desc("doc_id"))).alias("rank"))


def query_terms(spark: SparkSession, query: str) -> DataFrame:
    """term, qtf of a query's tokens; repeated tokens count each time."""
    words = spark.range(1).select(F.explode(T.query_tokens(F.lit(query))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("qtf"))


def search(spark: SparkSession, index: Index, query: str, *, k: int = 5, min_score: float = MIN_SCORE, doc_ids: DataFrame | None = None) -> DataFrame:
    """Rank documents for a query; nothing for one without tokens."""
    terms = query_terms(spark, query)
    found = top(scores(index, terms, doc_ids=doc_ids), k, min_score)
    return found.join(F.broadcast(terms.agg(F.count("*").alias("n")).filter("n > 0")), how="cross").drop("n")
