"""Fuzzy expansion, spelling suggestions and the search that users call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from . import bm25

#: Least ratio, and most matches, of a term.
LEAST, MATCHES = 80, 3


def similar_terms(words: DataFrame, vocabulary: DataFrame, *, least: int = LEAST, matches: int = MATCHES, shortest: int = 3) -> DataFrame:
    """word, term, similarity, rank: for each word (few, broadcast) its most similar vocabulary terms of ``shortest`` or more characters.

    The word itself doesn't count; of equal terms the first by name comes first.  Lengths and
    plain edit distance exclude most pairs before the exact ratio is worked out.
    """
    terms = vocabulary.select("term").filter(F.length("term") >= shortest)
    pairs = terms.join(F.broadcast(words.select("word").distinct()), F.col("term") != F.col("word"))
    # one CASE keeps the test ahead of the ratio wherever the optimiser puts the filter
    exact = F.when(S.may_reach(F.col("word"), F.col("term"), least), S.ratio(F.col("word"), F.col("term")))
    scored = pairs.select("word", "term", exact.alias("similarity")).filter(F.col("similarity") >= least)
    order = Window.partitionBy("word").orderBy(F.desc("similarity"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= matches)


def query_words(spark: SparkSession, query: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(T.query_tokens(F.lit(query))).alias("position", "word"))


def expanded(spark: SparkSession, query: str, index: bm25.Index, **limits) -> DataFrame:
    """term, qtf: a query's tokens and up to three similar terms of each, every repeat counted."""
    words = query_words(spark, query)
    found = similar_terms(words, index.terms, **limits)
    added = words.join(F.broadcast(found), "word").select("term")
    return words.select(F.col("word").alias("term")).unionByName(added).groupBy("term").agg(F.count("*").alias("qtf"))


def fuzzy_search(spark: SparkSession, index: bm25.Index, query: str, *, k: int = 5, min_score: float = bm25.MIN_SCORE) -> DataFrame:
    return bm25.top(bm25.scores(index, expanded(spark, query, index)), k, min_score)


def suggestions(spark: SparkSession, query: str, index: bm25.Index, *, shortest: int = 3, n: int = 3) -> DataFrame:
    """position, word, term, similarity, rank for query words that the index doesn't know and that are long enough."""
    words = query_words(spark, query).filter(F.length("word") >= shortest)
    unknown = words.join(index.terms.select(F.col("term").alias("word")), "word", "left_anti")
    found = similar_terms(unknown, index.terms, matches=n, shortest=1)
    return unknown.join(F.broadcast(found), "word").select("position", "word", "term", "similarity", "rank")


def suggest_and_search(spark: SparkSession, index: bm25.Index, query: str, *, k: int = 5, min_score: float = bm25.MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """(suggestions, results of the query as it is, with fuzzy expansion)."""
    return suggestions(spark, query, index), fuzzy_search(spark, index, query, k=k, min_score=min_score)


def misspellings(found: DataFrame, index: bm25.Index) -> DataFrame:
    """The best suggestions (position, word, term) whose word is likely to be one of them mistyped.

    A word that the index lacks has no frequency; a suggestion's is the number of documents with it.
    """
    best = found.filter("rank = 1").select("position", "word", "term")
    counted = best.join(index.terms.select("term", F.col("df").alias("term_df")), "term", "left").join(index.terms.select(F.col("term").alias("word"), F.col("df").alias("word_df")), "word", "left")
    frequency, other = F.coalesce("word_df", F.lit(0)), F.coalesce("term_df", F.lit(0))
    likely = S.likely_misspelling(F.col("word_df").isNotNull(), frequency, other, S.typo_pattern(F.col("word"), F.col("term")))
    return counted.filter(likely).select("position", "word", "term")


@dataclass
class Answer:
    """A user's search: the query as given and as corrected, and the results of the one used."""

    original_query: str
    suggested_query: str | None
    used_suggestion: bool
    suggestion_text: str
    results: DataFrame


def search(spark: SparkSession, index: bm25.Index, query: str, *, k: int = 5, min_score: float = bm25.MIN_SCORE) -> Answer:
    """Clean the query, replace likely misspellings by their best suggestions, and search with fuzzy expansion.

    Only the suggestions of one query, at most one a word, come to the driver.
    """
    cleaned = spark.range(1).select(T.clean_query(F.lit(query)).alias("q")).first()["q"]
    found = misspellings(suggestions(spark, cleaned, index), index)
    best = {r["word"]: r["term"] for r in found.select("word", "term").distinct().collect()}
    words = [r["word"] for r in query_words(spark, cleaned).orderBy("position").collect()]
    better = " ".join(best.get(w, w) for w in words) if best else None
    return Answer(query, better, better is not None, better or "", fuzzy_search(spark, index, better or cleaned, k=k, min_score=min_score))


def document(docs: DataFrame, doc_id) -> DataFrame:
    """The document with an id, if there is one."""
    return docs.filter(F.col("doc_id") == F.lit(doc_id)).limit(1)


def with_ids(docs: DataFrame, position: str) -> DataFrame:
    """Documents with a string id (``doc_<position>`` where null) and content (empty where null)."""
    return docs.withColumn("id", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("doc_"), F.col(position).cast("string")))).withColumn("content", F.coalesce("content", F.lit("")))
