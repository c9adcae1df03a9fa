"""The whole path from pages to a searchable, clustered collection, as plain functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..functions import weights as G
from ..operators import bm25, cluster, graph, search
from ..operators.stored import stored


@dataclass
class Collection:
    nodes: DataFrame
    links: DataFrame
    ranks: DataFrame
    documents: DataFrame
    index: bm25.Index


def crawled(spark: SparkSession, pages: DataFrame, seed: str, max_pages: int = 40) -> DataFrame:
    """The pages of the seed's site that a bounded crawl from it reaches; one page is the seed alone.

    Only addresses of pages count against ``max_pages``.
    """
    links = graph.edges(pages, U.origin(F.lit(seed)))
    reached = graph.levels(spark, links, seed, max_pages=max_pages, among=pages.select(F.col("url").alias("id")))
    return pages.join(reached.select(F.col("id").alias("url")), "url", "left_semi")


def build(spark: SparkSession, pages: DataFrame, *, tolerance: float = graph.TOLERANCE) -> Collection:
    """Graph, ranks, text and index of pages (page_id, url, html)."""
    nodes = graph.nodes(pages)
    links = graph.deduplicated_edges(graph.edges(pages))
    ranks = graph.pagerank(spark, nodes.select(F.col("url").alias("id")).distinct(), links, tolerance=tolerance)
    ranked = nodes.join(ranks.select(F.col("id").alias("url"), F.col("rank").alias("final_rank")), "url", "left")
    score = G.rank_score(F.col("final_rank"), F.col("initial_rank"), F.col("weight"), F.col("content_length"), F.col("code_blocks"), F.col("outbound_links"))
    texts = pages.select("page_id", H.visible_text(F.col("html")).alias("content"))
    documents = ranked.join(texts, "page_id").select("page_id", "url", "title", "content", score.alias("rank_score"))
    index = bm25.build_index(bm25.tokenized(documents, "page_id", "content", weight=F.col("rank_score")))
    return Collection(nodes, links, ranks, documents, index)


def search_collection(spark: SparkSession, collection: Collection, query: str, k: int = 5) -> DataFrame:
    """Results of a user's search with their pages."""
    found = search.search(spark, collection.index, query, k=k).results
    return collection.documents.join(F.broadcast(found), collection.documents["page_id"] == found["doc_id"]).drop("doc_id").orderBy("rank")


def clustered(spark: SparkSession, docs: DataFrame, *, largest: int = 10) -> DataFrame:
    """The documents of docs (id, path, url, text) in named clusters with previews, from word vectors on; see ``cluster.structure``."""
    tokens = docs.select(F.col("id").alias("doc_id"), F.filter(T.embedding_tokens(F.coalesce("text", F.lit(""))), lambda t: ~t.isin(list(T.STOPWORDS))).alias("tokens"))
    tokens = cluster.stored_tokens(tokens)
    words = cluster.word_vectors(tokens)
    vectors = stored(cluster.document_vectors(tokens, words), "document-vectors")
    labels = cluster.kmeans(vectors, cluster.choose_k(vectors, largest)).select("id", F.col("label").alias("cluster"))
    labelled = docs.join(labels, "id")
    named = cluster.keywords(cluster.term_scores(labelled), words)
    return cluster.structure(cluster.previews(docs).join(labels, "id"), named, labelled)


def validated(url: str) -> str:
    """A crawlable address without closing slashes, or ValueError."""
    bare = url.strip().rstrip("/")
    if not bare.startswith(("http://", "https://")) or "." not in bare.split("://", 1)[1]:
        raise ValueError(f"no crawlable address: {url!r}")
    return bare


def tagged(spark: SparkSession, tag: str, work: Callable[[], DataFrame]) -> DataFrame:
    """Run work under a job tag, so that ``cancel`` can stop its jobs."""
    spark.addTag(tag)
    try:
        return work()
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.interruptTag(tag)


def origins(pages: DataFrame) -> DataFrame:
    """Number of pages by origin."""
    return pages.groupBy(U.origin(F.col("url")).alias("origin")).agg(F.count("*").alias("n_pages"))
