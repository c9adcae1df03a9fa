"""Sinks: page graphs, summaries of graphs, and cluster results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def write_graph(nodes: DataFrame, links: DataFrame, path: str) -> None:
    """Nodes and links as tables under one folder; each scales with its own rows."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    links.write.mode("overwrite").parquet(f"{path}/links")


def graph_document(nodes: DataFrame, links: DataFrame, domain: str) -> DataFrame:
    """One row: the graph as a JSON document for interchange; for graphs that fit one string."""
    n = nodes.agg(F.to_json(F.collect_list(F.struct(*nodes.columns))).alias("nodes"), F.count("*").alias("total_nodes"))
    e = links.agg(F.to_json(F.collect_list(F.struct(*links.columns))).alias("links"), F.count("*").alias("total_links"))
    meta = F.to_json(F.struct(F.lit(domain).alias("domain"), "total_nodes", "total_links"))
    return n.crossJoin(e).select(F.concat(F.lit('{"nodes":'), "nodes", F.lit(',"links":'), "links", F.lit(',"metadata":'), meta, F.lit("}")).alias("value"))


def graph_summary_document(vertices: DataFrame, links: DataFrame, domain: str, base: str, k: int = 5) -> DataFrame:
    """One row: statistics, the most linked and most linking pages with their details, and the site, as a JSON document."""
    def top(by: str, name: str) -> DataFrame:
        found = graph.top_pages(vertices, links, by, k)
        entry = F.struct(F.struct((-F.col("degree")).alias("order"), "id"), F.struct("id", "url", "title", F.col("degree").alias(f"{name}_links")).alias("page"))
        return found.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["page"]).alias(f"most_{name}"))

    whole = graph.summary(vertices, links).crossJoin(top("target", "incoming")).crossJoin(top("source", "outgoing"))
    numbers = F.struct(F.col("total_nodes").alias("total_pages"), "total_links", F.col("average_links").alias("average_outgoing_links"))
    pages = F.struct(F.col("most_incoming").alias("most_linked"), "most_outgoing")
    return whole.select(F.to_json(F.struct(numbers.alias("statistics"), pages.alias("top_pages"), F.struct(F.lit(domain).alias("domain"), F.lit(base).alias("base_path")).alias("domain_info"))).alias("value"))


def write_clusters(structure: DataFrame, labels: DataFrame, path: str) -> None:
    structure.write.mode("overwrite").json(f"{path}/structure")
    labels.write.mode("overwrite").parquet(f"{path}/labels")


def pages_to_store(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages whose address isn't stored yet, with file name, size in characters and time."""
    new = pages.join(stored.select("url"), "url", "left_anti")
    return new.withColumn("size", F.length("html")).withColumn("stored_at", F.current_timestamp())
