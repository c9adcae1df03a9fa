"""Page graphs: extraction, deduplication, ranks, degrees and bounded traversal."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..functions import weights as G

DAMPING, ROUNDS, TOLERANCE = 0.85, 100, 1e-6
#: Rounds after which the plan of an iteration is cut.
CUT_EVERY = 5


def _checkpoint(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """Cut lineage in the folder that executors share; a temporary one only on one machine where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="inkstone-"))
    return frame.checkpoint()


def nodes(pages: DataFrame) -> DataFrame:
    """page_id, url, title, label, size_kb, content_length, headers_count, code_blocks, outbound_links, weight, initial_rank of pages (page_id, url, html).

    outbound_links counts the links to valid pages of the page's own site.
    """
    html, url = F.col("html"), F.col("url")
    parsed = pages.select(
        "page_id",
        "url",
        H.title(html, url).alias("title"),
        H.title(html, F.lit(None).cast("string")).alias("own_title"),
        U.basename(url).alias("label"),
        (F.octet_length("html") / 1024).alias("size_kb"),
        F.length(H.visible_text(html)).alias("content_length"),
        H.count_tags(html, "h1", "h2", "h3").alias("headers_count"),
        H.count_tags(html, "code", "pre").alias("code_blocks"),
        F.size(F.filter(H.anchors(html), lambda a: U.valid(U.resolved(a["href"], url), U.origin(url)))).alias("outbound_links"),
    )
    weight = G.content_weight(F.col("own_title"), url, F.col("content_length"), F.col("headers_count"), F.col("code_blocks"))
    return parsed.select("*", weight.alias("weight"), F.lit(1.0).alias("initial_rank")).drop("own_title")


def edges(pages: DataFrame, domain: Column | None = None, *, valid: bool = True) -> DataFrame:
    """page_id, seq, source, target, weight, link_text, link_class, link_position: the links of pages (page_id, url, html).

    Links lead to valid pages of the domain, without one of the page's own site; ``valid``
    False keeps all that resolve.  link_position is the element around the link.  A page's
    links that agree in everything count once; seq is the first one's place on the page.
    """
    tags = pages.select("page_id", "url", F.posexplode(F.array_distinct(H.tree_anchors("html"))).alias("seq", "a"))
    target = U.resolved(F.col("a.href"), F.col("url"))
    found = tags.select("page_id", "seq", F.col("url").alias("source"), target.alias("target"), F.col("a.text").alias("link_text"), F.col("a.class").alias("css"), F.col("a.parent").alias("link_position"))
    site = U.origin(F.col("source")) if domain is None else domain
    found = found.filter(U.valid(F.col("target"), site) if valid else F.col("target").isNotNull())
    weight = G.link_weight(F.col("source"), F.col("target"), F.col("link_text"), F.col("css"), F.col("link_position"))
    return found.select("page_id", "seq", "source", "target", weight.alias("weight"), "link_text", F.split("css", r"\s+").alias("link_class"), "link_position")


def deduplicated_edges(links: DataFrame) -> DataFrame:
    """The first link (by seq) of every unordered pair of source and target; partial minima form before the shuffle."""
    ends = [F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")]
    rest = F.struct(*[c for c in links.columns if c != "seq"]).alias("rest")
    first = links.groupBy(*ends).agg(F.min(F.struct("seq", rest)).alias("first"))
    return first.select(*(F.col("first.seq") if c == "seq" else F.col(f"first.rest.{c}").alias(c) for c in links.columns))


def deduplicated_nodes(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of every id."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("last", F.row_number().over(last)).filter("last = 1").drop("last")


def pagerank(spark: SparkSession, vertices: DataFrame, links: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """id, rank, rounds: weighted ranks of vertices (id) over links (source, target, weight).

    A vertex passes on its rank times the link's weight over its number of links, links to
    unknown targets included; nothing is redistributed, so ranks need not sum to one and may
    grow where weights do.  Stops when ranks move by less than ``tolerance`` in all, or
    after ``rounds``.  Links are cached as they come, not by source, so that the join of
    every round can split a hub's links.
    """
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"), F.lit(0).alias("rounds"))
    out = links.groupBy("source").agg(F.count("*").alias("n_out"))
    shares = links.join(out, "source").join(vertices.select(F.col("id").alias("target")), "target", "left_semi")
    shares = shares.select("source", "target", (F.col("weight") / F.col("n_out")).alias("share")).cache()
    ids = vertices.select("id").cache()
    ranks, done = ids.withColumn("rank", F.lit(1.0 / n)), 0
    for done in range(1, rounds + 1):
        given = shares.join(ranks.withColumnRenamed("id", "source"), "source").groupBy("target").agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        after = ids.join(given.withColumnRenamed("target", "id"), "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if tolerance is not None or done % CUT_EVERY == 0:
            after = _checkpoint(spark, after)
        if tolerance is not None:
            moved = after.join(ranks.withColumnRenamed("rank", "before"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0]
            if moved < tolerance:
                ranks = after
                break
        ranks = after
    ranks = _checkpoint(spark, ranks)
    shares.unpersist()
    ids.unpersist()
    return ranks.withColumn("rounds", F.lit(done))


def degrees(links: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k most linked (by target) or linking (by source) ids with their counts; of equals the first seen."""
    counted = links.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("degree"), F.min("seq").alias("seen"))
    return counted.orderBy(F.desc("degree"), "seen").limit(k).drop("seen")


def top_pages(vertices: DataFrame, links: DataFrame, by: str, k: int = 5) -> DataFrame:
    """``degrees`` with url and title of the page of that id (vertices: id, url, title), null for unknown ones; best first."""
    best = degrees(links, by, k).join(links.groupBy(F.col(by).alias("id")).agg(F.min("seq").alias("seen")), "id")
    detailed = best.join(vertices.select("id", "url", "title").dropDuplicates(["id"]), "id", "left")
    return detailed.orderBy(F.desc("degree"), "seen").select("id", "url", "title", "degree")


def summary(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """One row: total_nodes, total_links, average_links."""
    a, b = vertices.agg(F.count("*").alias("total_nodes")), links.agg(F.count("*").alias("total_links"))
    return a.crossJoin(b).withColumn("average_links", F.coalesce(F.try_divide("total_links", "total_nodes"), F.lit(0.0)))


def levels(spark: SparkSession, links: DataFrame, seed, *, max_pages: int | None = None, max_depth: int = 50, among: DataFrame | None = None) -> DataFrame:
    """id, depth: breadth-first traversal from a seed, at most ``max_pages`` ids (by depth, then id).

    among: the ids (id) that there are; others are neither reached nor counted.
    """
    links = links.select("source", "target").distinct()
    if among is not None:
        links = links.join(among.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target")
    links = links.cache()
    seen = spark.createDataFrame([(seed,)], links.select(F.col("source").alias("id")).schema).withColumn("depth", F.lit(0))
    frontier, room = seen, None if max_pages is None else max_pages - 1
    for depth in range(1, max_depth + 1):
        if room is not None and room <= 0:
            break
        found = links.join(frontier.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        frontier = found.join(seen.select("id"), "id", "left_anti")
        if room is not None:
            frontier = frontier.orderBy("id").limit(room)
        frontier = _checkpoint(spark, frontier.withColumn("depth", F.lit(depth)))
        number = frontier.count()
        if not number:
            break
        room = None if room is None else room - number
        seen = _checkpoint(spark, seen.unionByName(frontier))
    links.unpersist()
    return seen
