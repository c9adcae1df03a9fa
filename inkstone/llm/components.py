"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Pairs of a file between steps; small tables take few files.
PAIRS_PER_FILE = 100_000


def connected_components(work: Workspace, edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """(node long, component long) for all nodes of ``edges`` (a long, b long); component: the least node.

    Each step is a minimum per node, pre-aggregated before its shuffle, and a join that
    sends the minimum to the node's edges; no neighbourhood is ever gathered in one row
    or task.  An empty edge table gives an empty result; loops and repeats are ignored.
    """
    pairs = edges.filter("a <> b and a is not null and b is not null")
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    rows, state = edges.count(), None
    pairs = work.save(pairs, f"{tag}-0", rows, PAIRS_PER_FILE)
    for k in range(1, max_rounds + 1):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").filter("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        pairs = work.save(small.filter("u <> v").distinct(), f"{tag}-{k}", rows, PAIRS_PER_FILE)
        work.drop(f"{tag}-{k - 1}")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
