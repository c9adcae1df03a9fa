"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, exact confirmation.

Every distinct shingle set becomes one node, told apart by 128 bits of its digest; copies
of a set stay attached to it and are never paired with each other.  Nodes whose registers agree in a whole band share a
bucket.  Two rounds follow, both over all buckets:

1. every member is compared with the least node of its bucket;
2. buckets that still hold several components are cut into blocks of bounded size and
   all pairs of different components are estimated block against block.  A block gives
   the links that join components, at most one for each of its rows, never its pairs.

An estimate (maximum likelihood over the joint register order) only excludes pairs that
lie ``MARGIN`` standard deviations below the threshold; the rest are confirmed on the
full shingle sets, recomputed from the whole texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import setsketch, textkernel
from .components import connected_components
from .workspace import Workspace

MARGIN = 4.5
#: Rows of a block of a bucket, and of the strips in which a block's pairs are taken.
BLOCK, STRIP = 1024, 64
#: Pairs of one node that meet in a task; a node with more is copied to several.
SPLIT = 2000


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, data, starts in textkernel.text_slices(column):
        data = textkernel.LOWER[data]
        begin, end, rows = textkernel.word_bounds(data, starts)
        values, edges = textkernel.shingles(textkernel.word_hashes(data, begin, end), rows, len(starts) - 1, width)
        for r in range(len(starts) - 1):
            yield values[edges[r] : edges[r + 1]]


def _signatures(width: int, band_rows: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, starts in textkernel.text_slices(batch.column("text")):
                n_rows = len(starts) - 1
                data = textkernel.LOWER[data]
                begin, end, rows = textkernel.word_bounds(data, starts)
                values, edges = textkernel.shingles(textkernel.word_hashes(data, begin, end), rows, n_rows, width)
                sketch = setsketch.registers(values, edges)
                keys = setsketch.band_keys(sketch, band_rows)
                sizes = np.diff(edges)
                digests = [hashlib.blake2b(values[edges[r] : edges[r + 1]].tobytes(), digest_size=16).digest() if sizes[r] else None for r in range(n_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, n_rows),
                        batch.column("text_hash").slice(first, n_rows),
                        pa.array(sizes, pa.int64()),
                        *(pa.array([d and int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests], pa.int64()) for k in (0, 8)),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                        pa.array([keys[r] if sizes[r] else None for r in range(n_rows)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n", "node", "other", "sketch", "bands"],
                )

    return of


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _plausible(threshold: float):
    floor = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / setsketch.M)

    def keep(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        return setsketch.jaccard(a, b, n_a, n_b) >= floor

    return keep


def _estimated(threshold: float):
    plausible = _plausible(threshold)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = plausible(_matrix(batch.column("sketch_a")), _matrix(batch.column("sketch_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return of


def _confirmed(width: int, num: int, den: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column("text_a"), width), _sets(batch.column("text_b"), width)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return of


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole (key, i, j) blocks; the rows of a block come one after another."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {k: _matrix(batch.column(k)) if k == "sketch" else batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
        if rest is not None:
            part = {k: np.concatenate([rest[k], part[k]]) for k in part}
        last = (part["key"] == part["key"][-1]) & (part["i"] == part["i"][-1]) & (part["j"] == part["j"][-1])
        rest = {k: v[last] for k, v in part.items()}
        if not last.all():
            yield {k: v[~last] for k, v in part.items()}
    if rest is not None:
        yield rest


def _block_pairs(part: dict[str, np.ndarray], threshold: float, num: int, den: int, band_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of different components in one block that may reach the threshold.

    A pair counts in the first band that both rows share, so it comes up once however
    many buckets hold it.
    """
    plausible, n, component = _plausible(threshold), part["n"], part["component"]
    cuts = np.flatnonzero((np.diff(part["key"]) != 0) | (np.diff(part["i"]) != 0) | (np.diff(part["j"]) != 0)) + 1
    edges, left, right, waiting = np.concatenate([[0], cuts, [len(n)]]), [], [], 0
    strips = [(s, low, high) for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()) for s in range(low, high, STRIP)]
    for k, (start, low, high) in enumerate(strips):
        stop = min(start + STRIP, high)
        a, b = np.repeat(np.arange(start, stop), high - start), np.tile(np.arange(start, high), stop - start)
        some = (a < b) & (component[a] != component[b]) & (np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num)
        if part["i"][low] != part["j"][low]:
            some &= part["own"][a] != part["own"][b]
        left.append(a[some])
        right.append(b[some])
        waiting += len(left[-1])
        if waiting > 20_000 or k == len(strips) - 1:
            a, b = np.concatenate(left), np.concatenate(right)
            left, right, waiting = [], [], 0
            for s in range(0, len(a), 20_000):
                x, y = a[s : s + 20_000], b[s : s + 20_000]
                p, q = part["sketch"][x], part["sketch"][y]
                bands = p.shape[1] // band_rows
                first = (p == q)[:, : bands * band_rows].reshape(-1, bands, band_rows).all(axis=2).argmax(axis=1)
                own = first == part["band"][x]
                x, y = x[own], y[own]
                keep = plausible(p[own], q[own], n[x], n[y])
                yield x[keep], y[keep]


def _promising(threshold: float, num: int, den: int, band_rows: int):
    """The rows of blocks that belong to a plausible pair; texts are fetched for them alone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_blocks(batches):
            wanted = np.zeros(len(part["n"]), bool)
            for x, y in _block_pairs(part, threshold, num, den, band_rows):
                wanted[x] = wanted[y] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes() for v in part[k][wanted]], pa.binary()) if k == "sketch" else pa.array(part[k][wanted]) for k in part], names=list(part)
            )

    return of


def _linked(width: int, threshold: float, num: int, den: int, band_rows: int):
    """Confirmed links between components, each only if those before don't join its ends already."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        for part in _whole_blocks(batches):
            links: list[tuple[int, int]] = []
            for x, y in _block_pairs(part, threshold, num, den, band_rows):
                rows = np.unique(np.concatenate([x, y]))
                sets = dict(zip(rows.tolist(), _sets(pa.array(part["text"][rows], pa.string()), width)))
                for a, b in zip(x.tolist(), y.tolist()):
                    p, q = root(int(part["component"][a])), root(int(part["component"][b]))
                    if p != q:
                        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                            parent[p] = q
                            links.append((int(part["node"][a]), int(part["node"][b])))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return of


def near_duplicates(
    spark: SparkSession, docs: DataFrame, *, width: int = 5, num: int = 4, den: int = 5, band_rows: int = 4, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where ``den * |A & B| >= num * |A | B|`` over their sets of
    ``width``-word shingles (A-Z in lower case); a text with fewer words has its whole
    word sequence as its one shingle.  component_id is the least id reachable and kept
    marks that document.  Null or empty texts have no shingles and are linked with
    nothing.  A null id gets a null component unless it is a copy or near copy of a
    document with an id, and is never kept.  Rows that repeat an id keep one row each.
    Columns other than the two named are ignored.  An empty table gives an empty result.
    """
    work = Workspace(spark, "neardup")
    threshold = num / den
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    source = source.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = source.mapInArrow(_signatures(width, band_rows), "doc_id long, text_hash long, n long, node long, other long, sketch binary, bands array<long>")
    signed = work.save(signed, "signatures")
    n_docs = signed.count()

    # nodes go by half of their digest; where two share it, the others take a number made of both halves
    halves = signed.filter("n > 0").select("node", "other").distinct().groupBy("node").agg(F.count("*").alias("sets"), F.min("other").alias("least"))
    clashes = halves.filter("sets > 1").select("node", "least")
    if not clashes.isEmpty():
        renamed = signed.join(clashes, "node", "left").withColumn("node", F.when(F.col("other") != F.col("least"), F.xxhash64("node", "other")).otherwise(F.col("node")))
        signed = work.save(renamed.drop("least"), "renamed")

    one = F.min(F.struct("doc_id", "text_hash", "n", "sketch", "bands")).alias("one")
    nodes = work.save(signed.filter("n > 0").groupBy("node").agg(one).select("node", "one.*"), "nodes", n_docs, 4_000)
    banded = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1")
    members = work.save(banded.join(buckets, "key"), "members", n_docs, 4_000)

    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node")
    texts = source.join(wanted.hint("shuffle_hash"), (source["doc_id"].eqNullSafe(wanted["doc_id"])) & (source["text_hash"] == wanted["text_hash"])).select("node", "text")
    if not signed.filter("n > 0").groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])  # rows that repeat in full
    texts = work.save(texts, "texts", n_docs, 4_000)

    def paired(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        """pairs (a, b) with the columns of both nodes; nodes of many pairs are copied, so that no task gets them all."""
        busy = pairs.groupBy("b").count().filter(F.col("count") > SPLIT).select("b", F.ceil(F.col("count") / SPLIT).cast("int").alias("copies"))
        a, b = (table.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab")
        if busy.isEmpty():
            return pairs.join(a, "a").join(b, "b")
        salted = pairs.join(busy, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
        copied = b.join(busy, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
        return salted.join(copied, ["b", "salt"]).drop("salt").join(a, "a")

    sketches = nodes.select("node", "n", "sketch")
    first = work.save(members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs", n_docs, 20_000)
    first = paired(first, sketches, "n", "sketch").filter(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}")
    first = work.save(first.mapInArrow(_estimated(threshold), "a long, b long"), "likely", n_docs, 20_000)
    found = paired(first, texts, "text").select("a", "b", "text_a", "text_b")
    links = work.save(found.mapInArrow(_confirmed(width, num, den), "a long, b long"), "links-1", n_docs, 5_000)
    components = work.save(connected_components(work, links, "first"), "components-1", n_docs, 100_000)

    labelled = members.join(components, "node", "left").select("key", "band", "node", "n", "size", F.coalesce("component", "node").alias("component"))
    labelled = work.save(labelled, "labelled", n_docs)
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    ranged = (
        labelled.join(mixed, "key")
        .withColumn("own", F.when(blocks == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n")
        .join(sketches.select("node", "sketch"), "node")
    )

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    columns = "node long, key long, band int, i int, j int, own int, component long, n long, sketch binary"
    promising = work.save(dealt(ranged).mapInArrow(_promising(threshold, num, den, band_rows), columns), "promising", n_docs, 5_000)
    more = dealt(promising.join(texts, "node")).mapInArrow(_linked(width, threshold, num, den, band_rows), "a long, b long")
    more = work.save(more, "links-2", n_docs, 5_000)
    final = connected_components(work, links.unionByName(more), "second")

    groups = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    named = groups.join(final, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = work.save(named.join(least, "component").select("node", "component_id"), "named", n_docs, 50_000)
    out = signed.select("doc_id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    work.drop("texts", "members", "labelled", "nodes", "pairs", "likely", "promising", "links-1", "links-2", "components-1")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
