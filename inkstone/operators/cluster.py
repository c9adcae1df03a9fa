"""Document clusters: vectors, k-means with a chosen k, keywords, names and a browsable structure."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..functions import urls as U
from . import skipgram, summarize
from .spread import spread
from .stored import small_batches, stored

SEED, DIMENSIONS, WINDOW, LEAST_COUNT = 42, 100, 5, 2
#: Terms of a cluster that are scored and compared, keywords that may be alike at most.
SCORED, COMPARED, ALIKE = 50, 100, 0.7
#: Rows that Euclidean silhouettes are worked out for, each against all rows.
SILHOUETTE_ROWS = 2000
#: Words of text that one task trains word vectors with, at every size of the input.
SHARE = 8_000_000
#: Numbers of word vectors that are sent to the executors, those of the most frequent words; other words are joined.
HEAD = 32_000_000
#: Query vectors that are sent to the executors at a time.
QUERY_BLOCK = 10_000
#: Sentences and characters of a preview by type of file; others have the last.
PREVIEWS = {".pdf": (3, 300), ".docx": (3, 300), ".txt": (2, 200), ".html": (2, 200), ".htm": (2, 200), "": (2, 150)}


def metadata(docs: DataFrame, path: Column, text: Column) -> DataFrame:
    """One row: n_docs, by_extension (map), avg_length, n_empty."""
    rows = docs.select(F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1).alias("extension"), F.length(F.coalesce(text, F.lit(""))).alias("length"))
    counted = rows.groupBy("extension").agg(F.count("*").alias("n"), F.sum("length").alias("chars"), F.count_if(F.col("length") == 0).alias("empty"))
    return counted.agg(
        F.sum("n").alias("n_docs"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("extension", "n")))).alias("by_extension"), (F.sum("chars") / F.sum("n")).alias("avg_length"), F.sum("empty").alias("n_empty")
    )


def distribution(labelled: DataFrame, label: str = "label") -> DataFrame:
    return labelled.groupBy(label).agg(F.count("*").alias("n_docs"))


def centroids(vectors: DataFrame) -> DataFrame:
    """label, n, centroid of vectors (label, vector array)."""
    parts = vectors.select("label", F.posexplode("vector").alias("d", "x"))
    means = parts.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))
    return means.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "mean"))), lambda p: p["mean"]).alias("centroid"))


def nearest(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """id, cluster, distance (squared) to the nearest center (label, centroid); of equals the least label.

    Centers are few (one per cluster) and go to every task.
    """
    # the k centers, as one array in each row, instead of k rows per vector
    all_ = centers.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("centers"))
    ranked = vectors.crossJoin(F.broadcast(all_)).select(
        "id", F.array_min(F.transform("centers", lambda c: F.struct(S.squared_distance(F.col("vector"), c["centroid"]).alias("distance"), c["label"].alias("cluster")))).alias("best")
    )
    return ranked.select("id", F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance"))


def total_variance(vectors: DataFrame) -> DataFrame:
    """One row: the sum over dimensions of the population variance."""
    parts = vectors.select(F.posexplode("vector").alias("d", "x"))
    return parts.groupBy("d").agg(F.var_pop(F.col("x").cast("double")).alias("v")).agg(F.sum("v").alias("total_variance"))


def silhouette_squared(vectors: DataFrame) -> DataFrame:
    """One row: mean silhouette with squared distances, linear in the rows.

    The mean squared distance from x to a cluster of n vectors with sum s and squared norms q
    is |x|^2 - 2 x.s / n + q / n.
    """
    sized = vectors.select("id", "label", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    sized = sized.withColumn("norm", S.dot(F.col("vector"), F.col("vector")))
    means = centroids(sized).join(sized.groupBy("label").agg(F.avg("norm").alias("mean_norm")), "label")
    all_ = means.agg(F.array_sort(F.collect_list(F.struct("label", "n", "centroid", "mean_norm"))).alias("clusters"))
    distance = lambda c: F.greatest(F.lit(0.0), F.col("norm") - 2 * S.dot(F.col("vector"), c["centroid"]) + c["mean_norm"])
    rows = sized.crossJoin(F.broadcast(all_)).select(
        F.get(F.transform(F.filter("clusters", lambda c: c["label"] == F.col("label")), lambda c: F.struct(c["n"].alias("n"), distance(c).alias("d"))), F.lit(0)).alias("own"),
        F.array_min(F.transform(F.filter("clusters", lambda c: c["label"] != F.col("label")), distance)).alias("other"),
    )
    inside = F.col("own.d") * F.col("own.n") / (F.col("own.n") - 1)
    value = F.when(F.col("own.n") <= 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("other") - inside, F.greatest("other", inside)), F.lit(0.0)))
    return rows.agg(F.avg(value).alias("silhouette"))


def _silhouettes(vectors: DataFrame, rows: int) -> list[float | None]:
    """Mean Euclidean silhouette of each clustering in vectors (id, vector, labels: array<int>), in one pass.

    At most ``rows`` vectors, those with the least hashes of their ids, are compared with all.
    """
    asked = vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("vector", "labels").collect()
    if not asked:
        return []
    points, own = np.array([r["vector"] for r in asked], float), np.array([r["labels"] for r in asked], np.int64)
    sent = vectors.sparkSession.sparkContext.broadcast(points)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, sums, sizes = sent.value, {}, {}
        norms = (points * points).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows_ = np.array(batch.column("vector").to_pylist(), float)
            distance = np.sqrt(np.maximum(norms[:, None] + (rows_ * rows_).sum(axis=1) - 2 * points @ rows_.T, 0))
            for k, labels in enumerate(np.array(batch.column("labels").to_pylist(), np.int64).T):
                for label in np.unique(labels).tolist():
                    some = labels == label
                    sums[k, label] = sums.get((k, label), 0) + distance[:, some].sum(axis=1)
                    sizes[k, label] = sizes.get((k, label), 0) + int(some.sum())
        for (k, label), of in sums.items():
            n = len(of)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array(np.full(n, label)), pa.array(np.arange(n)), pa.array(of), pa.array(np.full(n, sizes[k, label]))], names=["k", "label", "a", "d", "n"])

    each = vectors.select(F.transform("vector", lambda x: x.cast("double")).alias("vector"), "labels").mapInArrow(summed, "k long, label long, a long, d double, n long")
    table = each.groupBy("k", "label", "a").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).toArrow().to_pandas()
    out: list[float | None] = []
    for k in range(own.shape[1]):
        part = table[table["k"] == k]
        d, n = (part.pivot(index="a", columns="label", values=c) for c in ("d", "n"))
        inside = d.columns.to_numpy()[None, :] == own[d.index.to_numpy(), k][:, None]
        d, n = d.to_numpy(), n.to_numpy()
        mine, count = d[inside], n[inside]
        other = np.where(inside, np.inf, d / n).min(axis=1)
        mean = mine / np.maximum(count - 1, 1)
        high = np.maximum(mean, other)
        value = np.where((count > 1) & np.isfinite(other) & (high > 0), (other - mean) / np.where(high > 0, high, 1), 0.0)
        out.append(float(value.mean()) if inside.shape[1] > 1 else None)
    return out


def silhouette_euclidean(vectors: DataFrame, rows: int = SILHOUETTE_ROWS) -> DataFrame:
    """One row: mean silhouette with Euclidean distances of at most ``rows`` vectors (id, label, vector), each against all.

    Those with the least hashes of their ids are taken, so up to ``rows`` vectors the result
    is exact; the work grows with the table, not with its square.  Null for a single cluster.
    """
    found = _silhouettes(vectors.select("id", "vector", F.array(F.col("label").cast("int")).alias("labels")), rows)
    return vectors.sparkSession.createDataFrame([(found[0] if found else None,)], "silhouette double")


def most_similar(vectors: DataFrame, query: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, cosine, rank: the k most similar vectors of each query vector, itself left out.

    Query vectors are sent to the executors in blocks of about ``QUERY_BLOCK``.
    """
    asked = query.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    found = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        scored = vectors.join(F.broadcast(own), F.col("id") != F.col("query_id")).select("query_id", "id", S.cosine(F.col("vector"), F.col("query_vector")).alias("cosine"))
        best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = best if found is None else found.unionByName(best)
    return found


def stored_tokens(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, tokens) written once, for the passes that word and document vectors make."""
    return stored(tokens, "tokens")


def _lists(values: np.ndarray) -> pa.Array:
    """A list of floats for each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.astype(np.float32).ravel()))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a column of lists, and the length of each list; null is empty."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists of hashes: the different ones, each entry's place among them, the bounds of the lists."""
    coded, lengths = column.flatten().dictionary_encode(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _places(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in the sorted hashes, -1 for those that are not there."""
    if not len(known):
        return np.full(len(hashes), -1, np.int64)
    found = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[found] == hashes, found, -1)


def _hashed(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n of tokens; some batches together."""

    def rows(lists: list[pa.Array]) -> pa.RecordBatch:
        counts = pa.chunked_array(lists, lists[0].type).value_counts()
        return pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts").cast(pa.int64())], names=["word", "n"])

    waiting: list[pa.Array] = []
    for batch in batches:
        waiting.append(batch.column(0).flatten())
        if sum(map(len, waiting)) >= 4_000_000:
            yield rows(waiting)
            waiting = []
    if waiting:
        yield rows(waiting)


def _numbers(column: pa.Array) -> np.ndarray:
    """A row of numbers for each vector in lists or, in half precision, in bytes."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float16) if pa.types.is_binary(column.type) else _flat(column)[0]
    return flat.reshape(len(column), -1)


def _bytes(vectors: np.ndarray) -> pa.Array:
    """The rows of vectors as bytes."""
    width = vectors.shape[1] * vectors.itemsize
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(np.arange(len(vectors) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(vectors))])


def _sums(frame: DataFrame, key: str) -> DataFrame:
    """key (long), vector, n: sums of vector * n and of n by key."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def together(parts: list[tuple]) -> tuple:
            keys, vectors, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[starts], np.add.reduceat(vectors[order], starts, axis=0), np.add.reduceat(n[order], starts)

        parts: list[tuple] = []
        kept = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy(zero_copy_only=False)
            vectors = _numbers(batch.column(1)).astype(np.float32) * n[:, None].astype(np.float32)
            parts.append((batch.column(0).to_numpy(zero_copy_only=False), vectors, n))
            size += batch.num_rows
            if size >= 2 * kept + 50_000:
                parts = [together(parts)]
                kept = size = len(parts[0][0])
        if parts:
            keys, vectors, n = together(parts)
            for k in range(0, len(keys), 8192):
                some = slice(k, k + 8192)
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), _lists(vectors[some]), pa.array(n[some])], names=[key, "vector", "n"])

    return frame.select(key, "vector", "n").repartition(key).mapInArrow(summed, f"{key} long, vector array<float>, n long")


def word_vectors(tokens: DataFrame, *, seed: int = SEED, dimensions: int = DIMENSIONS, share: int = SHARE) -> DataFrame:
    """word, vector, n of the words that occur twice or more, by skip-grams; tokens: doc_id, tokens without stop words.

    Documents are dealt by their hashes to shares of about ``share`` words; each is trained from
    the same start, and a word's vector is the start and the mean of what it moved there, weighted
    by its occurrences; both are kept in half precision.  The driver has a hash and a count of each
    word.  Words are told apart by 64 bits.
    """
    spark = tokens.sparkSession
    small_batches(tokens)
    counts = tokens.select("tokens").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counts.filter(F.col("n") >= LEAST_COUNT).withColumn("hash", F.xxhash64("word")), "words")
    table = counted.select("hash", "n").toArrow()
    hashes, n = (table.column(c).to_numpy() for c in ("hash", "n"))
    order = np.argsort(hashes, kind="stable")
    hashes, n = hashes[order], n[order]
    sent = spark.sparkContext.broadcast((hashes, n))
    shares = max(1, -(-int(n.sum()) // share))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value[0]
        for batch in batches:
            distinct, codes, bounds = _distinct(batch.column("hashes"))
            places = _places(distinct, known)[codes]
            there = places >= 0
            ends = np.concatenate([[0], np.cumsum(there)])[bounds]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places[there].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "places"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = skipgram.Trainer(*sent.value, dimensions, WINDOW, seed, TaskContext.get().partitionId())
        for batch in batches:
            own.feed(*_flat(batch.column("places")))
        for words, vectors, times in own.vectors():
            moved = vectors - skipgram.start(words, dimensions, seed)
            yield pa.RecordBatch.from_arrays([pa.array(words), _bytes(moved.astype(np.float16)), pa.array(times)], names=["hash", "vector", "n"])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = batch.column("hash").to_numpy(zero_copy_only=False)
                mean = _numbers(batch.column("vector")) / batch.column("n").to_numpy(zero_copy_only=False)[:, None] + skipgram.start(words, dimensions, seed)
                yield pa.RecordBatch.from_arrays([batch.column("hash"), _lists(mean.astype(np.float16))], names=["hash", "vector"])

    if not len(hashes):
        return spark.createDataFrame([], "word string, vector array<float>, n long")
    texts = _hashed(tokens).select(F.xxhash64("doc_id", "hashes").alias("key"), "hashes").mapInArrow(encoded, "key long, places array<int>")
    dealt = texts.filter(F.size("places") > 0).repartition(shares, "key").sortWithinPartitions("key")
    means = _sums(dealt.mapInArrow(trained, "hash long, vector binary, n long"), "hash").mapInArrow(ended, "hash long, vector array<float>")
    return stored(counted.join(means, "hash").select("word", "vector", "n"), "vectors")


def document_vectors(tokens: DataFrame, words: DataFrame, head: int = HEAD) -> DataFrame:
    """id, vector: mean of the vectors of a document's known words (word, vector array, n if known); zeros without one.

    At most ``head`` numbers, the vectors of the most frequent words, are sent to the executors; less
    frequent words of documents are joined.
    """
    spark = tokens.sparkSession
    small_batches(tokens)
    first = words.select(F.size("vector").alias("n")).first()
    dimensions = first["n"] if first else DIMENSIONS
    known = words.select(F.xxhash64("word").alias("hash"), F.col("vector").cast("array<float>").alias("vector"), (F.col("n") if "n" in words.columns else F.lit(1)).cast("long").alias("n"))
    held, least = 0, None
    for row in known.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        held += row["words"] * dimensions
        if held > head:
            break
        least = row["n"]
    often = F.col("n") >= least if least is not None else F.lit(False)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _numbers(batch.column("vector"))
                half = vectors.astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("hash"), _bytes(half if (half == vectors).all() else vectors)], names=["hash", "vector"])

    table = known.filter(often).select("hash", "vector").mapInArrow(packed, "hash long, vector binary").toArrow()
    hashes, vectors = table.column("hash").to_numpy(), [np.empty((0, dimensions), np.float16)]
    for chunk in table.column("vector").chunks:
        of = b"".join(chunk.to_pylist())
        vectors.append(np.frombuffer(of, np.float16 if len(of) == 2 * dimensions * len(chunk) else np.float32).reshape(-1, dimensions))
    del table
    order = np.argsort(hashes, kind="stable")
    sent = spark.sparkContext.broadcast((hashes[order], order.astype(np.int32), np.concatenate(vectors)))
    del vectors

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, vectors = sent.value
        for batch in batches:
            distinct, codes, bounds = _distinct(batch.column("hashes"))
            places = _places(distinct, own)
            known_ = places >= 0
            # in rows of this batch's words; the last is for those that are joined
            some = np.concatenate([vectors[rows[places[known_]]].astype(np.float32), np.zeros((1, vectors.shape[1]), np.float32)])
            at = np.where(known_, np.cumsum(known_) - 1, len(some) - 1)[codes]
            there = at < len(some) - 1
            totals = np.zeros((batch.num_rows, vectors.shape[1]))
            for k in np.flatnonzero(bounds[1:] > bounds[:-1]):
                totals[k] = some[at[bounds[k] : bounds[k + 1]]].sum(axis=0, dtype=np.float64)
            n = np.diff(np.concatenate([[0], np.cumsum(there)])[bounds])
            rest = np.concatenate([[0], np.cumsum(~there)])[bounds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(totals), pa.array(n), pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(distinct[codes[~there]].astype(np.int64)))], names=["doc_id", "vector", "n", "rest"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = stored(_hashed(tokens).mapInArrow(summed, f"doc_id {kind}, vector array<float>, n long, rest array<long>").withColumn("at", F.monotonically_increasing_id()), "documents")
    more = rows.select("at", F.explode("rest").alias("hash")).join(known.filter(~often).select("hash", "vector"), "hash").select("at", "vector", F.lit(1).cast("long").alias("n"))
    both = rows.select("at", F.col("doc_id").alias("id"), "vector", "n").join(_sums(more, "at").select("at", F.col("vector").alias("more"), F.col("n").alias("more_n")), "at", "left")
    total = F.col("n") + F.coalesce("more_n", F.lit(0))
    added = F.when(F.col("more").isNull(), F.col("vector")).otherwise(F.zip_with("vector", "more", lambda a, b: a + b))
    return both.select("id", F.transform(added, lambda x: x.cast("double") / F.greatest(total, F.lit(1))).alias("vector"))


def kmeans(vectors: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """id, vector, label; k is clamped to 1 .. number of rows."""
    k = max(1, min(k, vectors.count()))
    points = vectors.select("id", "vector", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    if k == 1:
        return points.select("id", "vector", F.lit(0).alias("label"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(points)
    return model.transform(points).select("id", "vector", "label")


def choose_k(vectors: DataFrame, largest: int = 10, seed: int = SEED) -> int:
    """The k from 2 with the best Euclidean silhouette, the least of equals; 1 for one row or no variance, 2 if none is better."""
    n = vectors.count()
    spread = total_variance(vectors).first()[0]
    if n <= 1 or not spread or spread < 1e-10:
        return 1
    points = vectors.select("id", "vector", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features")).cache()
    ks = list(range(2, min(largest, n - 1) + 1))
    labelled = points
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol=f"label{k}").fit(points)
        labelled = model.transform(labelled)
    best, chosen = -1.0, 2
    found = _silhouettes(labelled.select("id", "vector", F.array(*(f"label{k}" for k in ks)).alias("labels")), SILHOUETTE_ROWS) if ks else []
    for k, value in zip(ks, found):
        if value is not None and value > best:
            best, chosen = value, k
    points.unpersist()
    return chosen


def term_scores(docs: DataFrame, stopwords: Iterable[str] = T.STOPWORDS) -> DataFrame:
    """cluster, term, n, tf, other_tf, in_path, distinctiveness, place of each cluster's most frequent terms.

    docs: id, cluster, path, text.  Terms are compared with all documents of the other clusters.
    """
    words = spread(docs).select("cluster", F.explode(T.alphabetic_words(F.coalesce("text", F.lit("")), stopwords)).alias("term"))
    # read by four sums, so that texts are split once
    counted = stored(words.groupBy("cluster", "term").agg(F.count("*").alias("n")), "terms")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "term"))
    total = counted.groupBy("cluster").agg(F.sum("n").alias("total"))
    everywhere = counted.groupBy("term").agg(F.sum("n").alias("all_n"))
    overall = counted.agg(F.sum("n").alias("all_total"))
    paths = docs.select("cluster", F.explode(T.path_terms(F.coalesce("path", F.lit("")))).alias("term")).distinct().withColumn("in_path", F.lit(True))
    # places come first: a limit on them leaves few terms to join
    scored = counted.withColumn("place", place).join(total, "cluster").join(everywhere, "term").crossJoin(F.broadcast(overall)).join(paths, ["cluster", "term"], "left")
    tf, other = F.col("n") / F.col("total"), F.coalesce(F.try_divide(F.col("all_n") - F.col("n"), F.col("all_total") - F.col("total")), F.lit(0.0))
    return scored.select("cluster", "term", "n", tf.alias("tf"), other.alias("other_tf"), F.coalesce("in_path", F.lit(False)).alias("in_path"), F.greatest(F.lit(0.0), tf - other).alias("distinctiveness"), "place")


def keywords(scores: DataFrame, words: DataFrame, n: int = 5) -> DataFrame:
    """cluster, keywords: the best terms by path, distinctiveness and coherence, none too like one before it.

    Coherence is a term's mean cosine to the other compared terms, worked out from the sum of
    their unit vectors: (u.sum - 1) / (m - 1).  At most ``SCORED`` terms a cluster meet in one task.
    """
    near = scores.filter(F.col("place") <= COMPARED).join(words, scores["term"] == words["word"]).drop("word")

    def chosen(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", kind="stable").reset_index(drop=True)
        vectors = np.stack(part["vector"].to_numpy()).astype(float)
        units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        m = len(units)
        coherence = (units @ units.sum(axis=0) - 1) / (m - 1) if m > 1 else np.zeros(m)
        score = 0.8 * part["in_path"].to_numpy() + 0.3 * part["distinctiveness"].to_numpy() + 0.3 * coherence
        some = [k for k in np.argsort(-score, kind="stable") if part["place"][k] <= SCORED]
        kept: list[int] = []
        for k in some:
            if len(kept) == n:
                break
            if all(units[k] @ units[j] <= ALIKE for j in kept):
                kept.append(k)
        return pd.DataFrame({"cluster": [part["cluster"][0]], "keywords": [[part["term"][k] for k in kept]]})

    kind = scores.schema["cluster"].dataType.simpleString()
    return near.select("cluster", "term", "place", "in_path", "distinctiveness", "vector").groupBy("cluster").applyInPandas(chosen, f"cluster {kind}, keywords array<string>")


def previews(docs: DataFrame) -> DataFrame:
    """docs (id, path, text) with a preview whose length follows the file's type."""
    kind = U.suffix(F.col("path"))
    sentences, chars = (F.lit(PREVIEWS[""][k]) for k in (0, 1))
    for name, limits in PREVIEWS.items():
        sentences, chars = (F.when(kind == name, F.lit(limits[k])).otherwise(old) for k, old in ((0, sentences), (1, chars)))
    sized = docs.withColumns({"__sentences": sentences, "__chars": chars})
    # written, so that the shuffles of sentences go before texts are joined
    short = stored(summarize.summaries(sized.select(F.col("id").alias("doc_id"), "text", "__sentences"), "__sentences").select(F.col("doc_id").alias("id"), "summary"), "summaries")
    shown = summarize.preview(F.col("text"), F.col("summary"), F.col("__sentences"), F.col("__chars"))
    return sized.join(short, "id", "left").withColumn("preview", shown).drop("summary", "__sentences", "__chars")


def structure(docs: DataFrame, named: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Per document: cluster, name, keywords, size, id, path, url, preview, characters, read_time.

    docs: id, cluster, path, url, text, preview; named: cluster, keywords; labelled: the documents
    before their previews, to be counted without these.  Clusters of one name stay apart.
    """
    sizes = (docs if labelled is None else labelled).groupBy("cluster").agg(F.count("*").alias("size"))
    name = T.cluster_name(F.slice("keywords", 1, 2), F.concat(F.lit("Cluster_"), F.col("cluster").cast("string")))
    about = sizes.join(named, "cluster", "left").select("cluster", name.alias("name"), "keywords", "size")
    text = F.coalesce("text", F.lit(""))
    return docs.join(F.broadcast(about), "cluster").select(
        "cluster", "name", "keywords", "size", "id", "path", F.coalesce("url", F.lit("")).alias("url"), "preview", F.length(text).alias("characters"), T.read_time(text).alias("read_time")
    )


def nested(rows: DataFrame) -> DataFrame:
    """``structure`` with one row per cluster and its documents as an array, for collections that one row can hold."""
    entry = F.struct("id", "path", "url", "preview", "characters", "read_time")
    return rows.groupBy("cluster", "name", "keywords", "size").agg(F.array_sort(F.collect_list(entry)).alias("documents"))


def empty_documents(docs: DataFrame, path: Column, text: Column) -> DataFrame:
    """path of the documents without text."""
    return docs.filter(F.coalesce(text, F.lit("")) == "").select(path.alias("path"))
