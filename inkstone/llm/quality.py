"""Quality rules: text statistics, base limits, and an isolation forest over rule ratios.

Each rule statistic is a ratio's excess over the rule's limit, so unremarkable documents
coincide and no split parts them.  The forest isolates documents by random splits; short
mean paths are anomalies.  Its trees are fitted on a bounded sample (the method's own
sub-samples); statistics and scores cover every document, and the threshold is
calibrated on all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel
from .textkernel import U64, mix
from .workspace import Workspace

#: The forest: number of trees, rows of a tree, rows sampled for all trees, seed.
TREES, TREE_ROWS, SAMPLE_ROWS, SEED = 100, 256, 10_000, 17
#: Least share of the labelled good documents that the threshold keeps.
KEEP_GOOD = 0.995
#: Anomaly scores lie between 0 and 1; the threshold is sought on this grid.
GRID = 2000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules: a ratio and the limit from which it counts; long_words and short_words share the mean word length.
RULES = {"symbols": 0.1, "dup_lines": 0.3, "repeat_words": 0.2, "upper": 0.3, "marks": 0.1, "digits": 0.15, "long_words": 10.0, "short_words": 3.0}
FEATURES = tuple(f"{rule}_excess" for rule in RULES)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_BYTE = np.arange(256)
_UPPER, _DIGIT = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57)
_LEADS = (_BYTE & 0xC0) != 0x80  # the first byte of a code point


def _per_row(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def _repeated(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of codes that occur twice or more, and of codes that equal an earlier one."""
    order = np.argsort(codes, kind="stable")
    equal = codes[order][1:] == codes[order][:-1]
    any_, later = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    later[order[1:][equal]] = True
    any_[order[1:][equal]] = True
    any_[order[:-1][equal]] = True
    return any_, later


def statistics(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(int64[n, 5] COUNTS, float64[n, 8] FEATURES: each rule's ratio beyond its limit) of each row of one slice of texts."""
    n_rows = len(starts) - 1
    begin, end, rows = textkernel.word_bounds(data, starts)
    words = textkernel.word_hashes(data, begin, end)
    n_words = np.bincount(rows, minlength=n_rows)
    chars = _per_row(_LEADS[data] & ~textkernel.SPACE[data], starts)
    symbols, marks, upper, digits = (_per_row(t[data], starts) for t in (_SYMBOL, _MARK, _UPPER, _DIGIT))

    a, b, line_rows = textkernel.word_bounds(data, starts, _NEWLINE)
    inked = np.concatenate([[0], np.cumsum(~textkernel.SPACE[data], dtype=np.int64)])
    full = inked[b] > inked[a]
    a, b, line_rows = a[full], b[full], line_rows[full]
    salt = mix(np.arange(n_rows, dtype=U64) + U64(1))
    later = _repeated(textkernel.word_hashes(data, a, b) ^ salt[line_rows])[1]
    dup_lines, lines = np.bincount(line_rows[later], minlength=n_rows), np.bincount(line_rows, minlength=n_rows)

    covered, n = np.zeros(len(words), bool), len(words) - 2
    if n > 0:
        codes = mix(words[:n] + words[1 : n + 1] * U64(0x9E3779B97F4A7C15) + words[2:] * U64(0xC2B2AE3D27D4EB4F))
        at = np.flatnonzero(rows[:n] == rows[2:])
        again = at[_repeated(codes[at] ^ salt[rows[at]])[0]]
        for k in range(3):
            covered[again + k] = True
    repeats = np.bincount(rows[covered], minlength=n_rows)
    per_word, per_char = 1 / np.maximum(n_words, 1), 1 / np.maximum(chars, 1)
    counts = np.stack([n_words, chars, symbols, dup_lines, repeats], axis=1).astype(np.int64)
    ratios = dict(symbols=symbols * per_word, dup_lines=dup_lines / np.maximum(lines, 1), repeat_words=repeats * per_word, upper=upper * per_char, marks=marks * per_word, digits=digits * per_char, long_words=chars * per_word)
    over = [np.maximum(ratios[k] - RULES[k], 0.0) for k in ratios]
    over.append(np.where(n_words > 0, np.maximum(RULES["short_words"] - chars * per_word, 0.0), 0.0))
    return counts, np.stack(over, axis=1).astype(np.float64)


class IsolationForest:
    """Trees of random splits; ``score`` is 2 ** (-mean path / expected path), near 1 for anomalies."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED):
        random = np.random.Generator(np.random.PCG64(seed))
        self.rows = min(rows, len(sample))
        self.trees = [self._grow(sample[random.choice(len(sample), self.rows, replace=False)], random) for _ in range(trees)] if self.rows > 1 else []

    @staticmethod
    def expected(n: int) -> float:
        """Mean path of an unsuccessful search in a binary search tree of n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, random) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(self.rows, 2))))
        feature, split, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            k = len(feature)
            for column in (feature, left, right):
                column.append(0)
            split.append(0.0)
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= limit or len(part) <= 1 or not len(open_):
                left[k] = right[k] = k
                path.append(depth + self.expected(len(part)))
                return k
            path.append(0.0)
            feature[k] = int(random.choice(open_))
            a, b = float(low[feature[k]]), float(high[feature[k]])
            split[k] = s if a < (s := float(random.uniform(a, b))) <= b else b  # neither side is empty
            less = part[:, feature[k]] < split[k]
            left[k], right[k] = node(part[less], depth + 1), node(part[~less], depth + 1)
            return k

        node(rows, 0)
        return np.array(feature), np.array(split), np.array(left), np.array(right), np.array(path), limit

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(rows), 0.5)
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, left, right, path, limit in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(limit):
                at = np.where(rows[every, feature[at]] < split[at], left[at], right[at])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.expected(self.rows))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, starts in textkernel.text_slices(batch.column("text")):
            counts, ratios = statistics(data, starts)
            arrays = [batch.column("doc_id").slice(first, len(counts)), *(pa.array(c) for c in counts.T), *(pa.array(c) for c in ratios.T)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COUNTS, *FEATURES])


def _scored(forest):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in FEATURES], axis=1) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.value.score(rows))], names=[*batch.schema.names, "anomaly"])

    return of


def threshold(scores: list[tuple[int, int, int]], keep_good: float = KEEP_GOOD) -> int:
    """The grid step of the anomaly score from which documents go.

    scores: (grid step, quality, count) of all labelled rows.  Among the thresholds that
    keep at least ``keep_good`` of the good rows but one (a single odd row of few proves
    nothing), the one that rejects the most bad less good rows, as shares; the highest of
    equals.  Without bad rows, nothing goes.
    """
    good, bad = np.zeros(GRID + 2, np.int64), np.zeros(GRID + 2, np.int64)
    for step, quality, count in scores:
        (good if quality else bad)[step] += count
    lost, caught = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    gain = np.where(lost <= (1 - keep_good) * good.sum() + 1, caught / max(bad.sum(), 1) - lost / max(good.sum(), 1), -np.inf)
    best = GRID + 1 - int(np.argmax(gain[::-1]))
    return best


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _statistics(docs: DataFrame, work: Workspace) -> tuple[DataFrame, str]:
    """(doc_id, COUNTS and FEATURES of every row, their schema)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in FEATURES])
    return work.save(texts.mapInArrow(_counted, schema), "statistics"), schema


def _fitted(spark: SparkSession, counted: DataFrame, labels: DataFrame, work: Workspace, sample_rows: int, keep_good: float, schema: str):
    """(broadcast forest, grid step from which documents go) for statistics of documents.

    The sample is what a hash of id and statistics draws, in the order of that hash, so
    neither files nor partitions matter.
    """
    labelled = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    passed = counted.filter(~_base_failed())
    judged = work.save(passed.join(labelled, "doc_id"), "labelled")
    order = F.xxhash64("doc_id", *FEATURES)
    share = min(1.0, 1.1 * sample_rows / max(1, passed.count()))
    drawn = passed.select(order.alias("order"), *FEATURES).filter(F.pmod("order", F.lit(1_000_000)) < int(share * 1_000_000))
    sampled = [r[1:] for r in drawn.orderBy("order", *FEATURES).limit(sample_rows).collect()]
    forest = spark.sparkContext.broadcast(IsolationForest(np.array(sampled, float).reshape(-1, len(FEATURES))))
    step = F.ceil(F.col("anomaly") * GRID).cast("int").alias("step")
    marked = judged.mapInArrow(_scored(forest), f"{schema}, quality int, anomaly double")
    limit = threshold([r[:] for r in marked.groupBy(step, "quality").count().collect()], keep_good)
    work.drop("labelled")
    return forest, limit


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, keep_good: float = KEEP_GOOD) -> DataFrame:
    """Per document: doc_id, COUNTS, base_failed, kept, anomaly, FEATURES.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word
    windows.  kept: not base_failed and the anomaly score lies under the threshold.
    labels: doc_id, quality (0 or 1, null rows ignored).  The forest is fitted on at most
    ``sample_rows`` of the documents that pass the base limits, drawn by a hash.  Null or
    empty texts have no words and fail.  Rows that repeat an id are judged one by one.
    Columns of docs other than doc_id and text are ignored; an empty table gives an empty
    result.
    """
    work = Workspace(spark, "quality")
    counted, schema = _statistics(docs, work)
    forest, limit = _fitted(spark, counted, labels, work, sample_rows, keep_good, schema)
    scored = counted.mapInArrow(_scored(forest), f"{schema}, anomaly double")
    kept = (~_base_failed() & (F.ceil(F.col("anomaly") * GRID) < limit)).alias("kept")
    return scored.select("doc_id", *COUNTS, _base_failed().alias("base_failed"), kept, "anomaly", *FEATURES)


def good(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, keep_good: float = KEEP_GOOD) -> DataFrame:
    """The rows of docs (all their columns) that ``quality`` keeps.

    Every row is judged by its own text, whatever its id, where it lies: texts are not
    shuffled, their statistics are made again instead.
    """
    work = Workspace(spark, "quality")
    counted, schema = _statistics(docs, work)
    forest, limit = _fitted(spark, counted, labels, work, sample_rows, keep_good, schema)
    work.drop("statistics")
    at = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, data, starts in textkernel.text_slices(batch.column(at).cast(pa.string())):
                counts, ratios = statistics(data, starts)
                n_words, repeats = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
                keep[first : first + len(counts)] = (n_words >= 50) & (100 * repeats <= 50 * n_words) & (np.ceil(forest.value.score(ratios) * GRID) < limit)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(of, docs.schema)
