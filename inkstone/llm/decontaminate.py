"""Benchmark decontamination with spaced seeds.

Texts become words of letters, digits and non-ASCII bytes (A-Z in lower case).  Each
fixed mask looks at some positions of a span of words and ignores the others, so a
replaced word under an ignored position still gives the same hash.  Training hashes are
joined with the benchmark's, and around each hit the two texts are laid on the same
diagonal and compared word by word, substitutions allowed.

The benchmark is taken in blocks of bounded size; each block's hash table is sent to the
executors and all documents are scanned against it without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel
from .textkernel import U64, mix
from .workspace import Workspace

#: Positions that a mask looks at; the rest of its span is ignored.  Wherever a fifth of 8 to 20
#: words is replaced, one of the first two still fits somewhere, so no allowed overlap is missed.
MASKS = ((0, 1, 3, 4), (0, 1, 2, 3), (0, 2, 3, 5))
#: Characters of benchmark text whose hash table is on the executors at one time.
BLOCK_CHARS = 8_000_000
#: An overlap is a longest stretch of at least so many words (or the whole item, if shorter) ...
MIN_WORDS = 13
#: ... of which so many in a hundred are alike.
IDENTITY = 80
#: Items of fewer words than SHORT must be found as they are; those of fewer than LEAST_ITEM are no evidence.
SHORT, LEAST_ITEM = 8, 4
#: Candidate places that are compared at a time, in words.
COMPARED = 2_000_000

_FACTORS = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = textkernel.LOWER[data]
    begin, end, rows = textkernel.word_bounds(data, starts, textkernel.SIGNS)
    return textkernel.word_hashes(data, begin, end), rows


def _seeds(words: np.ndarray, rows: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each place where the mask's span lies in one row."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    codes = np.zeros(n, U64)
    for k, offset in enumerate(mask):
        codes += words[offset : offset + n] * _FACTORS[k]
    at = np.flatnonzero(rows[:n] == rows[mask[-1] :])
    return mix(codes[at]), at


class Index:
    """Sorted seed hashes of a block of benchmark items, with a bitmap before them."""

    BITS = 20

    def __init__(self, items: list[tuple[int, str]], least_item: int = LEAST_ITEM):
        self.ids = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.large_string())
        words, rows = [], []
        for first, data, starts in textkernel.text_slices(column):
            w, r = _words(data, starts)
            words.append(w)
            rows.append(r + first)
        self.words = np.concatenate(words or [np.zeros(0, U64)])
        rows = np.concatenate(rows or [np.zeros(0, np.int64)])
        self.first = np.searchsorted(rows, np.arange(len(items) + 1))
        self.item = rows
        self.size = np.diff(self.first)
        self.seeds = []
        #: items too short for the masks are looked for word by word
        whole = [tuple(range(n)) for n in range(least_item, min(m[-1] + 1 for m in MASKS[:2])) if (self.size == n).any()]
        self.masks = (*MASKS, *whole)
        for mask in self.masks:
            codes, at = _seeds(self.words, rows, mask)
            fits = self.size[rows[at]] >= least_item if mask in MASKS else self.size[rows[at]] == len(mask)
            codes, at = codes[fits], at[fits]
            order = np.argsort(codes, kind="stable")
            bitmap = np.zeros(1 << self.BITS, bool)
            bitmap[(codes >> U64(64 - self.BITS)).astype(np.int64)] = True
            self.seeds.append((codes[order], at[order], bitmap))

    def hits(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (item, document position of the item's first word) with a seed in common."""
        items, shifts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for mask, (known, place, bitmap) in zip(self.masks, self.seeds):
            codes, at = _seeds(words, rows, mask)
            some = bitmap[(codes >> U64(64 - self.BITS)).astype(np.int64)]
            codes, at = codes[some], at[some]
            low, high = np.searchsorted(known, codes, "left"), np.searchsorted(known, codes, "right")
            count = high - low
            there = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if count.sum() else np.zeros(0, np.int64)
            where = place[there]
            item = self.item[where]
            items.append(item)
            shifts.append(np.repeat(at, count) - (where - self.first[item]))
        both = np.unique(np.stack([np.concatenate(items), np.concatenate(shifts)]), axis=1)
        return both[0], both[1]


def longest_alike(same: np.ndarray, identity: int = IDENTITY) -> tuple[int, int]:
    """(start, end) of the longest stretch with at least identity % true; the first of equals."""
    gain = np.where(same, 100 - identity, -identity)
    sums = np.concatenate([[0], np.cumsum(gain)])
    lowest = np.minimum.accumulate(sums)
    start = np.searchsorted(-lowest, -sums, "left")
    length = np.arange(len(sums)) - start
    end = int(np.argmax(length))
    return int(start[end]), end


def _likely(block: Index, words: np.ndarray, items: np.ndarray, shifts: np.ndarray, min_words: int, identity: int) -> Iterator[tuple[int, int]]:
    """The hits with enough words alike on their diagonal, wherever documents begin and end."""
    need = np.ceil(np.minimum(block.size[items], min_words) * np.where(block.size[items] < SHORT, 100, identity) / 100 - 1e-9)
    ends = np.cumsum(block.size[items])
    first = 0
    while first < len(items):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COMPARED, "right")))
        size = block.size[items[first:last]]
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        inner = np.arange(size.sum()) - np.repeat(at, size)
        place = np.repeat(shifts[first:last], size) + inner
        inside = (place >= 0) & (place < len(words))
        same = inside & (words[np.where(inside, place, 0)] == block.words[np.repeat(block.first[items[first:last]], size) + inner])
        good = np.add.reduceat(same, at, dtype=np.int64) >= need[first:last]
        yield from zip(items[first:last][good].tolist(), shifts[first:last][good].tolist())
        first = last


def _found(block: Index, words: np.ndarray, rows: np.ndarray, edge: np.ndarray, min_words: int, identity: int) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """By (row, item): the longest overlap's words, words alike, and its first word in the row and in the item."""
    seen: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    items, shifts = block.hits(words, rows)
    for item, shift in _likely(block, words, items, shifts, min_words, identity) if len(items) else ():
        first, n = int(block.first[item]), int(block.size[item])
        # the seed lies in one document; find it from the part of the item that can overlap
        for doc in range(int(rows[max(shift, 0)]), int(rows[min(shift + n, len(rows)) - 1]) + 1):
            low, high = max(int(edge[doc]) - shift, 0), min(int(edge[doc + 1]) - shift, n)
            if high - low < min(min_words, n):
                continue
            same = words[shift + low : shift + high] == block.words[first + low : first + high]
            a, b = longest_alike(same, 100 if n < SHORT else identity)
            if b - a >= min(min_words, n):
                found = (b - a, int(same[a:b].sum()), int(shift + low + a - edge[doc]), int(low + a))
                if found[:2] > seen.get((doc, item), (0, 0))[:2]:
                    seen[doc, item] = found
    return seen


def _scan(index, min_words: int, identity: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for batch in batches:
            ids = batch.column("doc_id")
            for row, data, starts in textkernel.text_slices(batch.column("text")):
                words, rows = _words(data, starts)
                seen = _found(block, words, rows, np.searchsorted(rows, np.arange(len(starts))), min_words, identity)
                if seen:
                    docs = pa.array([d + row for d, _ in seen], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(docs), pa.array([block.ids[i][0] for _, i in seen], pa.int64()), pa.array([block.ids[i][1] for _, i in seen], pa.int64()),
                            *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4)),
                        ],
                        names=["doc_id", "item_id", "n_items", "n_words", "n_same", "doc_word", "item_word"],
                    )

    return of


def _clean(index, at: int, min_words: int, identity: int):
    """Rows without an overlap; at: the place of their text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, data, starts in textkernel.text_slices(batch.column(at).cast(pa.string())):
                words, rows = _words(data, starts)
                for doc, _ in _found(block, words, rows, np.searchsorted(rows, np.arange(len(starts))), min_words, identity):
                    keep[row + doc] = False
            yield batch.filter(pa.array(keep))

    return of


def _blocks(spark: SparkSession, benchmark: DataFrame, least_item: int) -> Iterator[tuple[bool, object]]:
    """(whether it is the only one, broadcast Index) of each block of distinct benchmark texts."""
    items = benchmark.filter("length(text) > 0").groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"), F.count("*").alias("n_items"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_CHARS))
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()  # one block: bounded by BLOCK_CHARS
        yield blocks == 1, spark.sparkContext.broadcast(Index([((r["item_id"], r["n_items"]), r["text"]) for r in rows], least_item))


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, min_words: int = MIN_WORDS, identity: int = IDENTITY, least_item: int = LEAST_ITEM) -> DataFrame:
    """Per document and distinct benchmark text that overlap: doc_id, item_id, n_items, n_words, n_same, doc_word, item_word.

    docs: doc_id, text; benchmark: item_id, text.  Equal benchmark texts count as one item,
    named by its least item_id, n_items giving how many there are.  n_words is the longest
    overlap in words, n_same how many of them are alike, doc_word and item_word where it
    starts.  Null or empty texts overlap with nothing, and neither do items of fewer than
    ``least_item`` words; items of fewer than SHORT words must be found whole and unchanged.
    Rows repeated in docs are reported again.  Other columns are ignored; an empty table on
    either side gives an empty result.  With more than one block of benchmark, each block's
    overlaps are written before the next one is read.
    """
    work = Workspace(spark, "decontaminate")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_items long, n_words long, n_same long, doc_word long, item_word long"
    found = None
    for k, (only, index) in enumerate(_blocks(spark, benchmark, least_item)):
        part = texts.mapInArrow(_scan(index, min_words, identity), schema)
        if not only:
            part = work.save(part, f"block-{k}")
            index.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, min_words: int = MIN_WORDS, identity: int = IDENTITY, least_item: int = LEAST_ITEM) -> DataFrame:
    """The rows of docs (all their columns) whose text overlaps with no benchmark item.

    Every row is judged by its own text, whatever its id; null and empty texts stay.
    """
    work = Workspace(spark, "decontaminate")
    for k, (only, index) in enumerate(_blocks(spark, benchmark, least_item)):
        docs = docs.mapInArrow(_clean(index, docs.columns.index("text"), min_words, identity), docs.schema)
        if not only:
            docs = work.save(docs, f"block-{k}")
            index.destroy()
            if k:
                work.drop(f"block-{k - 1}")
    return docs
