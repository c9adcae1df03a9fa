"""Best-fit packing of tokenised documents with certified bin counts.

Pieces are dealt by hash to partitions of bounded size.  Each is packed best-fit
decreasing and its number of sequences is compared with a lower bound from dual feasible
functions.  A partition with a gap between the two, or with others beside it whose gaps
could be filled together, gives up its least filled sequences; the given-up pieces of
several partitions meet in one and are packed again, best-fit decreasing and, if that
leaves a gap, by best-fitting subsets, and so on until one partition is left.  A
repacking counts only if it saves a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

CAPACITY = 2048
#: Pieces that one task packs.
PART_PIECES = 100_000
#: Sequences that a partition gives up at least, those for each sequence of its gap, and partitions whose given-up pieces meet.
GIVEN_UP, BY_GAP, MEET = 256, 8, 8
#: Pieces among which best subsets are sought at a time.
SUBSET_PIECES = 2_000
#: Longer texts, and those with code points from U+0280 on, go through the slower tokenizer library.
LONG_TEXT, FIRST_RARE_BYTE = 1_000_000, 0xCA

_LOADED: dict[tuple[str, str], object] = {}


def _tokenizer(name: str):
    """The tokenizer itself, loaded once in a worker that needs it."""
    if ("tokenizer", name) not in _LOADED:
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED["tokenizer", name] = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    return _LOADED["tokenizer", name]


def _fast(name: str) -> tuple:
    """(the same vocabulary in the faster library, the strings of special tokens); loaded once in a worker."""
    if ("fast", name) not in _LOADED:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as text:
            special = [t["content"] for t in json.load(text)["added_tokens"]]
        _LOADED["fast", name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special
    return _LOADED["fast", name]


def encode(texts: list[str], name: str = "byte_bpe_50k") -> Iterator[np.ndarray]:
    """uint32 ids of each text by the tokenizer's own rules, without added special tokens.

    Both libraries give the same ids where their tables of letters agree; what could
    differ (rare code points, the special token's own string) takes the first library.
    """
    fast, special = _fast(name)
    for text in texts:
        rare = not text.isascii() and bool((np.frombuffer(text.encode(), np.uint8) >= FIRST_RARE_BYTE).any())
        if rare or len(text) > LONG_TEXT or any(x in text for x in special):
            yield np.array(_tokenizer(name).encode(text, add_special_tokens=False).ids, "<u4")
        else:
            yield np.array(fast.encode_ordinary(text), "<u4")


def _pieces(name: str, capacity: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            row = []
            for r, ids in enumerate(encode([x or "" for x in batch.column("text").to_pylist()], name)):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    out.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    row.append(r)
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return of


def pieces(spark: SparkSession, docs: DataFrame, *, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a closing 0, cut into pieces.

    Documents of at most ``capacity`` ids are one piece; of longer ones the first piece
    takes the remainder.  A null text is empty: its only id is the closing 0.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; free room is kept as a bit set over room sizes."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, opened = 0, 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fitting = present >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                present ^= 1 << room
        else:
            room, b, opened = capacity, opened, opened + 1
        bins[k], offsets[k] = b, capacity - room
        if left := room - n:
            rooms[left].append(b)
            present |= 1 << left
    return bins, offsets


def best_subsets(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset): each bin takes the longest piece left and the subset of the rest that fits it best.

    Reachable sums are bit sets, extended piece by piece, long ones first, until the bin is full.
    """
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    left = np.argsort(-lengths, kind="stable").tolist()
    while left:
        head, rest = left[0], left[1:]
        room = capacity - int(lengths[head])
        within, sums = (1 << (room + 1)) - 1, [1]
        for k in rest:
            if sums[-1] >> room & 1:
                break
            sums.append((sums[-1] | sums[-1] << int(lengths[k])) & within)
        want, taken = sums[-1].bit_length() - 1, {}
        for j in range(len(sums) - 2, -1, -1):
            if not sums[j] >> want & 1:
                want -= int(lengths[rest[j]])
                taken[j] = rest[j]
        end = 0
        for k in (head, *taken.values()):
            bins[k], offsets[k] = made, end
            end += int(lengths[k])
        left, made = [k for j, k in enumerate(rest) if j not in taken], made + 1
    return bins, offsets


def best_subsets_by_parts(lengths: np.ndarray, capacity: int = CAPACITY, part: int = SUBSET_PIECES) -> tuple[np.ndarray, np.ndarray]:
    """``best_subsets`` of parts with a like mix of lengths, so that its cost stays in proportion to the pieces."""
    parts = max(1, -(-len(lengths) // part))
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    order = np.argsort(-lengths, kind="stable")
    for k in range(parts):
        own = order[k::parts]
        at, offsets[own] = best_subsets(lengths[own], capacity)
        bins[own] = at + made
        made += int(at.max(initial=-1)) + 1
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins that dual feasible functions prove necessary.

    Two families: the rounding functions u_k, and those that count items over
    capacity - a in full, drop items under a and keep the rest.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 33):
        scaled = np.where(size * (k + 1) % capacity == 0, size * k, (size * (k + 1) // capacity) * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    number, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    a = np.arange(0, capacity // 2 + 1)
    full = number[-1] - number[capacity - a + 1]
    large, small = total[capacity - a + 1] - total[capacity // 2 + 1], total[capacity // 2 + 1] - total[a]
    halves = number[capacity - a + 1] - number[capacity // 2 + 1]
    spill = np.maximum(0, -(-(small - (halves * capacity - large)) // capacity))
    return max(best, int((full + halves + spill).max()))


def _packed(capacity: int, round_: int, last: bool, several: bool):
    def of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = part["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        bound, made = lower_bound(lengths, capacity), int(bins.max()) + 1
        if round_ and made > bound:
            other = best_subsets_by_parts(lengths, capacity)
            if other[0].max() + 1 < made:
                bins, offsets, made = *other, int(other[0].max()) + 1
        before = part["sequence_id"].nunique() if round_ else made + 1
        if made < before:
            part["sequence_id"] = (round_ << 56) + (int(key[0]) << 28) + bins
            part["offset"] = offsets
        else:
            made = before
        part["open"] = False
        if not last and (made > bound or several):
            filled = part.groupby("sequence_id")["length"].sum().sort_values(kind="stable")
            worst = filled[filled < capacity].index[: max(GIVEN_UP, BY_GAP * (made - bound))]
            part["open"] = part["sequence_id"].isin(worst)
        part["gap"] = made - bound
        return part

    return of


def pack(spark: SparkSession, docs: DataFrame, *, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every sequence is gapless from offset 0 and holds at most ``capacity`` ids.  A null id
    stays null; repeated rows are packed once each; columns other than doc_id and text are
    ignored.  An empty table gives an empty result.
    """
    work = Workspace(spark, "packing")
    cut = work.save(pieces(spark, docs, tokenizer=tokenizer, capacity=capacity), "pieces")
    parts = max(1, -(-cut.count() // part_pieces))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, part int, open boolean, gap long"
    open_ = cut.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    open_ = open_.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    done, round_ = None, 0
    while True:
        last = parts == 1 and round_ > 0
        columns = [*names, "part"]
        packed = open_.select(columns).groupBy("part").applyInPandas(_packed(capacity, round_, last, parts > 1), schema)
        packed = work.save(packed, f"round-{round_}")
        settled = packed.filter("not open").select(names)
        done = settled if done is None else done.unionByName(settled)
        if last or packed.filter("open").isEmpty():
            return done
        parts, round_ = -(-parts // MEET), round_ + 1
        open_ = packed.filter("open").withColumn("part", F.floor(F.col("part") / MEET).cast("int"))
