import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import packing

from .conftest import prose, rows


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = reference_ids.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def expected_pieces(docs, capacity):
    out = []
    for doc_id, text in docs:
        ids = reference_ids(text)
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            out.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=repr)


def check_sequences(found, capacity):
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_pieces_and_sequences(spark):
    docs = [(k, prose(5 + 37 * k % 900, k)) for k in range(150)] + [(500, None), (501, ""), (502, "a<|endoftext|>b"), (503, "日本語 текст ελληνικά " * 40), (504, "x" * 50_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = packing.pack(spark, frame, capacity=512, part_pieces=40).collect()
    ours = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr)
    assert ours == expected_pieces(docs, 512)
    made = check_sequences(found, 512)
    bound = packing.lower_bound(np.array([r["length"] for r in found]), 512)
    assert bound <= made <= bound + 1


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_both_libraries_give_the_same_ids(text):
    assert next(packing.encode([text])).tolist() == reference_ids(text)[:-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_bound_and_packing(lengths):
    lengths = np.array(lengths)
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    bound = packing.lower_bound(lengths, 64)
    assert -(-int(lengths.sum()) // 64) <= bound <= bins.max() + 1
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        order = own[np.argsort(offsets[own])]
        assert (offsets[order] == np.concatenate([[0], np.cumsum(lengths[order])[:-1]])).all() and lengths[order].sum() <= 64


def _least_bins(lengths, capacity):
    """Exact by search over assignments."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted(set(x for x in rooms if x >= lengths[k])):
            after = list(rooms)
            after[after.index(r)] -= lengths[k]
            place(k + 1, after)
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_bound_is_no_more_than_the_optimum():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randint(1, 30) for _ in range(8)]
        assert packing.lower_bound(np.array(lengths), 30) <= _least_bins(lengths, 30)
    assert packing.lower_bound(np.array([16] * 5), 30) == 5 and packing.lower_bound(np.array([], int), 30) == 0


def test_odd_rows(spark, odd, empty):
    found = packing.pack(spark, odd).collect()
    ours = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr)
    assert ours == expected_pieces([(r["doc_id"], r["text"]) for r in odd.collect()], packing.CAPACITY)
    check_sequences(found, packing.CAPACITY)
    assert packing.pack(spark, empty).count() == 0
    assert rows(packing.pack(spark, empty), "doc_id") == []


@pytest.mark.parametrize("parts", [30, 5000])
def test_repacking_saves_sequences(spark, parts):
    docs = spark.createDataFrame([(k, prose(20 + (k * 31) % 60, k)) for k in range(400)], "doc_id long, text string")
    found = packing.pack(spark, docs, capacity=400, part_pieces=parts).collect()
    bound = packing.lower_bound(np.array([r["length"] for r in found]), 400)
    assert check_sequences(found, 400) <= bound + 2


def test_subsets_by_parts_hold_every_piece_once():
    rng = np.random.default_rng(4)
    lengths = rng.integers(200, 1400, 700)
    for part in (100, 10_000):
        bins, offsets = packing.best_subsets_by_parts(lengths, part=part)
        for b in range(bins.max() + 1):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert len(own) and offsets[own].tolist() == np.concatenate([[0], np.cumsum(lengths[own])[:-1]]).tolist() and lengths[own].sum() <= packing.CAPACITY
        assert bins.max() + 1 <= 1.05 * packing.lower_bound(lengths) + 8
