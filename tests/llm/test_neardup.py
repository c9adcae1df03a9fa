import numpy as np
import pytest

from inkstone.llm import neardup, setsketch, textkernel
from inkstone.llm.components import connected_components
from inkstone.llm.workspace import Workspace

from .conftest import prose


def _sets(docs, width):
    out = []
    for doc_id, text in docs:
        words = (text or "").encode().lower().split()
        out.append((doc_id, frozenset(zip(*(words[k:] for k in range(width)))) if len(words) >= width else frozenset([tuple(words)]) if words else frozenset()))
    return out


def _brute(docs, width, num, den):
    sets = _sets(docs, width)
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets}


def _edited(text, every, seed):
    words = text.split()
    for k in range(seed % every, len(words), every):
        words[k] = f"edit{seed}x{k}"
    return " ".join(words)


@pytest.mark.parametrize("width,num,den,band_rows", [(3, 85, 100, 5), (5, 4, 5, 4)])
def test_same_as_brute_force(spark, width, num, den, band_rows):
    docs = [(k, prose(120, k)) for k in range(30)]
    docs += [(100 + k, _edited(prose(300, k % 6), 150 - 5 * (k % 20), k)) for k in range(120)]
    docs += [(300 + k, prose(120, k % 3).upper()) for k in range(9)] + [(400, ""), (401, None), (402, "two words"), (403, "TWO  words")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = neardup.near_duplicates(spark, frame, width=width, num=num, den=den, band_rows=band_rows)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == _brute(docs, width, num, den)


def test_large_bucket_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    base = prose(400, 1)
    docs = [(k, _edited(base, 25 + k % 9, k)) for k in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = neardup.near_duplicates(spark, frame, width=3, num=85, den=100, band_rows=5)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == _brute(docs, 3, 85, 100)


def test_repeated_rows_are_not_paired(spark, monkeypatch):
    base = prose(300, 1)
    docs = [(k, _edited(base, 60, k)) for k in range(2)]
    frame = spark.createDataFrame([d for d in docs for _ in range(300)], "doc_id long, text string")
    saved = {}
    save = Workspace.save

    def kept(self, frame, name, *more):
        out = save(self, frame, name, *more)
        saved[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "save", kept)
    found = neardup.near_duplicates(spark, frame, width=3, num=85, den=100, band_rows=5).collect()
    assert len(found) == 600 and {r["component_id"] for r in found} == {0} and sum(r["kept"] for r in found) == 300
    assert saved["links-1"] <= 2 and saved["texts"] == 2


def test_busy_nodes_and_half_digests_that_clash(spark, monkeypatch):
    base = prose(300, 1)
    docs = [(k, _edited(base, 60 + k % 9, k)) for k in range(80)] + [(100 + k, prose(100, 50 + k % 7)) for k in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    expected = _brute(docs, 3, 85, 100)
    monkeypatch.setattr(neardup, "SPLIT", 3)
    assert {r[0]: tuple(r[1:]) for r in neardup.near_duplicates(spark, frame, width=3, num=85, den=100, band_rows=5).collect()} == expected
    save = Workspace.save

    def clashing(self, frame, name, *more):
        if name == "signatures":
            frame = frame.withColumn("node", frame["node"] % 5)
        return save(self, frame, name, *more)

    monkeypatch.setattr(Workspace, "save", clashing)
    assert {r[0]: tuple(r[1:]) for r in neardup.near_duplicates(spark, frame, width=3, num=85, den=100, band_rows=5).collect()} == expected


def test_odd_rows(spark, odd):
    found = neardup.near_duplicates(spark, odd).collect()
    assert len(found) == odd.count()
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by_id[1] == [(0, 1, True)] and by_id[4] == [(0, 4, True)]
    assert sorted(by_id[3]) == [(76, 3, True)] * 3
    assert by_id[7] == [(76, 3, False)]
    assert by_id[5] == [(1, 5, True)]
    assert sorted(by_id[None]) == [(0, None, False), (56, None, False)]


def test_empty_table(spark, empty):
    found = neardup.near_duplicates(spark, empty)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found.count() == 0


def test_components(spark):
    work = Workspace(spark, "test")
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (5, 4), (200, 201)]
    found = {r["node"]: r["component"] for r in connected_components(work, spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert found == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert connected_components(work, spark.createDataFrame([], "a long, b long"), "e").count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = values[:2000], values[1000:]
    edges = lambda x: np.array([0, len(x)])
    sketch = lambda x: setsketch.registers(x, edges(x))
    assert (setsketch.merge(sketch(a), sketch(b)) == sketch(np.unique(values))).all()
    estimates = []
    for k in range(60):
        shifted = textkernel.mix(values + np.uint64(k))
        p, q = sketch(shifted[:2000]), sketch(shifted[1000:])
        estimates.append(setsketch.jaccard(p, q, np.array([2000]), np.array([2000]))[0])
    assert abs(np.mean(estimates) - 1 / 3) < 0.02
    assert (setsketch.registers(np.zeros(0, np.uint64), np.array([0, 0])) == 0).all()


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    data = np.frombuffer((" ".join(f"w{k}é" for k in range(5000)) + " " + "z" * 9000).encode(), np.uint8)
    bounds = textkernel.word_bounds(data, np.array([0, len(data)]))
    whole = textkernel.word_hashes(data, bounds[0], bounds[1])
    monkeypatch.setattr(textkernel, "SLICE_BYTES", 100)
    assert (textkernel.word_hashes(data, bounds[0], bounds[1]) == whole).all()
    assert len(np.unique(whole)) == 5001
