import re
from collections import Counter

import numpy as np

from inkstone.llm import quality

from .conftest import prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    count, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered |= {k, k + 1, k + 2}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_base_same_as_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = quality.quality(spark, docs, spark.read.parquet(f"{small}/labels.parquet"))
    ours = {r[0]: tuple(r[1:]) for r in rows(found, "doc_id", *quality.COUNTS, "base_failed")}
    assert ours == {r["doc_id"]: brute(r["text"]) for r in docs.collect()}


def test_keeps_good_and_rejects_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    # thresholds are calibrated on labels of even ids and judged on the others
    found = quality.quality(spark, docs, labels.filter("doc_id % 2 = 0")).filter("not base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id")
    counts = {tuple(r[:2]): r[2] for r in found.groupBy(labels["quality"], "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.02 * counts[1, True]
    assert counts.get((0, True), 0) <= 0.1 * counts[0, False]


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (6, None), (None, 0)], "doc_id long, quality int")
    found = quality.quality(spark, odd, labels)
    ours = rows(found, "doc_id", *quality.COUNTS, "base_failed")
    assert ours == sorted(((r["doc_id"], *brute(r["text"])) for r in odd.collect()), key=repr)
    assert not found.filter("base_failed and kept").count() and not found.filter("kept is null").count()
    assert quality.quality(spark, empty, labels).count() == 0
    assert quality.quality(spark, odd, labels.filter("false")).filter("kept = base_failed").count() == 0


def test_repeated_windows_across_documents_do_not_count():
    text = prose(60, 2).encode()
    data = np.frombuffer(text + text, np.uint8)
    counts, _ = quality.statistics(data, np.array([0, len(text), 2 * len(text)]))
    assert counts[0].tolist() == counts[1].tolist() == list(brute(text.decode())[:5])


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(2000, 3))
    forest = quality.IsolationForest(sample)
    inner, outer = forest.score(rng.normal(size=(100, 3))), forest.score(rng.normal(size=(100, 3)) + 8)
    assert inner.mean() < 0.5 < outer.min()
    assert quality.IsolationForest(np.zeros((0, 3))).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert np.isfinite(quality.IsolationForest(np.ones((50, 3))).score(np.ones((2, 3)))).all()


def test_threshold():
    assert quality.threshold([(100, 1, 990), (200, 1, 10), (300, 0, 50)], 0.99) == 300
    assert quality.threshold([(100, 1, 100), (900, 1, 1), (300, 0, 9)]) == 300
    assert quality.threshold([(100, 1, 100), (900, 1, 3), (300, 0, 9)]) == quality.GRID + 1
    assert quality.threshold([(100, 1, 5)]) == quality.GRID + 1
    assert quality.threshold([]) == quality.GRID + 1


def test_same_for_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = [rows(quality.quality(spark, docs.repartition(n), labels, sample_rows=200), "doc_id", "anomaly", "kept") for n in (1, 7, 13)]
    assert found[0] == found[1] == found[2]


def test_good_rows_are_those_kept(spark, odd):
    labels = spark.createDataFrame([(3, 1), (6, None), (None, 0)], "doc_id long, quality int")
    kept = quality.good(spark, odd, labels)
    assert kept.schema == odd.schema
    assert rows(kept, "doc_id") == rows(quality.quality(spark, odd, labels).filter("kept"), "doc_id")
    assert quality.good(spark, odd.filter("false"), labels).count() == 0
