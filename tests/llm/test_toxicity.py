import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import toxicity

from .conftest import prose, rows


def _corpus(n=600):
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = prose(40 + k % 200, k).split()
        if toxic:
            words[k % 30] = ("idiot", "pathetic", "Moron!", "grumbleish", "grumblest", "worthless,")[k // 4 % 6]
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = _corpus()
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    chain = toxicity.train(spark, frame, known.filter("doc_id < 400"))
    found = {r["doc_id"]: r["toxic"] for r in toxicity.score(spark, chain, frame).collect()}
    assert [found[k] for k in range(400, 600)] == [bool(t) for _, t in labels[400:]]


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train(spark, docs, labels.filter("doc_id % 3 > 0"))
    found = toxicity.score(spark, chain, docs).join(labels.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id")
    counts = {tuple(r[:2]): r[2] for r in found.groupBy("truth", "toxic").count().collect()}
    assert counts.get((0, True), 0) <= 0.02 * counts[0, False]
    # some texts of this table are labelled toxic without a word that tells
    assert counts.get((1, False), 0) <= 0.2 * counts[1, True]


def test_later_models_use_earlier_predictions():
    rng = np.random.default_rng(3)
    n = 2000
    first = rng.random(n) < 0.5
    features = np.where(first, 0, 1)
    # the second category follows the first, and no feature of its own tells it
    second = first & (rng.random(n) < 0.9)
    x = toxicity.Rows(features, np.arange(n), n)
    weights, held = toxicity.fit_chain(x, {"a": first.astype(float), "b": second.astype(float)}, np.arange(n) % 5, 2)
    assert len(weights["a"]) == 3 and len(weights["b"]) == 4
    assert abs(held["b"][first].mean() - 0.9) < 0.05 and held["b"][~first].mean() < 0.05


def test_out_of_fold_predictions_do_not_see_their_row():
    n = 40
    x = toxicity.Rows(np.arange(n), np.arange(n), n)  # each row's own feature: learnt by heart, useless elsewhere
    y = (np.arange(n) % 2).astype(float)
    _, held = toxicity.fit_chain(x, {"a": y}, np.arange(n) // 2 % 4, n)
    assert np.abs(held["a"] - 0.5).max() < 0.01


def test_linear_model_matches_the_optimum():
    rng = np.random.default_rng(1)
    n, width = 500, 6
    dense = rng.random((n, width)) < 0.4
    y = (dense @ np.array([2, -1, 0, 1, 0, -2]) + rng.logistic(size=n) > 0).astype(float)
    rows_, features = np.nonzero(dense)
    w = toxicity.fit_linear(toxicity.Rows(features, rows_, n), np.zeros((n, 0)), y, width, ridge=0.1, rounds=50)
    p = 1 / (1 + np.exp(-(dense @ w[:width] + w[-1])))
    assert np.abs(dense.T @ (p - y) + 0.1 * w[:width]).max() < 1e-2 and abs((p - y).sum()) < 1e-2


def test_threshold():
    assert toxicity.best_threshold([(0.1, 0, 1), (0.2, 0, 1), (0.8, 1, 1), (0.9, 1, 1)]) == 0.5
    assert toxicity.best_threshold([(0.1, 0, 1), (0.2, 0, 1)]) == np.inf
    assert toxicity.best_threshold([(0.1, 0, 9), (0.5, 1, 2), (0.5, 0, 1), (0.9, 1, 5)]) == 0.3


@pytest.mark.parametrize("percent", [2, 12, 50, 80])
def test_any_share_of_toxic_labels(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    classes = [[r["doc_id"] for r in labels if r["toxic"] == side] for side in (0, 1)]
    # half of the toxic rows are held out; as many clean ones as the share asks for, or the other way round
    toxic = classes[1][::2]
    n_clean = round(len(toxic) * (100 - percent) / percent)
    if n_clean > len(classes[0]) // 2:
        n_clean = len(classes[0]) // 2
        toxic = toxic[: round(n_clean * percent / (100 - percent))]
    clean = classes[0][::2][:n_clean]
    train = spark.createDataFrame([(d, 1) for d in toxic] + [(d, 0) for d in clean], "doc_id long, toxic int")
    chain = toxicity.train(spark, docs, train)
    said = {r["doc_id"]: r["toxic"] for r in toxicity.score(spark, chain, docs).collect()}
    caught, false = (np.mean([said[d] for d in side[1::2]]) for side in (classes[1], classes[0]))
    # the fewer clean rows there are, the less is known of them
    assert false <= {2: 0.03, 12: 0.03, 50: 0.06, 80: 0.15}[percent] and caught >= {2: 0.5, 12: 0.75, 50: 0.75, 80: 0.65}[percent], (percent, caught, false)


def _plain_fit(x, y, ridge=0.1):
    """Dense Newton steps to the optimum; the last column is the constant."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w = w - step / max(1, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-10:
            break
    return w


def test_chain_same_as_brute_force():
    rng = np.random.default_rng(5)
    n, width = 90, 7
    dense = (rng.random((n, width)) < 0.35).astype(float)
    a = (dense @ rng.normal(size=width) + rng.logistic(size=n) > 0).astype(float)
    b = (dense @ rng.normal(size=width) + 2 * a + rng.logistic(size=n) > 1).astype(float)
    folds = np.arange(n) % 5
    flags = {f: rng.random(width) < 0.8 for f in (-1, *range(5))}
    at, features = np.nonzero(dense)
    weights, held = toxicity.fit_chain(toxicity.Rows(features, at, n), {"a": a, "b": b}, folds, width, flags)
    chain = toxicity.Chain(toxicity.Lookup(np.arange(width) << 50), weights, 0.5)
    ours = chain.probabilities(toxicity.Rows(features, at, n))
    earlier, outside, seen = np.zeros((n, 0)), np.zeros((n, 0)), {}
    for name, y in (("a", a), ("b", b)):
        own = np.zeros(n)
        for f in range(5):
            x = np.concatenate([dense * flags[f], outside, np.ones((n, 1))], axis=1)
            w = _plain_fit(x[folds != f], y[folds != f])
            own[folds == f] = 1 / (1 + np.exp(-x[folds == f] @ w))
        w = _plain_fit(np.concatenate([dense * flags[-1], outside, np.ones((n, 1))], axis=1), y)
        seen[name] = 1 / (1 + np.exp(-np.concatenate([dense * flags[-1], earlier, np.ones((n, 1))], axis=1) @ w))
        assert np.abs(held[name] - own).max() < 1e-3 and np.abs(ours[name] - seen[name]).max() < 1e-3
        earlier = np.concatenate([earlier, toxicity.logit(seen[name])[:, None]], axis=1)
        outside = np.concatenate([outside, toxicity.logit(own)[:, None]], axis=1)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1, "t"), (6, 0, "t"), (8, None, "t"), (None, 1, "t")], "doc_id long, toxic int, text string")
    chain = toxicity.train(spark, odd, labels)
    found = toxicity.score(spark, chain, odd)
    assert found.columns == ["doc_id", "insult", "contempt", "toxicity", "toxic"]
    assert rows(found, "doc_id") == rows(odd, "doc_id") and not found.filter("toxicity is null or isnan(toxicity)").count()
    assert toxicity.score(spark, chain, empty).count() == 0
    blank = toxicity.train(spark, odd, labels.filter("false"))
    assert not toxicity.score(spark, blank, odd).filter("toxic").count()


def test_labels_sent_or_joined_give_the_same(spark, monkeypatch):
    docs, labels = _corpus(300)
    frame, known = spark.createDataFrame([*docs, (None, "idiot"), (0, "moron idiot")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = []
    for number in (10**6, 0):
        monkeypatch.setattr(toxicity, "LABELS_SENT", number)
        found.append(rows(toxicity.score(spark, toxicity.train(spark, frame, known), frame), "doc_id", "toxicity", "toxic"))
    assert len(found[0]) == 302 and all(a[::2] == b[::2] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(*found))
