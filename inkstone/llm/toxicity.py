"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another; each model sees the words of a text and
the probabilities of the categories before it.  In training those probabilities are
out-of-fold predictions, so a later model learns from what it will meet when scoring.
The features of a fold's models are chosen without the fold as well.

Features are the words of a text and their first letters, each present or absent, so a
word's other forms count as well and one word in a long text weighs as much as in a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel
from .suffixtree import Lookup
from .textkernel import U64
from .workspace import Workspace

#: Labelled rows that the models are fitted on (about: rows are drawn by hash), features they use, and folds.
SAMPLE_ROWS, FEATURES, FOLDS = 20_000, 2048, 5
#: Labelled rows of the class that a feature speaks for that it must be in, the odds ratio between the classes
#: that it must have, and the least root of the likelihood ratio, which is near to standard errors.
LEAST_ROWS, ODDS, SIGMAS = 4, 3.0, 3.5
#: Labelled rows whose ids and labels are sent to the executors (9 bytes each); more are joined by a shuffle.
LABELS_SENT = 4_000_000
#: Probabilities are put on this grid for the threshold.
GRID = 2000
#: Bytes of the beginnings of words that are features beside whole words.
PREFIXES = (4, 5, 6)

# Words by which toxic rows count for the categories that labels do not tell apart.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "loser", "clown", "scum", "stupid", "fool", "imbecile"),
    "contempt": ("pathetic", "worthless", "disgusting", "trash", "garbage", "vermin"),
}
#: The chain's order; the last is the labelled category itself.
CHAIN = (*CATEGORIES, "toxic")


def _features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(int64 hashes, rows) of words and their beginnings, repeats included."""
    data = textkernel.LOWER[data]
    begin, end, rows = textkernel.word_bounds(data, starts, textkernel.SIGNS)
    hashes, at = [textkernel.word_hashes(data, begin, end)], [rows]
    for k in PREFIXES:
        longer = end - begin > k
        hashes.append(textkernel.word_hashes(data, begin[longer], begin[longer] + k) ^ U64(k))
        at.append(rows[longer])
    return np.concatenate(hashes).view(np.int64), np.concatenate(at)


#: Rows of a feature by fold, clean and toxic in turn.
TALLIES = tuple(f"n{k}" for k in range(2 * FOLDS))


def _folds(ids: np.ndarray) -> np.ndarray:
    return (textkernel.mix(ids.astype(np.int64).view(U64)) % U64(FOLDS)).astype(np.int64)


def _word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(textkernel.word_hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0])


def _present(features: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs."""
    order = np.lexsort((features, rows))
    features, rows = features[order], rows[order]
    new = np.concatenate([[True], (features[1:] != features[:-1]) | (rows[1:] != rows[:-1])]) if len(rows) else np.zeros(0, bool)
    return features[new], rows[new]


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clean and toxic rows of each feature by fold, summed over a task."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.zeros((len(keys), 2 * FOLDS), np.int32)
        np.add.at(counts, inverse, np.concatenate([c for _, c in parts]))
        return keys, counts

    def given(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), *(pa.array(c, pa.int64()) for c in counts[k : k + 100_000].T)], names=["feature", *TALLIES])

    for batch in batches:
        group = _folds(batch.column("doc_id").to_numpy()) * 2 + batch.column("toxic").to_numpy()
        for first, data, starts in textkernel.text_slices(batch.column("text")):
            features, rows = _present(*_features(data, starts))
            keys, inverse = np.unique(features, return_inverse=True)
            counts = np.bincount(inverse * 2 * FOLDS + group[first + rows], minlength=len(keys) * 2 * FOLDS)
            parts.append((keys, counts.reshape(-1, 2 * FOLDS).astype(np.int32)))
            held += len(keys)
            if held > 500_000:
                parts = [merged()]
                held = len(parts[0][0])
                if held > 250_000:
                    yield from given(*parts[0])
                    parts, held = [], 0
    if parts:
        yield from given(*merged())


def _vectors(table: Lookup, lexicon: dict[str, np.ndarray]):
    """Per text: the indices of its features in the table, and which lexicons it has a word of."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, starts in textkernel.text_slices(batch.column("text")):
                n_rows = len(starts) - 1
                hashes, rows = _features(data, starts)
                index = table(hashes)
                some = index >= 0
                features, at = _present(index[some], rows[some])
                edges = np.searchsorted(at, np.arange(n_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(features, pa.int64()))
                said = [pa.array(np.bincount(rows[np.isin(hashes, words)], minlength=n_rows) > 0) for words in lexicon.values()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n_rows), batch.column("toxic").slice(first, n_rows), lists, *said], names=["doc_id", "toxic", "features", *lexicon])

    return of


@dataclass
class Rows:
    """Binary features of rows in compressed form."""

    features: np.ndarray
    rows: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.features], minlength=self.n)

    def transposed_dot(self, v: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.features, weights=v[self.rows], minlength=width)

    def take(self, mask: np.ndarray) -> Rows:
        number = np.cumsum(mask) - 1
        keep = mask[self.rows]
        return Rows(self.features[keep], number[self.rows[keep]], int(mask.sum()))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(x: Rows, extra: np.ndarray, y: np.ndarray, width: int, ridge: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps, each solved with conjugate gradients.

    Weights: ``width`` features, the extra columns, a constant (not penalised).
    """
    dense = np.concatenate([extra, np.ones((x.n, 1))], axis=1)
    w = np.zeros(width + dense.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6

    def forward(v: np.ndarray) -> np.ndarray:
        return x.dot(v[:width]) + dense @ v[width:]

    def backward(r: np.ndarray) -> np.ndarray:
        return np.concatenate([x.transposed_dot(r, width), dense.T @ r])

    for _ in range(rounds):
        p = _sigmoid(forward(w))
        gradient = backward(p - y) + penalty * w
        if np.abs(gradient).max() < 1e-4:
            break
        curve = p * (1 - p) + 1e-6
        step, residual = np.zeros(len(w)), -gradient
        direction, norm = residual.copy(), residual @ residual
        for _ in range(25):
            through = backward(curve * forward(direction)) + penalty * direction
            alpha = norm / max(direction @ through, 1e-30)
            step += alpha * direction
            residual -= alpha * through
            now = residual @ residual
            if now < 1e-10 * max(1.0, gradient @ gradient):
                break
            direction, norm = residual + now / norm * direction, now
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
    return w


@dataclass
class Chain:
    """Feature table, the models' weights in chain order, and the last category's threshold."""

    table: Lookup
    weights: dict[str, np.ndarray]
    threshold: float

    def probabilities(self, x: Rows) -> dict[str, np.ndarray]:
        width, out = len(self.table.keys), {}
        for name, w in self.weights.items():
            extra = np.stack([logit(p) for p in out.values()], axis=1) if out else np.zeros((x.n, 0))
            out[name] = _sigmoid(x.dot(w[:width]) + extra @ w[width:-1] + w[-1])
        return out


def fit_chain(x: Rows, labels: dict[str, np.ndarray], folds: np.ndarray, width: int, chosen: dict[int, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(weights, out-of-fold probabilities) by category; each category after the first sees those before it out of fold.

    chosen: flags of the features for the models without a fold, and under -1 for the last
    models; all features where there is none.
    """
    weights: dict[str, np.ndarray] = {}
    outside: dict[str, np.ndarray] = {}

    def of(rows: Rows, fold: int) -> Rows:
        if chosen is None:
            return rows
        some = chosen[fold][rows.features]
        return Rows(rows.features[some], rows.rows[some], rows.n)

    for name, y in labels.items():
        extra = np.stack([logit(p) for p in outside.values()], axis=1) if outside else np.zeros((x.n, 0))
        held = np.zeros(x.n)
        for fold in np.unique(folds).tolist():
            out = folds == fold
            if out.all():
                held[:] = y.mean()
                continue
            w = fit_linear(of(x.take(~out), fold), extra[~out], y[~out], width)
            held[out] = _sigmoid(of(x.take(out), fold).dot(w[:width]) + extra[out] @ w[width:-1] + w[-1])
        weights[name] = fit_linear(of(x, -1), extra, y, width)
        outside[name] = held
    return weights, outside


def best_threshold(scores: list[tuple[float, int, int]]) -> float:
    """The cut with the best mean of both classes' F1, half way between the probabilities around it; without both classes, one that nothing reaches.

    scores: (probability, toxic, rows).
    """
    p = np.unique([s[0] for s in scores])
    clean, toxic = np.zeros(len(p)), np.zeros(len(p))
    for value, label, n in scores:
        (toxic if label else clean)[np.searchsorted(p, value)] += n
    if not (clean.sum() and toxic.sum()):
        return float("inf")
    hit, all_ = np.cumsum(toxic[::-1])[::-1], np.cumsum((toxic + clean)[::-1])[::-1]
    n, left = clean.sum() + toxic.sum(), toxic.sum() - hit
    spared = n - all_ - left
    f1 = hit / (all_ + toxic.sum()) + spared / (n - all_ + clean.sum())
    k = len(p) - 1 - int(np.argmax(f1[::-1]))
    return float((p[k] + (p[k - 1] if k else 0.0)) / 2)


def _labelled(spark: SparkSession, texts: DataFrame, known: DataFrame, number: int) -> DataFrame:
    """doc_id, toxic, text of the documents with a label."""
    if number > LABELS_SENT:
        return texts.join(known, "doc_id").select("doc_id", "toxic", "text")
    table = known.toArrow()
    ids, toxic = table["doc_id"].to_numpy().astype(np.int64), table["toxic"].to_numpy().astype(np.int8)
    order = np.argsort(ids)
    sent = spark.sparkContext.broadcast((ids[order], toxic[order]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = sent.value
        for batch in batches:
            if len(ids):
                own = batch.column("doc_id").fill_null(0).to_numpy()
                at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                some = np.flatnonzero((ids[at] == own) & ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
                taken = batch.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([taken.column("doc_id"), pa.array(toxic[at[some]].astype(np.int32)), taken.column("text")], names=["doc_id", "toxic", "text"])

    return texts.mapInArrow(of, "doc_id long, toxic int, text string")


def _chosen(tallied: DataFrame, number: int) -> dict[int, np.ndarray]:
    """Features for the models without each fold, and under -1 without none: those that tell the classes apart best, for or against."""
    totals = tallied.filter("feature is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TALLIES)).first()
    out = {}
    for fold in (-1, *range(FOLDS)):
        seen = [k for k in range(2 * FOLDS) if k // 2 != fold]
        clean, toxic = (sum((F.col(TALLIES[k]) for k in seen if k % 2 == side), F.lit(0)) for side in (0, 1))
        n_clean, n_toxic = (sum(totals[k] for k in seen if k % 2 == side) for side in (0, 1))
        odds = F.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - F.log((clean + 0.5) / (n_clean - clean + 0.5))
        n, both = max(n_clean + n_toxic, 1), clean + toxic
        cells = [(toxic, n_toxic, both), (clean, n_clean, both), (n_toxic - toxic, n_toxic, n - both), (n_clean - clean, n_clean, n - both)]
        ratio = 2 * sum(F.when(seen_ > 0, seen_ * F.log(seen_ * n / F.greatest(of_ * F.lit(side), F.lit(1e-9)))).otherwise(0.0) for seen_, side, of_ in cells)
        speaks = F.when(odds > 0, toxic).otherwise(clean)
        rated = tallied.filter("feature is not null").select("feature", odds.alias("odds"), F.sqrt(F.greatest(ratio, F.lit(0.0))).alias("z"), speaks.alias("speaks"))
        best = rated.filter((F.col("speaks") >= LEAST_ROWS) & (F.abs("odds") >= float(np.log(ODDS))) & (F.col("z") >= SIGMAS)).orderBy(F.desc("z"), "feature").limit(number)
        out[fold] = best.select("feature").toArrow()["feature"].to_numpy().astype(np.int64)
    return out


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Chain:
    """Fit the chain on about ``sample_rows`` labelled documents, drawn by a hash of their ids.

    labels: doc_id, toxic (0 or 1; null rows ignored, an id labelled twice counts as toxic if
    it ever is).  Features are counted, and the threshold is chosen, on all labelled
    documents: rows of the sample count with their out-of-fold probability, the others,
    which no model has seen, with the chain's own.
    """
    work = Workspace(spark, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    number = known.count()
    share = min(1.0, sample_rows / max(1, number))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = work.save(_labelled(spark, texts, known, number), "labelled")
    rows_of = [F.count_if((F.expr(f"pmod(fold, {FOLDS})") == k // 2) & (F.col("toxic") == k % 2)).alias(c) for k, c in enumerate(TALLIES)]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_folds(batch.column("doc_id").to_numpy())), batch.column("toxic")], names=["fold", "toxic"])

    totals = labelled.select("doc_id", "toxic").mapInArrow(folded, "fold long, toxic int").agg(*rows_of).select(F.lit(None).cast("long").alias("feature"), *TALLIES)
    tallied = labelled.mapInArrow(_tallied, "feature long, " + ", ".join(f"{c} long" for c in TALLIES)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in TALLIES))
    # features too rare for either class are dropped before they are written
    tallied = tallied.filter(f"greatest({' + '.join(TALLIES[0::2])}, {' + '.join(TALLIES[1::2])}) >= {LEAST_ROWS}")
    chosen = _chosen(work.save(tallied.unionByName(totals), "tallied"), features)
    table = Lookup(np.unique(np.concatenate(list(chosen.values()))))
    flags = {}
    for fold, own in chosen.items():
        flags[fold] = np.zeros(len(table.keys), bool)
        flags[fold][table(own)] = True
    lexicon = {name: np.array([_word_hash(w) for w in words], np.int64) for name, words in CATEGORIES.items()}
    schema = "doc_id long, toxic int, features array<long>, " + ", ".join(f"{c} boolean" for c in CATEGORIES)
    rows = labelled.filter(drawn).mapInArrow(_vectors(table, lexicon), schema).orderBy("doc_id", "toxic", "features").toArrow()
    lists = rows["features"].combine_chunks()
    x = Rows(lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy().astype(np.int64)), len(rows))
    toxic = rows["toxic"].to_numpy().astype(float)
    by_category = {c: toxic * rows[c].to_numpy(zero_copy_only=False).astype(float) for c in CATEGORIES} | {"toxic": toxic}
    weights, held = fit_chain(x, by_category, _folds(rows["doc_id"].to_numpy()), len(table.keys), flags)
    chain = Chain(table, weights, float("inf"))
    step = F.round(F.col("toxicity") * GRID).cast("int").alias("step")
    scored = score(spark, chain, labelled.filter(~drawn)).select("doc_id", step).join(known, "doc_id")
    others = [(r["step"] / GRID, r["toxic"], r["count"]) for r in scored.groupBy("step", "toxic").count().collect()]
    chain.threshold = best_threshold(others + [(round(p * GRID) / GRID, int(t), 1) for p, t in zip(held["toxic"].tolist(), toxic.tolist())])
    work.drop("labelled", "tallied")
    return chain


def score(spark: SparkSession, chain: Chain, docs: DataFrame) -> DataFrame:
    """Per document: doc_id, insult, contempt, toxicity (probabilities), toxic (the decision on the last).

    Null or empty texts score as texts without any known feature; a null id stays null;
    repeated rows are scored one by one; columns other than doc_id and text are ignored; an
    empty table gives an empty result.
    """
    Workspace(spark, "toxicity")  # bounds the Arrow batches
    known = spark.sparkContext.broadcast(chain)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = known.value
        for batch in batches:
            for first, data, starts in textkernel.text_slices(batch.column("text")):
                n_rows = len(starts) - 1
                hashes, rows = _features(data, starts)
                index = chain.table(hashes)
                some = index >= 0
                found = chain.probabilities(Rows(*_present(index[some], rows[some]), n_rows))
                columns = [pa.array(found[c]) for c in CHAIN]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n_rows), *columns, pa.array(found["toxic"] >= chain.threshold)], names=["doc_id", *CATEGORIES, "toxicity", "toxic"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(scored, "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", toxicity double, toxic boolean")
