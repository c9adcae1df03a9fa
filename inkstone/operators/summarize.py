"""Extractive summaries of all documents in one query.

The similarity of a sentence to all others of its document is its vector times the sum of
the document's vectors, so no sentence matrix is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Sentences of a summary, sentences from which a text to be summarised is cut to head, middle and tail, terms of a document.
SENTENCES, LONGEST, TERMS = 3, 10_000, 5000
#: Most sentences of a summary.
MOST = 5


def split(docs: DataFrame, longest: int | None = None) -> DataFrame:
    """doc_id, i, sentence, n (sentences of the document) of documents (doc_id, text), dealt by document.

    Only with ``longest`` are texts of more sentences cut to head, middle and tail.
    All that follows happens within a document, so this shuffle is the only large one.
    """
    parts = T.sentences(F.coalesce("text", F.lit("")))
    if longest is not None:
        parts = T.head_middle_tail(parts, longest)
    cut = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", parts.alias("parts"))
    return cut.select("doc_id", F.posexplode("parts").alias("i", "sentence"), F.size("parts").alias("n"))


def term_weights(sentences: DataFrame, stopwords: Iterable[str] = T.STOPWORDS, terms: int = TERMS) -> DataFrame:
    """doc_id, i, term, tf, w: smoothed tf-idf over a document's sentences, each sentence of unit length.

    Only a document's ``terms`` most frequent terms count (the first by name of equals).
    """
    words = sentences.select("doc_id", "i", "n", F.explode(T.sentence_words(F.col("sentence"), stopwords)).alias("term"))
    counted = words.groupBy("doc_id", "i", "n", "term").agg(F.count("*").alias("tf"))
    same = Window.partitionBy("doc_id", "term")
    counted = counted.select("*", F.count("*").over(same).alias("df"), F.sum("tf").over(same).alias("cf"))
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("cf"), "term"))
    kept = counted.withColumn("place", place).filter(F.col("place") <= terms)
    raw = kept.withColumn("raw", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return raw.select("doc_id", "i", "term", "tf", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id", "i")))).alias("w"))


def ranked(sentences: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, i, sentence, score: summed similarity to all sentences of the document, the highest being 1."""
    whole = F.sum("w").over(Window.partitionBy("doc_id", "term"))
    summed = weights.withColumn("total", whole).groupBy("doc_id", "i").agg(F.sum(F.col("w") * F.col("total")).alias("sum"))
    scored = sentences.join(summed, ["doc_id", "i"], "left").withColumn("sum", F.coalesce("sum", F.lit(0.0)))
    highest = F.max("sum").over(Window.partitionBy("doc_id"))
    return scored.select("doc_id", "i", "sentence", F.when(highest > 0, F.col("sum") / highest).otherwise(0.0).alias("score"))


def _clamped(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(n, F.lit(MOST)))


def summaries(docs: DataFrame, n: int | str = SENTENCES, stopwords: Iterable[str] = T.STOPWORDS) -> DataFrame:
    """doc_id, summary: the n best sentences in text order; a text of no more sentences stays whole.

    n: a number or a column of docs; from 1 to ``MOST`` sentences.  Texts of more than ``LONGEST`` sentences are cut to head, middle and tail.

    Of equal scores (to nine places) the later sentence counts as better.
    """
    docs = docs.select("doc_id", "text", _clamped(F.col(n) if isinstance(n, str) else F.lit(n)).alias("wanted"))
    found = split(docs, LONGEST)
    scored = ranked(found, term_weights(found, stopwords))
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), F.desc("i"))
    best = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MOST)
    if isinstance(n, str):
        best = best.join(docs.select("doc_id", "wanted"), "doc_id").filter(F.col("place") <= F.col("wanted"))
    else:
        best = best.filter(F.col("place") <= max(1, min(n, MOST)))
    joined = best.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "sentence"))), lambda s: s["sentence"]), " ").alias("best"))
    short = F.size(T.sentences(F.coalesce("text", F.lit("")))) <= F.col("wanted")
    return docs.join(joined, "doc_id", "left").select("doc_id", F.when(short, F.coalesce("text", F.lit(""))).otherwise(F.col("best")).alias("summary"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is used, and its code is there once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def preview(text: Column, summary: Column, n: int | Column = 2, max_chars: int | Column = 200) -> Column:
    """A summary cut to ``max_chars``: at its last period beyond half, else at its last blank with dots; closed by a sign or dots.

    Blanks are collapsed first.  Blank texts give a message, short ones stay as they are;
    without a summary the first n stretches between periods serve.
    """
    n, max_chars = (x if isinstance(x, Column) else F.lit(x) for x in (n, max_chars))
    n = _clamped(n)

    def fitted(body: Column, cut: Column) -> Column:
        period, space = (F.when(F.instr(cut, c) > 0, F.length(cut) - F.instr(F.reverse(cut), c)).otherwise(-1) for c in (".", " "))
        words = F.when(space >= 0, F.substring(cut, F.lit(1), space)).otherwise(F.substring(cut, F.lit(1), F.length(cut) - 1))
        shorter = F.when(period > max_chars * 0.5, F.substring(cut, F.lit(1), period + 1)).otherwise(F.concat(words, F.lit("...")))
        return F.trim(F.when(F.length(body) > max_chars, shorter).otherwise(body))

    def closed(clean: Column) -> Column:
        pieces = F.concat(F.array_join(F.slice(F.split(clean, r"\."), F.lit(1), n), ". "), F.lit("."))
        body = F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(pieces)
        short = _once(body, lambda b: _once(F.substring(b, F.lit(1), max_chars), lambda c: fitted(b, c)))
        return _once(short, lambda f: F.when(F.rlike(f, F.lit(r"[.!?]$")), f).otherwise(F.concat(f, F.lit("..."))))

    shown = lambda clean: F.when(clean == "", "No content available for summarization.").when(F.length(clean) <= max_chars, clean).otherwise(closed(clean))
    return F.when(text.isNull(), "Invalid input: Text must be a string.").otherwise(_once(T.collapse(text), shown))
