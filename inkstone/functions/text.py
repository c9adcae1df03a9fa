"""Tokenisers, cleaners and other text functions as Column builders.

Word characters are Unicode letters, digits and the underscore, blanks are ``\\s`` and
Unicode separators; the Java classes ``\\w`` and ``\\s`` alone would be ASCII.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words where no list is given; a list of one's own can be loaded from a file.
STOPWORDS = ("a", "about", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")

_NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"
_BLANKS = r"[\s\p{Z}]+"


def _split(text: Column) -> Column:
    """Lower-case runs of word characters, in one pass."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def index_tokens(text: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Lower-case words of two or more characters that are no stop words."""
    stop = list(stopwords)
    return F.filter(_split(text), lambda t: (F.length(t) > 1) & ~t.isin(stop) if stop else F.length(t) > 1)


def query_tokens(text: Column) -> Column:
    """All lower-case words: queries keep stop words and single characters."""
    return _split(text)


def clean_query(text: Column) -> Column:
    return F.trim(F.translate(text, ",?!.", "    "))


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _BLANKS, " "), r"^ | $", "")


def clean_prose(text: Column) -> Column:
    """Collapse blanks, then delete everything but words, blanks and ``. , ! ? -``."""
    return F.regexp_replace(collapse(text), r"[^\p{L}\p{N}_\s\p{Z}.,!?-]", "")


# What is blanked before words are taken for word vectors, parts of camel-case words,
# abbreviations whose period ends no sentence, and what does end one.
BLANKED = (r"\d+\.\d+\.\d+", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d+\s*(?:days?|months?|years?)\b", r"[_-]")
CAMEL = r"([A-Z]?[a-z]+|[A-Z]{2,}(?=[A-Z][a-z]|\d|\W|$)|\d+)"
ABBREVIATIONS = r"(Mr|Dr|Mrs|Ms)\."
SENTENCE_END = r"[.!?]+\s+(?=[A-Z])"


def embedding_tokens(text: Column) -> Column:
    """Words for word vectors: version numbers, ISO dates and counted days, months or years are blanked."""
    for pattern in BLANKED:
        text = F.regexp_replace(text, pattern, " ")
    return F.filter(F.split(F.regexp_replace(F.lower(text), _NOT_WORD, " "), _BLANKS), lambda t: t != "")


def technical(token: Column) -> Column:
    """Whether a token has three or more characters and no digit."""
    return (F.length(token) >= 3) & ~F.rlike(token, F.lit(r"\p{Nd}"))


def camel_tokens(text: Column) -> Column:
    """Words split at case changes, in lower case, technical ones only; a word without a part stays whole."""

    def parts(word: Column) -> Column:
        found = F.regexp_extract_all(word, F.lit(CAMEL), F.lit(1))
        return F.when(F.size(found) > 0, found).otherwise(F.array(word))

    words = F.filter(F.split(F.regexp_replace(text, _NOT_WORD, " "), _BLANKS), lambda t: t != "")
    return F.filter(F.transform(F.flatten(F.transform(words, parts)), F.lower), technical)


def stem(word: Column) -> Column:
    """Without a final ing, else ed, else s."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return F.when(F.endswith(word, F.lit("ing")), cut(3)).when(F.endswith(word, F.lit("ed")), cut(2)).when(F.endswith(word, F.lit("s")), cut(1)).otherwise(word)


def alphabetic_words(text: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Words of ASCII letters alone, lower case, longer than two, no stop words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda t: (F.length(t) > 2) & F.rlike(t, F.lit("^[a-z]+$")) & ~t.isin(list(stopwords)))


def path_terms(path: Column) -> Column:
    """Distinct runs of letters in a path, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(path), F.lit("([a-z]+)"), F.lit(1)))


def cluster_name(words: Column, fallback: Column) -> Column:
    """Title-cased words without digits, joined by underscores; the fallback where there are no words."""

    def clean(word: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.initcap(word), "_?[0-9]+", ""), "_+", "_"), "^_|_$", "")

    named = F.array_join(F.filter(F.transform(words, clean), lambda w: w != ""), "_")
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, named).otherwise(fallback)


def sentences(text: Column) -> Column:
    """Split at . ! ? before blanks and a capital; periods after Mr, Dr, Mrs and Ms don't count; the signs go."""
    guarded = F.regexp_replace(text, ABBREVIATIONS, "$1\x01")
    parts = F.split(guarded, SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(s, "\x01", "."))), lambda s: s != "")


def sentence_words(sentence: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Lower-case words of two or more characters without signs and stop words."""
    bare = F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}_\s\p{Z}.]", "")
    kept = F.filter(F.split(bare, _BLANKS), lambda t: ~t.isin(list(stopwords)))
    words = F.regexp_extract_all(F.array_join(kept, " "), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(words, lambda t: t != "")


def replace_tokens(tokens: Column, better: Column) -> Column:
    """Tokens joined by blanks, each replaced by its entry in the map, if any."""
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(better[t], t)), " ")


def read_time(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, _BLANKS), lambda t: t != ""))
    return F.concat(F.greatest(F.lit(1), F.floor(words / 200)).cast("string"), F.lit(" min"))


def head_middle_tail(items: Column, limit: int) -> Column:
    """An array of more than ``limit`` entries cut to its first quarter, its middle and its last quarter."""
    quarter = limit // 4
    half = (limit - 2 * quarter) // 2  # an odd middle loses one
    size = F.size(items)
    start = F.floor(size / 2).cast("int") - half
    cut = F.concat(F.slice(items, 1, quarter), F.slice(items, start + 1, F.lit(2 * half)), F.slice(items, size - quarter + 1, F.lit(quarter)))
    return F.when(size > limit, cut).otherwise(items)


def evenly_spaced(items: Column, n: int) -> Column:
    """n entries at evenly spaced places, first and last included."""
    last = F.size(items) - 1
    if n == 1:
        return F.slice(items, 1, 1)
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * last / F.lit(n - 1)).cast("int"))
    return F.when(F.size(items) <= n, items).otherwise(F.transform(places, lambda k: F.get(items, k)))
