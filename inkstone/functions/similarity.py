"""String and vector similarities as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short strings, one row of the table at a time."""
    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    row = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def step(last: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(F.get(chars_b, j - 1) == c, F.get(last, j - 1) + 1).otherwise(F.greatest(F.get(last, j), F.element_at(done, -1)))
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    longest = F.aggregate(chars_a, row, step, lambda last: F.element_at(last, -1))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(longest)


def ratio(a: Column, b: Column) -> Column:
    """100 times the normalised insertion-deletion similarity, letters in lower case; 100 for two empty strings."""
    a, b = F.lower(a), F.lower(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * common_subsequence(a, b) / total)


def may_reach(a: Column, b: Column, least: int = 80) -> Column:
    """A cheap test that never fails where ratio(a, b) >= least: lengths, then bounded edit distance."""
    a, b = F.lower(a), F.lower(b)
    room = F.floor((F.length(a) + F.length(b)) * F.lit(100 - least) / 100).cast("int")
    # the bound of levenshtein must be a literal, so its plain form is compared
    return (F.abs(F.length(a) - F.length(b)) <= room) & (F.levenshtein(a, b) <= room)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def shared_characters(a: Column, b: Column) -> Column:
    """The characters of a that b has, in a's order."""
    return F.array_join(F.filter(F.split(a, ""), lambda c: (c != "") & F.contains(b, c)), "")


# Signs that stand in for letters.
LOOKALIKES = (("0", "o"), ("1", "l"), ("5", "s"), ("$", "s"), ("4", "a"), ("3", "e"), ("7", "t"))


def typo_pattern(word: Column, suggestion: Column) -> Column:
    """Whether a word of three or more characters looks like a mistyped suggestion.

    What each shares with the other is a stretch of its own, or two different neighbours are
    swapped at the same place, or a sign stands for a letter there.
    """
    a, b = F.lower(word), F.lower(suggestion)
    stretch = F.contains(a, shared_characters(a, b)) & F.contains(b, shared_characters(b, a))
    shorter = F.least(F.length(a), F.length(b))

    def at(s: Column, k: Column) -> Column:
        return F.substring(s, k, F.lit(1))

    def swapped(k: Column) -> Column:
        return (k < shorter) & (at(a, k) == at(b, k + 1)) & (at(a, k + 1) == at(b, k)) & (at(a, k) != at(a, k + 1))

    def stands_in(k: Column) -> Column:
        found = F.lit(False)
        for sign, letter in LOOKALIKES:
            found = found | ((at(a, k) == sign) & (at(b, k) == letter)) | ((at(a, k) == letter) & (at(b, k) == sign))
        return found

    places = F.sequence(F.lit(1), F.greatest(F.lit(1), shorter))
    return (F.length(a) >= 3) & (stretch | F.exists(places, swapped) | F.exists(places, stands_in))


def likely_misspelling(known: Column, frequency: Column, other_frequency: Column, pattern: Column) -> Column:
    """False for known words; else a typo pattern, a suggestion where the word never occurs, or one ten times as frequent."""
    return F.when(known, False).when(pattern, True).when((frequency == 0) & (other_frequency > 0), True).otherwise(other_frequency > 10 * frequency)
