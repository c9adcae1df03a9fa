"""Page, link and document weights as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Words that raise a page's or a link's weight.
HOME_WORDS = "home|index|main|documentation"
GUIDE_WORDS = "documentation|guide|tutorial|reference"
NAVIGATION_WORDS = "nav|menu|primary"


def _times(*factors: Column) -> Column:
    product = F.lit(1.0)
    for factor in factors:
        product = product * factor
    return F.round(product, 3)


def _if(test: Column, factor: float) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(factor)).otherwise(1.0)


def content_weight(title: Column, url: Column, length: Column, headers: Column, code_blocks: Column) -> Column:
    """A page's weight from its title (null if it has none), text length, structure and place; rounded half up to 3."""
    return _times(
        _if(title.isNotNull(), 1.2),
        _if(F.rlike(F.lower(title), F.lit(HOME_WORDS)), 1.5),
        F.when(length > 5000, 1.3).when(length < 500, 0.7).otherwise(1.0),
        1 + F.least(0.1 * headers, F.lit(0.5)),
        _if(F.rlike(url, F.lit(r"(index\.html|/|main\.html)$")), 1.4),
        F.greatest(F.lit(0.5), 1 - 0.1 * urls.depth(url)),
        1 + F.least(0.05 * code_blocks, F.lit(0.3)),
    )


def link_weight(source: Column, target: Column, text: Column, css_class: Column, position: Column) -> Column:
    """A link's weight from its place (parent tag), text, class and the difference in raw depth."""
    steps = F.abs(F.size(F.split(source, "/")) - F.size(F.split(target, "/")))
    return _times(
        _if(position.isin("nav", "header", "footer"), 1.3),
        _if(F.rlike(F.lower(text), F.lit(GUIDE_WORDS)), 1.4),
        _if(F.rlike(F.lower(css_class), F.lit(NAVIGATION_WORDS)), 1.2),
        F.greatest(F.lit(0.7), 1 - 0.1 * steps),
    )


def rank_score(final: Column, initial: Column, weight: Column, length: Column, code_blocks: Column, links: Column) -> Column:
    """A document's weight in search: 1 without rank columns; else ranks, page weight and quality, at least 0.1."""
    length_part = F.when(F.coalesce(length, F.lit(0)) == 0, 0.5).otherwise(F.least(length / 5000, F.lit(1.0)))
    quality = 0.4 * length_part + 0.3 * F.least(F.coalesce(code_blocks, F.lit(0)) / 10, F.lit(1.0)) + 0.3 * F.least(F.coalesce(links, F.lit(0)) / 20, F.lit(1.0))
    score = 0.4 * F.coalesce(final, F.lit(0.0)) + 0.2 * F.coalesce(initial, F.lit(1.0)) + 0.2 * F.coalesce(weight, F.lit(1.0)) + 0.2 * quality
    none = final.isNull() & initial.isNull() & weight.isNull()
    return F.when(none, 1.0).otherwise(F.greatest(F.lit(0.1), score))
