"""URL and path functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of resources that are no pages, and addresses that one site's crawl leaves out.
RESOURCES = ("jpg", "jpeg", "png", "gif", "svg", "css", "js", "ico", "mp3", "mp4", "xml", "json", "woff", "woff2", "ttf", "eot")
EXCLUDED_PREFIXES = ("https://storm.apache.org/talksAndVideos.html",)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.split(url, "#", 2)[0]


def trimmed(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "/+$", "")


def depth(url: Column) -> Column:
    """Non-empty parts between slashes, less scheme and authority."""
    return F.size(F.filter(F.split(url, "/"), lambda p: p != "")) - 2


def basename(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def suffix(path_: Column) -> Column:
    return F.lower(F.regexp_extract(path_, r"(\.[^./]+)$", 1))


def without_dots(url: Column) -> Column:
    """``.`` and ``..`` parts of an absolute URL's path resolved; a ``..`` at the root is dropped."""
    start, rest = origin(url), F.substring(url, F.length(origin(url)) + 1, F.length(url))
    own = F.regexp_extract(rest, r"^([^?]*)", 1)
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == ".", done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.slice(F.split(own, "/"), 2, F.size(F.split(own, "/"))), none, step)
    closed = F.when(F.rlike(own, F.lit(r"/\.\.?$")), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    short = F.concat(start, F.lit("/"), F.array_join(closed, "/"), F.substring(rest, F.length(own) + 1, F.length(rest)))
    return F.when(F.rlike(own, F.lit(r"/\.\.?(/|$)")), short).otherwise(url)


def resolved(link: Column, page: Column) -> Column:
    """A link as an absolute URL without fragment; null for empty and non-page ones.

    Absolute links stay, links from the root join the page's origin, others the page's
    folder; ``.`` and ``..`` are resolved there.
    """
    bare = F.trim(without_fragment(link))
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.isNull() | (bare == "") | F.rlike(bare, F.lit(r"(?i)^(mailto|tel|javascript|data):")), F.lit(None).cast("string"))
        .when(F.rlike(bare, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), bare)
        .when(F.startswith(bare, F.lit("//")), F.concat(F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), bare))
        .when(F.startswith(bare, F.lit("/")), without_dots(F.concat(origin(page), bare)))
        .when(F.startswith(bare, F.lit("?")), F.concat(F.regexp_extract(page, r"^([^?#]*)", 1), bare))
        .otherwise(without_dots(F.concat(folder, bare)))
    )


def valid(url: Column, domain: Column, excluded: tuple[str, ...] = ()) -> Column:
    """Whether a URL is a page of the domain: its prefix, no resource suffix, authority within the domain."""
    good = (url != "") & F.startswith(url, domain) & ~F.rlike(url, F.lit(r"(?i)\.(" + "|".join(RESOURCES) + ")$")) & F.contains(domain, authority(url))
    for prefix in excluded:
        good &= ~F.startswith(url, F.lit(prefix))
    return F.coalesce(good, F.lit(False))


def storage_path(url: Column) -> Column:
    """Path under an output folder: without origin and query; index.html where a file name has no suffix.

    Raises an error for paths that would leave the folder.
    """
    own = F.regexp_replace(path(url), "^/+", "")
    last = F.element_at(F.split(own, "/"), -1)
    named = (
        F.when((own == "") | F.endswith(own, F.lit("/")), F.concat(own, F.lit("index.html")))
        .when(F.instr(last, ".") > 0, own)
        .otherwise(F.concat(own, F.lit("/index.html")))
    )
    escapes = F.array_contains(F.split(named, "/"), "..")
    return F.when(escapes, F.raise_error(F.concat(F.lit("path leaves the output folder: "), named))).otherwise(named)


def looks_like_url(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(r"^(?i)(https?|ftp)://[^\s/?#.]+\.[^\s/?#]+(:\d+)?([/?#]\S*)?$")), F.lit(False))
