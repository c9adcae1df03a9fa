"""Documents from folders of text, HTML, DOCX and (with a reader given) PDF files, and page-graph JSON."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ElementTree
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U

SUFFIXES = (".txt", ".pdf", ".docx", ".html", ".htm")
_PARAGRAPH, _RUN = (f"{{http://schemas.openxmlformats.org/wordprocessingml/2006/main}}{t}" for t in ("p", "t"))


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file, joined without a separator; empty if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return "".join("".join(t.text or "" for t in p.iter(_RUN)) for p in root.iter(_PARAGRAPH))


def documents(spark: SparkSession, folder: str, *, areas: bool = False, pdf: Callable[[bytes], str] | None = None, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, type, size_mb, modified, text of a folder's files, suffixes in any case; blank ones are left out.

    ``areas``: HTML text from content areas alone.  Bytes that are no UTF-8 are dropped.  PDF
    files need a ``pdf`` function from bytes to text; without it they are left out.  A file
    that can't be read is left out; reading goes on.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = U.suffix(F.col("path"))
    known = files.select("path", kind.alias("type"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), F.col("modificationTime").alias("modified"), "content").filter(F.col("type").isin(*suffixes))

    @F.pandas_udf("string")
    def text_of(types: pd.Series, contents: pd.Series) -> pd.Series:
        def one(kind: str, content: bytes) -> str:
            try:
                if kind == ".docx":
                    return docx_text(content)
                if kind == ".pdf":
                    return pdf(content) if pdf else ""
                text = content.decode("utf-8", "ignore")
                return H.parse_text(text, areas) if kind in (".html", ".htm") else text
            except Exception:  # one bad file never ends the scan
                return ""

        return pd.Series([one(k, c) for k, c in zip(types, contents)])

    read = known.withColumn("text", text_of("type", "content")).drop("content")
    if areas:
        read = read.withColumn("text", F.when(F.col("type").isin(".html", ".htm"), T.clean_prose(F.col("text"))).otherwise(F.col("text")))
    return read.filter(F.trim("text") != "")


def stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A list of words, one a line, in lower case."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()
    return tuple(sorted(r["word"] for r in lines.collect()))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a page-graph JSON document; missing ranks and weights get their defaults."""
    document = spark.read.option("multiLine", True).json(path)
    nodes = document.select(F.explode("nodes").alias("n")).select("n.*")
    for name, default in (("final_rank", 0.0), ("initial_rank", 1.0), ("weight", 1.0)):
        nodes = nodes.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in nodes.columns else F.lit(default))
    return nodes, document.select(F.explode("links").alias("l")).select("l.*")


def graph_keys(nodes: DataFrame) -> DataFrame:
    """key and node columns: every node under its path as given, with forward slashes, and relative."""
    slashed = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    return nodes.filter("path is not null").withColumn("key", F.explode(F.array_distinct(F.array("path", slashed, F.regexp_replace(slashed, "^/+", "")))))


def url_mapping(nodes: DataFrame) -> DataFrame:
    return nodes.select("path", "url").filter("path is not null and url is not null")
