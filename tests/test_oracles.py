"""Every query with DuckDB SQL gives the same rows as that SQL; the others give rows."""

import glob
import math
import os

import duckdb
import pytest

from inkstone.plans import more_queries  # noqa: F401  (adds its queries)
from inkstone.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, small, duck, name):
    found = QUERIES[name](spark, small)
    ours = _rows(found.columns, [tuple(r) for r in found.collect()])
    result = duck.execute(ORACLES[name])
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_all_sentences_of_a_very_long_text(spark, tmp_path):
    text = " ".join(f"Sentence {k} ends here." for k in range(12_000))
    spark.createDataFrame([(1, text), (2, "One here. Two there.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("sentence_split", "sentence_tfidf", "sentence_rank"):
        found = QUERIES[name](spark, str(tmp_path))
        result = connection.execute(ORACLES[name])
        assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows([d[0] for d in result.description], result.fetchall())
        assert name != "sentence_split" or found.count() == 12_002


def _same_as_sql(spark, name, folder, table):
    connection = duckdb.connect()
    connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found, result = QUERIES[name](spark, str(folder)), connection.execute(ORACLES[name])
    ours, theirs = _rows(found.columns, [tuple(r) for r in found.collect()]), _rows([d[0] for d in result.description], result.fetchall())
    assert ours == theirs


def test_urls_of_repeated_pages(spark, tmp_path):
    # an address belongs to its first page, be that even or odd, though a later even page has it too
    rows = [(1, "http://a/", ""), (2, "http://a/", ""), (4, "http://b/", ""), (6, "http://b/", ""), (7, "http://b/", ""), (8, "http://c/", ""), (8, "http://c/", ""), (10, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    _same_as_sql(spark, "url_of_path", tmp_path, "pages")


def test_entities_without_semicolon(spark, tmp_path):
    texts = ("a &amp", "a &amp b &amp; c", "&lt x &lt; y", "&notit; &ampx; & &; &copy; &copy", "&amp;lt; &#39; &#39 x", "R&D &middot; AT&T;")
    rows = [(k, "http://a/", f"<html><head><title>{t}</title></head><body><p>{t}</p><p>end</p></body></html>") for k, t in enumerate(texts)]
    spark.createDataFrame([*rows, (99, "http://a/", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    _same_as_sql(spark, "html_tree_text", tmp_path, "pages")
