import math

import pytest
from pyspark.sql import functions as F

from inkstone.operators import bm25, cluster, graph, lookup, search, tasks
from inkstone.plans import pipeline
from inkstone.sources import files, sinks
from inkstone.streaming import status


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(0, "apple pear"), (1, "apple plum plum"), (2, "grape"), (3, ""), (4, None)], "doc_id long, text string")
    return bm25.build_index(bm25.tokenized(docs))


def test_floored_idf_and_statistics(index):
    terms = {r["term"]: r for r in index.terms.collect()}
    raw = {w: math.log(3 - df + 0.5) - math.log(df + 0.5) for w, df in (("apple", 2), ("pear", 1), ("plum", 1), ("grape", 1))}
    floor = 0.25 * sum(raw.values()) / 4
    assert terms["apple"]["idf"] == pytest.approx(floor) and terms["pear"]["idf"] == pytest.approx(raw["pear"])
    row = bm25.statistics(index).first()
    assert (row["n_docs"], row["vocabulary"]) == (3, 4) and row["avg_tokens"] == 2


def test_every_document_is_a_result_even_without_score(spark, index):
    found = bm25.search(spark, index, "zzz").orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(2, 0.0), (1, 0.0), (0, 0.0)]
    assert bm25.search(spark, index, " ,").count() == 0


def test_repeated_query_words_count_each_time(spark, index):
    one, two = ({r["doc_id"]: r["score"] for r in bm25.search(spark, index, q).collect()} for q in ("plum", "plum plum"))
    assert two[1] == pytest.approx(2 * one[1]) and one[0] == 0


def test_strict_index(spark):
    docs = spark.createDataFrame([(0, "apple"), (1, "")], "doc_id long, text string")
    with pytest.raises(Exception, match="no tokens"):
        bm25.build_index(bm25.tokenized(docs), strict=True).docs.count()


def test_index_is_written_and_read(spark, index, tmp_path):
    index.write(str(tmp_path))
    again = bm25.Index.read(spark, str(tmp_path))
    assert sorted(again.terms.collect()) == sorted(index.terms.collect())
    assert bm25.search(spark, again, "plum").orderBy("rank").first()["doc_id"] == 1


def test_search_corrects_words(spark, index):
    answer = search.search(spark, index, "aple, grap!")
    assert answer.suggested_query == "apple grape" and answer.used_suggestion
    known = search.search(spark, index, "apple")
    assert known.suggested_query is None and not known.used_suggestion and known.results.count() == 3
    assert [(r["word"], r["term"]) for r in search.similar_terms(search.query_words(spark, "plums"), index.terms).collect()] == [("plums", "plum")]


def test_edges_and_ranks(spark):
    edges = spark.createDataFrame([(1, "A", "B", 1.0), (2, "B", "A", 1.0), (3, "A", "C", 1.0), (4, "C", "X", 1.0)], "seq long, source string, target string, weight double")
    once = graph.deduplicated_edges(edges)
    assert sorted((r["source"], r["target"]) for r in once.collect()) == [("A", "B"), ("A", "C"), ("C", "X")]
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(spark, spark.createDataFrame([("A",), ("B",), ("C",)], "id string"), once).collect()}
    assert ranks["A"] == pytest.approx(0.05) and ranks["B"] == pytest.approx(0.05 + 0.85 * 0.05 / 2) and ranks["C"] == pytest.approx(ranks["B"])
    assert graph.pagerank(spark, spark.createDataFrame([], "id string"), once).count() == 0
    assert [r["id"] for r in graph.degrees(once, "source").collect()] == ["A", "C"]


def test_ranks_may_grow_and_stop_at_the_cap(spark):
    edges = spark.createDataFrame([(1, "A", "B", 2.0), (2, "B", "A", 2.0)], "seq long, source string, target string, weight double")
    found = graph.pagerank(spark, spark.createDataFrame([("A",), ("B",)], "id string"), edges, rounds=7).collect()
    assert {r["rounds"] for r in found} == {7} and min(r["rank"] for r in found) > 1


def test_bounded_traversal(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "source string, target string")
    assert sorted(tuple(r) for r in graph.levels(spark, links, "a").collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert sorted(tuple(r) for r in graph.levels(spark, links, "a", max_pages=2).collect()) == [("a", 0), ("b", 1)]
    assert graph.levels(spark, links, "a", max_pages=1).count() == 1


SITE = [
    (1, "http://s.org/", '<nav><a href="/a">Guide</a><a href="http://o.org/x">out</a></nav><footer><a href="b/../c">c</a></footer><p><a href="/a">Guide</a> <a href="/logo.png">i</a> <a href="/gone">g</a></p>'
     + "".join(f'<a href="http://o{k}.org/">o</a>' for k in range(7))),
    (2, "http://s.org/a", '<p><a class="nav-x" href="/">home</a><a href="/c#top">c</a><a href="/c">c</a></p>'),
    (3, "http://s.org/c", '<li><a href="/d">d</a></li>'),
    (4, "http://s.org/d", None),
]


def test_links_of_pages(spark):
    pages = spark.createDataFrame(SITE, "page_id long, url string, html string")
    found = [(r["source"], r["target"], r["link_position"], r["weight"]) for r in graph.edges(pages).orderBy("page_id", "seq").collect()]
    # one level of depth difference costs a tenth; nav, header and footer around a link count 1.3, guides 1.4, nav classes 1.2
    assert found == [
        ("http://s.org/", "http://s.org/a", "nav", 1.82), ("http://s.org/", "http://s.org/c", "footer", 1.3), ("http://s.org/", "http://s.org/a", "p", 1.4), ("http://s.org/", "http://s.org/gone", "p", 1.0),
        ("http://s.org/a", "http://s.org/", "p", 1.2), ("http://s.org/a", "http://s.org/c", "p", 1.0), ("http://s.org/a", "http://s.org/c", "p", 1.0), ("http://s.org/c", "http://s.org/d", "li", 1.0),
    ]
    assert graph.edges(pages, valid=False).count() == 17
    assert {r["page_id"]: r["outbound_links"] for r in graph.nodes(pages.filter("html is not null")).collect()} == {1: 4, 2: 3, 3: 1}


def test_a_limited_crawl_counts_pages_only(spark):
    pages = spark.createDataFrame([*SITE, (9, "http://o1.org/", "")], "page_id long, url string, html string")
    ids = lambda n: sorted(r["page_id"] for r in pipeline.crawled(spark, pages, "http://s.org/", n).collect())
    assert [ids(n) for n in (1, 2, 3, 4, 40)] == [[1], [1, 2], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4]]


def test_top_pages(spark):
    pages = spark.createDataFrame(SITE, "page_id long, url string, html string")
    links, known = graph.edges(pages), pages.select(F.col("url").alias("id"), "url", F.concat(F.lit("page "), "page_id").alias("title"))
    assert [tuple(r) for r in graph.top_pages(known, links, "target", 2).collect()] == [("http://s.org/c", "http://s.org/c", "page 3", 3), ("http://s.org/a", "http://s.org/a", "page 2", 2)]
    assert [r["degree"] for r in graph.top_pages(known, links, "source", 5).collect()] == [4, 3, 1]


def test_clusters(spark):
    points = [(0, [0.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [9.0, 9.0], 1), (3, [9.0, 8.0], 1)]
    vectors = spark.createDataFrame(points, "id long, vector array<double>, label int")
    far = [math.dist(points[0][1], points[k][1]) for k in (2, 3)]
    exact = cluster.silhouette_euclidean(vectors).first()[0]
    assert exact == pytest.approx(1 - 1 / (sum(far) / 2), abs=0.01)
    # of three rows the mean of theirs, each against all
    assert 0.8 < cluster.silhouette_euclidean(vectors, rows=3).first()[0] < 1 and cluster.silhouette_euclidean(vectors, rows=4).first()[0] == exact
    assert cluster.choose_k(vectors.select("id", "vector")) == 2
    assert cluster.choose_k(vectors.limit(1)) == 1 and cluster.choose_k(vectors.withColumn("vector", F.array(F.lit(1.0)))) == 1
    labels = {r["id"]: r["label"] for r in cluster.kmeans(vectors.select("id", "vector"), 9).collect()}
    assert len(labels) == 4
    assert {r["id"]: r["cluster"] for r in cluster.nearest(vectors, cluster.centroids(vectors)).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}


def test_document_vectors_leave_out_unknown_words(spark):
    tokens = spark.createDataFrame([(0, ["a", "zz", "b"]), (1, ["zz"])], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    assert {r["id"]: r["vector"] for r in cluster.document_vectors(tokens, words).collect()} == {0: [0.5, 0.5], 1: [0.0, 0.0]}


def test_keywords_are_diverse(spark):
    rows = [(0, f"t{k}", 10 - k, 0.1, 0.0, False, 0.1 - k / 100, k + 1) for k in range(4)]
    scores = spark.createDataFrame(rows, "cluster int, term string, n long, tf double, other_tf double, in_path boolean, distinctiveness double, place int")
    words = spark.createDataFrame([("t0", [1.0, 0.0]), ("t1", [1.0, 0.01]), ("t2", [0.0, 1.0]), ("t3", [-1.0, 0.0])], "word string, vector array<double>")
    found = cluster.keywords(scores, words, 2).first()["keywords"]
    assert len(found) == 2 and not {"t0", "t1"} <= set(found)


def test_task_tables(spark):
    log = spark.createDataFrame([("a", 1, "x", 5), ("a", 3, "y", 6), ("b", 2, "z", 7), ("a", 2, "w", 8)], "task_id string, at long, status string, created long")
    assert sorted(tuple(r) for r in tasks.latest(log, ["task_id"], "at").collect()) == [("a", 3, "y", 6), ("b", 2, "z", 7)]
    assert sorted(tuple(r) for r in tasks.compacted(log, ["task_id"], "at", "created").collect()) == [("a", 3, "y", 5), ("b", 2, "z", 7)]
    state = tasks.latest(log, ["task_id"], "at")
    new = spark.createDataFrame([("b", 9, "n", 1), ("c", 9, "n", 1)], log.schema)
    assert sorted(r["task_id"] + r["status"] for r in tasks.inserted_if_absent(state, new, ["task_id"]).collect()) == ["ay", "bz", "cn"]
    assert sorted(r["task_id"] + r["status"] for r in tasks.replaced(state, new, "task_id").collect()) == ["ay", "bn", "cn"]
    changes = new.select("task_id", "status")
    assert sorted(r["task_id"] + r["status"] for r in tasks.updated(state, changes, ["task_id"]).collect()) == ["ay", "bn"]
    gone = tasks.deleted({"log": log, "state": state}, new, "task_id")
    assert gone["log"].count() == 3 and gone["state"].count() == 1
    assert set(tasks.SCHEMAS) == {"tasks", "analysis", "downloads", "text_index", "clustering", "cluster_details"}


STATES = [
    ("running", None, None, "downloading"), (None, None, None, None), ("completed", None, None, "indexing"), ("completed", "running", None, "indexing"),
    ("completed", "completed", None, "clustering"), ("completed", "completed", "running", "clustering"), ("completed", "completed", "completed", "completed"),
]


def test_state_machine(spark):
    def table(column, schema="task_id long, status string, processed_files long"):
        return spark.createDataFrame([(k, s[column], 4 if column == 0 else 0) for k, s in enumerate(STATES) if s[column]], schema)

    found = {r["task_id"]: (r["state"], r["processed_files"]) for r in tasks.pipeline_state(table(0), table(1), table(2)).collect()}
    assert found == {k: (s[3], 4) for k, s in enumerate(STATES) if s[3]}


def test_lookup_takes_the_first_known_key(spark):
    rows = spark.createDataFrame([(1, "x", "y"), (2, "q", "y"), (3, "q", "r")], "id long, a string, b string")
    table = spark.createDataFrame([("x", 10), ("y", 20)], "k string, v long")
    found = lookup.first_match(rows, F.array("a", "b"), table, "k", "v")
    assert {r["id"]: r["v"] for r in found.collect()} == {1: 10, 2: 20, 3: None}


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"plain \xff text")
    (tmp_path / "sub" / "b.html").write_text("<p>page <b>text</b></p>")
    (tmp_path / "blank.txt").write_text("  ")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "bad.docx").write_text("no archive")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    found = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.documents(spark, str(tmp_path)).collect()}
    assert found == {"a.TXT": "plain  text", "b.html": "page text", "e.docx": "onetwo"}
    with_pdf = files.documents(spark, str(tmp_path), pdf=lambda content: f"{len(content)} bytes")
    assert with_pdf.filter("type = '.pdf'").first()["text"] == "4 bytes"
    (tmp_path / "words.lst").write_text("The\n and \n\n,\n")
    assert files.stopwords(spark, str(tmp_path / "words.lst")) == (",", "and", "the")


def test_graph_documents(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "http://a", "/x\\y"), ("2", "http://b", None)], "id string, url string, path string")
    links = spark.createDataFrame([("1", "2", 1.0)], "source string, target string, weight double")
    sinks.graph_document(nodes, links, "a").coalesce(1).write.text(str(tmp_path / "g"))
    again, edges = files.graph(spark, str(tmp_path / "g"))
    assert again.count() == 2 and edges.count() == 1 and {r["weight"] for r in again.collect()} == {1.0}
    assert {r["key"] for r in files.graph_keys(again).collect()} == {"/x\\y", "/x/y", "x/y"}
    assert [tuple(r) for r in files.url_mapping(again).collect()] == [("/x\\y", "http://a")]
    sinks.write_graph(nodes, links, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/nodes")).count() == 2
    assert sinks.pages_to_store(spark.createDataFrame([("u", "h"), ("v", "hh")], "url string, html string"), spark.createDataFrame([("u",)], "url string")).first()["size"] == 2


def test_stream_of_status(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z")], "task_id string, at long, status string")
    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = status.events(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1)
        status.mirror(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["task_id"], "at").awaitTermination(60)
        if not k:
            spark.createDataFrame([("b", 9, "w")], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(tuple(r) for r in status.state(spark, str(tmp_path / "out"), ["task_id"], "at").collect()) == [("a", 3, "y"), ("b", 9, "w")]


def test_pipeline_functions(spark):
    assert pipeline.validated(" https://a.org/b/ ") == "https://a.org/b"
    with pytest.raises(ValueError):
        pipeline.validated("ftp:x")
    assert pipeline.tagged(spark, "job-1", lambda: spark.range(3)).count() == 3
    pipeline.cancel(spark, "job-1")
    pages = spark.createDataFrame([(1, "http://a.org/", '<a href="/b">b</a>'), (2, "http://a.org/b", "<p>x</p>"), (3, "http://a.org/c", "")], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in pipeline.crawled(spark, pages, "http://a.org/").collect()) == [1, 2]


def test_words_and_shares_of_word_vectors(spark):
    # two languages that never meet; words that occur once have no vector
    texts = [(k, [("a" if k % 2 else "b") + str((k * 7 + j * j * 3 + j) % 20) for j in range(30)] + [f"once{k}"]) for k in range(400)]
    tokens = spark.createDataFrame([*texts, (400, None), (None, ["b0"])], "doc_id long, tokens array<string>")
    words = cluster.word_vectors(tokens, dimensions=16, share=7000)
    again = cluster.word_vectors(tokens.repartition(5), dimensions=16, share=7000)
    found = {r["word"]: r for r in words.collect()}
    assert set(found) == {t for _, w in texts for t in w if not t.startswith("once")}
    assert sum(r["n"] for r in found.values()) == 400 * 30 + 1
    assert {r["word"]: r["vector"] for r in again.collect()} == {w: r["vector"] for w, r in found.items()}
    common = [sum(x) / len(found) for x in zip(*(r["vector"] for r in found.values()))]
    less = {w: [x - c for x, c in zip(r["vector"], common)] for w, r in found.items()}
    cosine = lambda a, b: math.sumprod(less[a], less[b]) / math.hypot(*less[a]) / math.hypot(*less[b])
    near = {w: max((x for x in less if x != w), key=lambda x: cosine(w, x)) for w in less}
    assert sum(w[0] == x[0] for w, x in near.items()) >= 0.9 * len(near)

    # words sent to the executors and words joined give the same means, of each row its own
    for head in (0, 16 * 10, 10**9):
        vectors = {r["id"]: r["vector"] for r in cluster.document_vectors(tokens, words, head).collect()}
        assert len(vectors) == 402 and vectors[400] == [0.0] * 16 and vectors[None] == pytest.approx(found["b0"]["vector"], abs=1e-6)
        assert vectors[3] == pytest.approx([sum(x) / 30 for x in zip(*(found[w]["vector"] for w in texts[3][1][:-1]))], abs=1e-6)


def test_the_driver_holds_no_word_list(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    monkeypatch.setattr(Word2Vec, "fit", lambda *_: pytest.fail("trained with the words on the driver"))
    tokens = spark.createDataFrame([(k, ["x", "y", "z"]) for k in range(9)], "doc_id long, tokens array<string>")
    assert cluster.word_vectors(tokens, dimensions=8).select("word").count() == 3
    assert cluster.word_vectors(tokens.limit(0), dimensions=8).count() == 0


def test_terms_are_compared_with_all_other_documents(spark):
    rows = [(k, 0, "/a", "apple") for k in range(3)] + [(10 + k, 1, "/b", "apple" if k < 3 else "pear") for k in range(1500)]
    docs = spark.createDataFrame(rows, "id long, cluster int, path string, text string")
    found = {(r["cluster"], r["term"]): r for r in cluster.term_scores(docs).collect()}
    assert found[0, "apple"]["other_tf"] == 3 / 1500 and found[0, "apple"]["distinctiveness"] == 1 - 3 / 1500
    assert found[1, "apple"]["other_tf"] == 1.0 and found[1, "pear"]["other_tf"] == 0.0
