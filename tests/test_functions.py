import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkstone.functions import html as H
from inkstone.functions import similarity as S
from inkstone.functions import text as T
from inkstone.functions import urls as U
from inkstone.functions import weights as G
from inkstone.operators import summarize


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens_are_unicode(spark):
    text = "Élan naïve_x don't　9½ wide éa It's A b"
    found = value(spark, T.query_tokens(F.lit(text)))
    plain = "".join(c if c.isalnum() or c == "_" else " " for c in text.lower())
    assert found == plain.split()
    assert value(spark, T.index_tokens(F.lit("The cat AND a dog x"))) == ["cat", "dog"]
    assert unicodedata.category("½") == "No"


@pytest.mark.parametrize("a,b,expected", [("padas", "pandas", 90.909091), ("what", "whats", 88.888889), ("colour", "color", 90.909091), ("abc", "xyz", 0.0), ("", "", 100.0), ("a", "", 0.0)])
def test_ratio(spark, a, b, expected):
    assert round(value(spark, S.ratio(F.lit(a), F.lit(b))), 6) == expected


def test_prefilter_never_excludes_a_match(spark):
    words = ["pandas", "padas", "panda", "spark", "sparks", "park", "bark", "idiot", "idoit", "similar", "simliar", "a", "ab", "abcdefghij", "abcdefghjk"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    bad = pairs.filter((S.ratio(F.col("a"), F.col("b")) >= 80) & ~S.may_reach(F.col("a"), F.col("b")))
    assert bad.count() == 0


def test_typo_patterns(spark):
    typo = lambda a, b: value(spark, S.typo_pattern(F.lit(a), F.lit(b)))
    assert typo("teh", "the") and typo("pand4s", "pandas") and typo("abc", "xyz")  # nothing shared counts too
    assert not typo("ab", "ba") and not typo("xayb", "ab" + "q")


def test_sentences(spark):
    found = value(spark, T.sentences(F.lit("Dr. Who came. He saw! Then left? no. Yes.")))
    assert found == ["Dr. Who came", "He saw", "Then left? no", "Yes."]


def test_truncation(spark):
    items = F.sequence(F.lit(0), F.lit(99))
    assert value(spark, T.head_middle_tail(items, 8)) == [0, 1, 48, 49, 50, 51, 98, 99]
    assert value(spark, T.evenly_spaced(items, 4)) == [0, 33, 66, 99]
    assert value(spark, T.head_middle_tail(F.array(F.lit(1)), 8)) == [1]


def test_small_text_functions(spark):
    v = lambda c: value(spark, c)
    assert v(T.camel_tokens(F.lit("parseHTMLPage fooBar v2 abc1 HTTP"))) == ["parse", "html", "page", "foo", "bar", "abc", "http"]
    assert [v(T.stem(F.lit(w))) for w in ("walking", "walked", "cats", "flies", "cat")] == ["walk", "walk", "cat", "flie", "cat"]
    assert v(T.embedding_tokens(F.lit("Release 1.2.3 on 2024-01-02, 3 days later: foo_bar-baz"))) == ["release", "on", "later", "foo", "bar", "baz"]
    assert v(T.cluster_name(F.array(F.lit("page2"), F.lit("jump")), F.lit("x"))) == "Page_Jump"
    assert v(T.cluster_name(F.array().cast("array<string>"), F.lit("Cluster_3"))) == "Cluster_3"
    assert v(T.read_time(F.lit("a b c"))) == "1 min"
    assert v(T.clean_query(F.lit("a, b?!"))) == "a  b"
    assert v(T.clean_prose(F.lit("a\n\n b; (c) - d!"))) == "a b c - d!"
    assert v(T.replace_tokens(F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit("z")))) == "z b"
    assert v(T.path_terms(F.lit("/Docs/api2/docs"))) == ["docs", "api"]


URLS = [
    ("http://a.org/x", "http://a.org", True), ("http://a.org/x.PNG", "http://a.org", False), ("http://b.org/x", "http://a.org", False), ("", "http://a.org", False),
    ("http://a.org.evil.com/", "http://a.org", False), ("http://a.org/talks.html", "http://a.org", True),
]


@pytest.mark.parametrize("url,domain,expected", URLS)
def test_valid_urls(spark, url, domain, expected):
    assert value(spark, U.valid(F.lit(url), F.lit(domain))) is expected
    assert not value(spark, U.valid(F.lit(url), F.lit(domain), (domain + "/talks", domain + "/x")))


@pytest.mark.parametrize(
    "link,expected",
    [("#top", None), ("mailto:a@b.c", None), ("javascript:x", None), ("", None), ("/a?b#c", "http://s.org/a?b"), ("http://o.org/z", "http://o.org/z"), ("b.html", "http://s.org/d/b.html")],
)
def test_resolved_urls(spark, link, expected):
    assert value(spark, U.resolved(F.lit(link), F.lit("http://s.org/d/e.html"))) == expected


@pytest.mark.parametrize(
    "link,expected",
    [
        ("../x", "http://s.org/d/x"), ("./x/../y?q=/../z", "http://s.org/d/e/y?q=/../z"), ("/a/../../b/.", "http://s.org/b/"), ("../../../x", "http://s.org/x"), ("..", "http://s.org/d/"),
        ("?page=2", "http://s.org/d/e/f?page=2"), ("//o.org/x", "http://o.org/x"), (" y ", "http://s.org/d/e/y"), ("http://o.org/a/../b", "http://o.org/a/../b"), ("..x", "http://s.org/d/e/..x"),
    ],
)
def test_dot_segments(spark, link, expected):
    row = spark.createDataFrame([(link, "http://s.org/d/e/f")], "link string, page string")
    assert row.select(U.resolved(F.col("link"), F.col("page"))).first()[0] == expected


def test_url_parts(spark):
    v = lambda c: value(spark, c)
    assert v(U.storage_path(F.lit("http://a.org/docs/guide"))) == "docs/guide/index.html"
    assert v(U.storage_path(F.lit("http://a.org"))) == "index.html"
    assert v(U.storage_path(F.lit("http://a.org/x.html?q"))) == "x.html"
    with pytest.raises(Exception, match="leaves"):
        v(U.storage_path(F.lit("http://a.org/../x.html")))
    assert v(U.depth(F.lit("http://a.org/b/c/"))) == 2 and v(U.basename(F.lit("http://a.org/b/"))) == "b"
    assert v(U.looks_like_url(F.lit("http://a.org"))) and not v(U.looks_like_url(F.lit("a b")))
    assert v(U.trimmed(F.lit(" http://a.org// "))) == "http://a.org" and v(U.suffix(F.lit("/a/B.HTML"))) == ".html"


def test_weights(spark):
    v = lambda c: value(spark, c)
    weight = G.content_weight(F.lit("Home"), F.lit("http://a.org/b"), F.lit(600), F.lit(1), F.lit(0))
    assert v(weight) == pytest.approx(1.782)
    assert v(G.link_weight(F.lit("http://a/b"), F.lit("http://a/b/c"), F.lit("The Guide"), F.lit("nav-x"), F.lit("nav"))) == pytest.approx(1.966)
    none = F.lit(None).cast("double")
    assert v(G.rank_score(none, none, none, F.lit(0), F.lit(0), F.lit(0))) == 1.0
    assert v(G.rank_score(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), F.lit(0))) == pytest.approx(0.1)
    assert v(G.rank_score(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0), F.lit(0), F.lit(0))) == pytest.approx(0.44)


PAGE = '<html><head><title> A &amp; B </title><script>x="<p>"</script></head><body><nav><a class="Menu" href="/x">X <b>y</b></a></nav><div class="main-content">one<article class="text">two</article></div><p>three</p></body></html>'


def test_html(spark):
    v = lambda c: value(spark, c)
    assert v(H.visible_text(F.lit(PAGE))) == "A & B X y one two three"
    assert v(H.title(F.lit(PAGE), F.lit("u"))) == "A & B" and v(H.title(F.lit("<p>"), F.lit("u"))) == "u"
    assert [tuple(a) for a in v(H.anchors(F.lit(PAGE)))] == [("/x", "X y", "menu")]
    assert H.parse_text(PAGE) == "A & B X y one two three"
    assert H.parse_text(PAGE, areas=True) == "one two two"  # nested areas repeat
    assert H.parse_text("<p>a</p>", areas=True) == "a" and H.parse_text(None) is None


def test_links_of_a_tree(spark):
    found = H.parse_links('<nav><a class="M x" href=" /x ">X <b>y</b></a></nav><header><ul><li><a href="/n">n</a></li></ul></header><p><br><a>no</a>t<a href="z">q</p><footer><a href="">e</a></footer>')
    assert [(x["href"], x["text"], x["class"], x["parent"]) for x in found] == [("/x", "X y", "m x", "nav"), ("/n", "n", "", "li"), ("z", "q", "", "p"), ("", "e", "", "footer")]
    assert H.parse_links(None) is None and H.parse_links("") == []
    assert [tuple(a) for a in value(spark, H.tree_anchors(F.lit(PAGE)))] == [("/x", "X y", "menu", "nav")]


def test_previews(spark):
    show = lambda text, summary=None: value(spark, summarize.preview(F.lit(text).cast("string"), F.lit(summary).cast("string")))
    assert show(None) == "Invalid input: Text must be a string."
    assert show("  \n ") == "No content available for summarization."
    assert show("short  text") == "short text"
    long = "word " * 60
    assert show(long, "A summary") == "A summary..."
    assert show(long, "A" * 120 + ". " + "B" * 120) == "A" * 120 + "."
    assert show(long, "abc " * 80) == ("abc " * 50).rstrip() + "..."
    assert show("First one. Second one. " * 20, None) == "First one.  Second one."


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert value(spark, S.cosine(a, b)) == pytest.approx(1 / math.sqrt(2))
    assert value(spark, S.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert value(spark, S.squared_distance(a, b)) == 1.0


def test_previews_are_small_plans(spark):
    # parts of a preview are worked out once: nested uses of them grew beyond what Java compiles
    text = F.concat_ws(". ", F.lit("One sentence here"), F.col("id").cast("string"))
    shown = spark.range(1).select(summarize.preview(text, F.lit(None).cast("string"), F.lit(2), F.lit(5)).alias("p"))
    assert str(shown._jdf.queryExecution().analyzed()).count("concat_ws") < 10
    assert shown.first()["p"] == "One..."
