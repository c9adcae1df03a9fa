"""Queries over the test tables: one per operator or group of operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import similarity as S
from ..functions import text as T
from ..functions import urls as U
from ..functions import weights as G
from ..operators import bm25, cluster, graph, lookup, search, summarize, tasks
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

QUERY = "idiot clown thonon tion tion"
MISTYPED = "idoit, clowm thonon!"
NO_MATCH = "zzzzqqqq xxxxwwww"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_WORDS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g'), '[\s\p{{Z}}]+'), lambda t: {})"


def _tokens(column: str) -> str:
    return _WORDS.format(column, f"length(t) > 1 and t not in ({_STOP})")


_INDEX = f"""
tok as materialized (select doc_id, {_tokens("coalesce(text, '')")} as toks from documents),
docs as (select doc_id, len(toks) as dl from tok where len(toks) > 0),
post as materialized (select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from tok) group by all),
corp as (select count(*) as n, avg(dl) as avgdl from docs),
raw as materialized (select term, count(*) as df, sum(tf) as cf, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from post, corp group by term),
eps as (select avg(raw) as avg_idf, 0.25 * avg(raw) as eps from raw),
terms as (select term, df, cf, case when raw < 0 then eps else raw end as idf from raw, eps)
"""


def _index(spark: SparkSession, sf_dir: str, weight=None) -> bm25.Index:
    return bm25.build_index(bm25.tokenized(_table(spark, sf_dir, "documents"), weight=weight))


def _bag(words: str) -> str:
    counted = {w: words.split().count(w) for w in words.split()}
    return ", ".join(f"('{w}', {n})" for w, n in counted.items())


def _ranking(bag: str, weight: str = "1.0", where: str = "true", extra: str = "") -> str:
    return f"""with {_INDEX}, {extra} q(term, qtf) as ({bag}),
part as (select p.doc_id, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) as s
  from post p join q using (term) join terms using (term) join docs using (doc_id), corp group by p.doc_id),
scored as (select d.doc_id, {weight} * coalesce(s, 0.0) as score from docs d left join part using (doc_id) where {where})
select doc_id, round(score, 6) as score, row_number() over (order by round(score, 9) desc, doc_id desc) as rank
from scored where score > -30 order by round(score, 9) desc, doc_id desc limit 5"""


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("doc_id", _round("score"), F.col("rank").cast("long").alias("rank"))


# Retrieval ------------------------------------------------------------------------------------------


@query(f"select doc_id, len(toks) as n_tokens, len(list_distinct(toks)) as n_distinct from (select doc_id, {_tokens('text')} as toks from documents)")
def tokenize_counts(spark, sf_dir):
    docs = bm25.tokenized(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


@query(f"with {_INDEX} select term, df, cast(cf as bigint) as cf from raw")
def vocabulary_df(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", "df", "cf")


@query(f"with {_INDEX} select term, round(idf, 6) as idf from terms")
def idf_floored(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", _round("idf"))


@query(f"with {_INDEX} select n as n_docs, (select count(*) from raw) as vocabulary, round(avgdl, 6) as avg_tokens, round(avg_idf, 6) as avg_idf from corp, eps")
def index_stats(spark, sf_dir):
    return bm25.statistics(_index(spark, sf_dir)).select("n_docs", "vocabulary", _round("avg_tokens"), _round("avg_idf"))


@query(_ranking("values " + _bag(QUERY)))
def bm25_search(spark, sf_dir):
    return _ranked(bm25.search(spark, _index(spark, sf_dir), QUERY))


@query(
    f"""with {_INDEX}, lab as (select doc_id, max(quality) as quality from labels group by doc_id), q(term, qtf) as (values {_bag(QUERY)}),
part as (select p.doc_id, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) as s
  from post p join q using (term) join terms using (term) join docs using (doc_id), corp group by p.doc_id),
scored as (select d.doc_id, (1.0 + 0.5 * coalesce(quality, 0)) * coalesce(s, 0.0) as score from docs d left join part using (doc_id) left join lab using (doc_id))
select doc_id, round(score, 6) as score, row_number() over (order by round(score, 9) desc, doc_id desc) as rank from scored order by rank limit 5"""
)
def bm25_weighted(spark, sf_dir):
    known = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = _table(spark, sf_dir, "documents").join(known, "doc_id", "left")
    index = bm25.build_index(bm25.tokenized(docs, weight=1.0 + 0.5 * F.coalesce("quality", F.lit(0))))
    return _ranked(bm25.search(spark, index, QUERY))


@query(_ranking("values " + _bag(QUERY), where="doc_id in (select doc_id from documents where source = 'src1')"))
def bm25_subset(spark, sf_dir):
    ids = _table(spark, sf_dir, "documents").filter("source = 'src1'").select("doc_id")
    return _ranked(bm25.search(spark, _index(spark, sf_dir), QUERY, doc_ids=ids))


@query(_ranking("values " + _bag(NO_MATCH)))
def bm25_zero_padding(spark, sf_dir):
    return _ranked(bm25.search(spark, _index(spark, sf_dir), NO_MATCH))


_LCS = """list_last(list_reduce(list_concat([list_transform(range(length({b}) + 1), lambda x: 0::bigint)], list_transform(string_split({a}, ''), lambda c: [ord(c)::bigint])),
  lambda last, c: list_reduce(list_concat([[0::bigint]], list_transform(range(1, length({b}) + 1), lambda j: [j])),
    lambda done, j: list_append(done, case when ord(substr({b}, j[1]::int, 1)) = c[1] then last[j[1]] + 1 else greatest(last[j[1] + 1], done[-1]) end))))"""
_RATIO = "200.0 * " + _LCS.format(a="w.word", b="v.term") + " / (length(w.word) + length(v.term))"


def _similar(words: str, shortest: int = 3, unknown: bool = False) -> str:
    listed = ", ".join(f"({k}, '{w}')" for k, w in enumerate(words.split()))
    known = "where word not in (select term from terms) and length(word) >= 3" if unknown else ""
    return f"""words as (select * from (values {listed}) as t(position, word) {known}),
pairs as materialized (select distinct w.word, v.term from words w, terms v where w.word <> v.term and length(v.term) >= {shortest}
  and abs(length(w.word) - length(v.term)) <= (length(w.word) + length(v.term)) // 5 and levenshtein(w.word, v.term) <= (length(w.word) + length(v.term)) // 5),
rated as materialized (select w.word, v.term, {_RATIO} as similarity from pairs w join pairs v on w.word = v.word and w.term = v.term),
near as (select word, term, similarity, row_number() over (partition by word order by similarity desc, term) as rank from rated where similarity >= 80 qualify rank <= 3)"""


@query(f"with {_INDEX}, {_similar('idoit clowm thonon')} select word, term, round(similarity, 6) as similarity, rank from near")
def fuzzy_matches(spark, sf_dir):
    index = _index(spark, sf_dir)
    words = search.query_words(spark, "idoit clowm thonon")
    return search.similar_terms(words, index.terms).select("word", "term", _round("similarity"), F.col("rank").cast("long").alias("rank"))


@query(
    _ranking(
        "select term, count(*) from (select word as term from words union all select n.term from words w join near n using (word)) group by term", extra=f"{_similar('idoit clowm thonon')},"
    )
)
def fuzzy_expanded_search(spark, sf_dir):
    return _ranked(search.fuzzy_search(spark, _index(spark, sf_dir), "idoit clowm thonon"))


@query(f"with {_INDEX}, {_similar('idoit clowm thonon', 1, True)} select cast(w.position as int) as position, word, term, round(similarity, 6) as similarity, rank from words w join near using (word)")
def spelling_suggestions(spark, sf_dir):
    found = search.suggestions(spark, "idoit clowm thonon", _index(spark, sf_dir))
    return found.select("position", "word", "term", _round("similarity"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""with {_INDEX}, {_similar('idoit clowm thonon', 1, True)} select coalesce((select term from near n where n.word = a.w and rank = 1), a.w) as word, cast(a.p as int) as position
from (values (0, 'idoit'), (1, 'clowm'), (2, 'thonon')) as a(p, w)"""
)
def corrected_query(spark, sf_dir):
    answer = search.search(spark, _index(spark, sf_dir), MISTYPED)
    return spark.range(1).select(F.posexplode(F.split(F.lit(answer.suggested_query or "idoit clowm thonon"), " ")).alias("position", "word")).select("word", "position")


_PAIRS = (("padas", "pandas"), ("what", "whats"), ("colour", "color"), ("abc", "xyz"), ("teh", "the"), ("he11o", "hello"), ("form", "from"), ("pand4s", "pandas"), ("ab", "ba"), ("panddas", "pandas"), ("m0ron", "moron"), ("similar", "simliar"))
_PAIR_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)
_SHARED = "array_to_string(list_filter(string_split({0}, ''), lambda c: c <> '' and contains({1}, c)), '')"
_STAND = " or ".join(f"(substr(a, k, 1) = '{s}' and substr(b, k, 1) = '{t}') or (substr(a, k, 1) = '{t}' and substr(b, k, 1) = '{s}')" for s, t in S.LOOKALIKES)


@query(
    f"""select a as word, b as suggestion, length(a) >= 3 and (contains(a, {_SHARED.format('a', 'b')}) and contains(b, {_SHARED.format('b', 'a')})
  or len(list_filter(range(1, least(length(a), length(b))), lambda k: substr(a, k::int, 1) = substr(b, k::int + 1, 1) and substr(a, k::int + 1, 1) = substr(b, k::int, 1) and substr(a, k::int, 1) <> substr(a, k::int + 1, 1))) > 0
  or len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: {_STAND.replace(', k,', ', k::int,')})) > 0) as typo from (values {_PAIR_ROWS}) as t(a, b)"""
)
def typo_patterns(spark, sf_dir):
    pairs = spark.createDataFrame(list(_PAIRS), "word string, suggestion string")
    return pairs.select("word", "suggestion", S.typo_pattern(F.col("word"), F.col("suggestion")).alias("typo"))


@query(
    f"select w.word, v.term as suggestion, round({_RATIO}, 6) as ratio from (select a as word, b as term from (values {_PAIR_ROWS}) as t(a, b)) w join (select a as word, b as term from (values {_PAIR_ROWS}) as t(a, b)) v on w.word = v.word and w.term = v.term"
)
def fuzzy_ratio(spark, sf_dir):
    pairs = spark.createDataFrame(list(_PAIRS), "word string, suggestion string")
    return pairs.select("word", "suggestion", F.round(S.ratio(F.col("word"), F.col("suggestion")), 6).alias("ratio"))


# Pages and addresses --------------------------------------------------------------------------------

_DECODE = "{}"
for _name, _sign in H.ENTITIES:
    _DECODE = f"replace({_DECODE}, '{_name}', '{_sign if _sign != chr(39) else chr(39) * 2}')"


def _visible(html: str) -> str:
    bare = f"regexp_replace({html}, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g')"
    bare = f"regexp_replace(regexp_replace({bare}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    return f"regexp_replace(regexp_replace({_DECODE.format(bare)}, '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"


def _inner(tag: str) -> str:
    found = f"regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)"
    bare = _DECODE.format(f"regexp_replace({found}, '(?s)<[^>]*>', '', 'g')")
    return f"nullif(regexp_replace(regexp_replace({bare}, '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g'), '')"


_OWN_TITLE = f"coalesce({_inner('title')}, {_inner('h1')})"
_ORIGIN = "regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_AUTHORITY = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PATH = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_BASENAME = "string_split(regexp_replace({}, '/+$', ''), '/')[-1]"
_TAGS = "regexp_extract_all(html, '(?is)(<a\\b[^>]*>.*?</a>)', 1)"
_HREF = "regexp_extract({}, '(?is)^<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"
_DEPTH = "len(list_filter(string_split({}, '/'), lambda p: p <> '')) - 2"
# in these pages every link comes right after the opening tag of the element around it
_TAGGED = "regexp_extract_all(html, '(?is)(<[a-z][a-z0-9]*\\b[^<>]*>\\s*<a\\b[^>]*>.*?</a>)', 1)"
_LINKS = f"""anchors as (select page_id, url, unnest(list_distinct({_TAGGED})) as both_ from pages),
placed as (select a.*, list_position({_TAGGED}, both_) as spot from anchors a join pages using (page_id)),
links as (select page_id, row_number() over (partition by page_id order by spot) - 1 as seq, url as source, {_HREF.format("regexp_extract(both_, '(?is)(<a.*)$', 1)")} as href,
  trim(regexp_replace(both_, '(?s)<[^>]*>', '', 'g')) as link_text, lower(regexp_extract(both_, '^<([a-zA-Z0-9]+)', 1)) as link_position from placed),
bare as (select *, trim(split_part(href, '#', 1)) as b,
  regexp_extract(source, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:[^?#]*/)?)', 1) as folder from links),
resolved as (select *, case when b = '' or regexp_matches(b, '(?i)^(mailto|tel|javascript|data):') then null when regexp_matches(b, '^[A-Za-z][A-Za-z0-9+.-]*://') then b
  when starts_with(b, '/') then {_ORIGIN.format('source')} || b else case when ends_with(folder, '/') then folder else folder || '/' end || b end as target from bare),
judged as (select *, coalesce(target <> '' and starts_with(target, {_ORIGIN.format('source')}) and not regexp_matches(target, '(?i)\\.({"|".join(U.RESOURCES)})$')
  and contains({_ORIGIN.format('source')}, {_AUTHORITY.format('target')}), false) as valid from resolved)"""
_LINK_WEIGHT = """round(1.0 * case when link_position in ('nav', 'header', 'footer') then 1.3 else 1.0 end * case when regexp_matches(lower(link_text), 'documentation|guide|tutorial|reference') then 1.4 else 1.0 end
  * 1.0 * greatest(0.7::double, 1 - 0.1::double * abs(len(string_split(source, '/')) - len(string_split(target, '/')))), 3)"""


@query(f"select page_id, length(t) as n_chars, md5(t) as text_md5 from (select page_id, {_visible('html')} as t from pages)")
def html_text(spark, sf_dir):
    text = H.visible_text(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("text_md5"))


@query(f"select page_id, coalesce({_OWN_TITLE}, url) as title from pages")
def page_title(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html"), F.col("url")).alias("title"))


@query(f"with {_LINKS} select page_id, cast(seq as int) as seq, target, link_text, link_position from judged where valid")
def page_links(spark, sf_dir):
    return graph.edges(_table(spark, sf_dir, "pages")).select("page_id", "seq", "target", "link_text", "link_position")


@query(f"with {_LINKS} select page_id, cast(seq as int) as seq, {_LINK_WEIGHT} as weight from judged where valid")
def link_weight(spark, sf_dir):
    return graph.edges(_table(spark, sf_dir, "pages")).select("page_id", "seq", "weight")


@query(f"select page_id, {_ORIGIN.format('url')} as origin, {_AUTHORITY.format('url')} as authority, {_PATH.format('url')} as path, {_DEPTH.format('url')} as depth, {_BASENAME.format('url')} as label from pages")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", U.origin(url).alias("origin"), U.authority(url).alias("authority"), U.path(url).alias("path"), U.depth(url).cast("long").alias("depth"), U.basename(url).alias("label")
    )


@query(f"with {_LINKS} select page_id, count(*) as n_links, count(target) as n_resolved, count(distinct target) as n_targets from resolved group by page_id")
def url_resolve(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    links = pages.select("page_id", "url", F.explode(F.array_distinct(H.tree_anchors("html"))).alias("a")).select("page_id", U.resolved(F.col("a.href"), F.col("url")).alias("target"))
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count("target").alias("n_resolved"), F.countDistinct("target").alias("n_targets"))


@query(f"with {_LINKS} select page_id, cast(seq as int) as seq, target, valid from judged where target is not null")
def valid_urls(spark, sf_dir):
    links = graph.edges(_table(spark, sf_dir, "pages"), valid=False)
    return links.select("page_id", "seq", "target", U.valid(F.col("target"), U.origin(F.col("source"))).alias("valid"))


@query(
    f"""select page_id, case when own = '' or ends_with(own, '/') then own || 'index.html' when contains(string_split(own, '/')[-1], '.') then own else own || '/index.html' end as path
from (select page_id, regexp_replace({_PATH.format('url')}, '^/+', '') as own from pages)"""
)
def url_storage_path(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", U.storage_path(F.col("url")).alias("path"))


_NODES = f"""nodes as (select page_id, url, {_OWN_TITLE} as title, length({_visible('html')}) as content_length, len(regexp_extract_all(html, '(?i)<(?:h1|h2|h3)[\\s>]')) as headers,
  len(regexp_extract_all(html, '(?i)<(?:code|pre)[\\s>]')) as code, len(list_filter({_TAGS}, lambda t: starts_with({_HREF.format('t')}, '/') and not regexp_matches({_HREF.format('t')}, '(?i)\\.({"|".join(U.RESOURCES)})$'))) as links from pages),
weighed as (select *, round(1.0::double * case when title is not null then 1.2 else 1.0 end::double * case when coalesce(regexp_matches(lower(title), 'home|index|main|documentation'), false) then 1.5 else 1.0 end::double
  * case when content_length > 5000 then 1.3 when content_length < 500 then 0.7 else 1.0 end::double * (1 + least(0.1::double * headers, 0.5::double))
  * case when regexp_matches(url, '(index\\.html|/|main\\.html)$') then 1.4 else 1.0 end::double * greatest(0.5::double, 1 - 0.1::double * ({_DEPTH.format('url')})) * (1 + least(0.05::double * code, 0.3::double)), 3) as weight from nodes)"""


@query(f"with {_NODES} select page_id, content_length, headers, code, links, weight from weighed")
def content_weight(spark, sf_dir):
    nodes = graph.nodes(_table(spark, sf_dir, "pages"))
    return nodes.select(
        "page_id", F.col("content_length").cast("long").alias("content_length"), F.col("headers_count").cast("long").alias("headers"), F.col("code_blocks").cast("long").alias("code"), F.col("outbound_links").cast("long").alias("links"), "weight"
    )


@query(
    f"""with {_NODES} select page_id, round(greatest(0.1::double, 0.4 * 0.0 + 0.2 * 1.0 + 0.2 * weight + 0.2 * (0.4 * case when content_length = 0 then 0.5 else least(content_length / 5000, 1.0) end
  + 0.3 * least(code / 10, 1.0) + 0.3 * least(links / 20, 1.0))), 6) as rank_score from weighed"""
)
def doc_rank_score(spark, sf_dir):
    nodes = graph.nodes(_table(spark, sf_dir, "pages"))
    score = G.rank_score(F.lit(0.0), F.col("initial_rank"), F.col("weight"), F.col("content_length"), F.col("code_blocks"), F.col("outbound_links"))
    return nodes.select("page_id", F.round(score, 6).alias("rank_score"))


@query(
    f"""with wanted as (select page_id, regexp_replace(url, '[?#].*$', '') as bare, {_PATH.format('url')} as path from pages),
keyed as (select bare as k, min(page_id) as id from wanted group by bare union all select path, min(page_id) from wanted group by path),
known as (select k, min(id) as id from keyed where k <> '' group by k)
select p.page_id, coalesce(a.id, b.id, c.id, d.id) as found, cast(case when a.id is not null then 0 when b.id is not null then 1 when c.id is not null then 2 when d.id is not null then 3 end as int) as priority
from pages p left join known a on a.k = p.url left join known b on b.k = regexp_replace(p.url, '[?#].*$', '') left join known c on c.k = {_PATH.format('p.url')}
left join known d on d.k = {_BASENAME.format("regexp_replace(p.url, '[?#].*$', '')")}"""
)
def multi_key_lookup(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    bare, path = F.regexp_replace("url", r"[?#].*$", ""), U.path(F.col("url"))
    keyed = pages.select("page_id", F.explode(F.array(bare, path)).alias("k")).filter("k <> ''").groupBy("k").agg(F.min("page_id").alias("found"))
    return lookup.first_match(pages, lookup.page_keys(F.col("url")), keyed, "k", "found").select("page_id", "found", "priority")


# Graphs: nations linked by orders -------------------------------------------------------------------

_TRADE = """trade as (select c_nationkey as source, s_nationkey as target, count(*) as n, min(l_orderkey * 8 + l_linenumber) as seq, 0.5 + (count(*) % 5) / 10.0::double as weight
  from orders join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey group by 1, 2),
once as (select * from trade qualify row_number() over (partition by least(source, target), greatest(source, target) order by seq) = 1)"""


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    grouped = joined.groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return grouped.withColumn("weight", 0.5 + (F.col("n") % 5) / 10.0)


@query(f"with {_TRADE} select source, target, n, round(weight, 6) as weight from once")
def edge_dedup(spark, sf_dir):
    return graph.deduplicated_edges(_trade(spark, sf_dir)).select("source", "target", "n", _round("weight"))


@query(
    f"""with {_TRADE}, a as (select 'in' as kind, target as id, count(*) as degree, min(seq) as seen from once group by target), b as (select 'out' as kind, source as id, count(*) as degree, min(seq) as seen from once group by source)
select kind, id, degree from (select * from a order by degree desc, seen limit 5) union all select kind, id, degree from (select * from b order by degree desc, seen limit 5)"""
)
def degree_topk(spark, sf_dir):
    links = graph.deduplicated_edges(_trade(spark, sf_dir))
    return graph.degrees(links, "target").withColumn("kind", F.lit("in")).unionByName(graph.degrees(links, "source").withColumn("kind", F.lit("out"))).select("kind", "id", "degree")


@query(f"with {_TRADE} select (select count(*) from nation) as total_nodes, count(*) as total_links, round(count(*) / (select count(*) from nation), 6) as average_links from once")
def graph_summary(spark, sf_dir):
    found = graph.summary(_table(spark, sf_dir, "nation"), graph.deduplicated_edges(_trade(spark, sf_dir)))
    return found.select("total_nodes", "total_links", _round("average_links"))


def _pagerank(rounds: int, digits: int) -> str:
    return f"""with recursive {_TRADE}, o as (select source, count(*) as c from once group by source), share as (select source, target, weight / c as w from once join o using (source)),
pr(it, id, rank) as (select 0, n_nationkey, 1.0::double / 25 from nation union all
  select it + 1, n_nationkey, 0.15 / 25 + 0.85 * coalesce(sum(rank * w), 0) from pr cross join nation left join share on target = n_nationkey and source = id where it < {rounds} group by it, n_nationkey)
select id, round(rank, {digits}) as rank from pr where it = {rounds}"""


def _ranks(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    return graph.pagerank(spark, _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), graph.deduplicated_edges(_trade(spark, sf_dir)), **limits)


@query(_pagerank(20, 6))
def pagerank_fixed20(spark, sf_dir):
    return _ranks(spark, sf_dir, rounds=20, tolerance=None).select("id", _round("rank"))


@query(_pagerank(60, 4))
def pagerank_converged(spark, sf_dir):
    return _ranks(spark, sf_dir).select("id", _round("rank", 4))


@query(
    f"""with recursive {_TRADE}, thin as (select distinct source, target from once where weight > 0.85),
b(id, depth) as (select 0, 0 union select target, depth + 1 from b join thin on id = source where depth < 25) select id, cast(min(depth) as int) as depth from b group by id"""
)
def bfs_levels(spark, sf_dir):
    links = graph.deduplicated_edges(_trade(spark, sf_dir)).filter("weight > 0.85")
    return graph.levels(spark, links, 0)


# Summaries ------------------------------------------------------------------------------------------

_SENTENCES = r"""sent as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(Mr|Dr|Mrs|Ms)\.', '\1' || chr(1), 'g'), '[.!?]+\s+([A-Z])', chr(2) || '\1', 'g'), chr(2)),
  lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '') as parts, text from documents),
sentences as (select doc_id, unnest(parts) as sentence, generate_subscripts(parts, 1) - 1 as i from sent)"""
_SENTENCE_WORDS = f"""words as (select doc_id, i, unnest(regexp_extract_all(array_to_string(list_filter(string_split_regex(regexp_replace(lower(sentence), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}.]', '', 'g'), '[\\s\\p{{Z}}]+'),
  lambda t: t not in ({_STOP})), ' '), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)) as term from sentences),
counted as (select doc_id, i, term, count(*) as tf from words group by all),
dfs as (select doc_id, term, count(*) as df, sum(tf) as cf from counted group by doc_id, term qualify row_number() over (partition by doc_id order by sum(tf) desc, term) <= 5000),
ns as (select doc_id, count(*) as n from sentences group by doc_id),
raws as (select doc_id, i, term, tf, tf * (ln((1 + n) / (1 + df)) + 1) as raw from counted join dfs using (doc_id, term) join ns using (doc_id)),
weights as (select doc_id, i, term, tf, raw / sqrt(sum(raw * raw) over (partition by doc_id, i)) as w from raws),
totals as (select doc_id, term, sum(w) as total from weights group by all),
sums as (select s.doc_id, s.i, s.sentence, coalesce(x.s, 0.0) as s from sentences s left join (select doc_id, i, sum(w * total) as s from weights join totals using (doc_id, term) group by doc_id, i) x using (doc_id, i)),
ranked as (select doc_id, i, sentence, case when max(s) over (partition by doc_id) > 0 then s / max(s) over (partition by doc_id) else 0.0 end as score from sums)"""


def _summary(n: int) -> str:
    return f"""best as (select doc_id, string_agg(sentence, ' ' order by i) as best from (select *, row_number() over (partition by doc_id order by round(score, 9) desc, i desc) as place from ranked) where place <= {n} group by doc_id),
summaries as (select doc_id, text, case when len(parts) <= {n} then text else best end as summary from sent left join best using (doc_id))"""


@query(f"with {_SENTENCES} select doc_id, cast(i as int) as i, sentence from sentences")
def sentence_split(spark, sf_dir):
    return summarize.split(_table(spark, sf_dir, "documents")).select("doc_id", "i", "sentence")


@query(f"with {_SENTENCES}, {_SENTENCE_WORDS} select doc_id, cast(i as int) as i, count(*) as n_terms, round(sum(w), 6) as weight from weights group by doc_id, i")
def sentence_tfidf(spark, sf_dir):
    weights = summarize.term_weights(summarize.split(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return weights.groupBy("doc_id", "i").agg(F.count("*").alias("n_terms"), F.round(F.sum("w"), 6).alias("weight"))


@query(f"with {_SENTENCES}, {_SENTENCE_WORDS} select doc_id, cast(i as int) as i, round(score, 6) as score from ranked")
def sentence_rank(spark, sf_dir):
    found = summarize.split(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return summarize.ranked(found, summarize.term_weights(found)).select("doc_id", "i", _round("score"))


@query(f"with {_SENTENCES}, {_SENTENCE_WORDS}, {_summary(3)} select doc_id, length(summary) as n_chars, md5(summary) as summary_md5 from summaries")
def extractive_summary(spark, sf_dir):
    found = summarize.summaries(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.length("summary").cast("long").alias("n_chars"), F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


@query(
    f"""with {_SENTENCES}, {_SENTENCE_WORDS}, {_summary(2)},
c as (select doc_id, regexp_replace(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g') as clean, summary from summaries),
b as (select doc_id, clean, case when summary <> '' then summary else array_to_string(string_split(clean, '.')[1:2], '. ') || '.' end as body from c),
k as (select *, substr(body, 1, 200) as cut from b),
p as (select *, case when contains(cut, '.') then length(cut) - instr(reverse(cut), '.') else -1 end as period, case when contains(cut, ' ') then length(cut) - instr(reverse(cut), ' ') else -1 end as space from k),
f as (select *, trim(case when length(body) <= 200 then body when period > 100 then substr(cut, 1, period + 1) when space >= 0 then substr(cut, 1, space) || '...' else substr(cut, 1, length(cut) - 1) || '...' end) as fitted from p)
select doc_id, case when clean = '' then 'No content available for summarization.' when length(clean) <= 200 then clean when regexp_matches(fitted, '[.!?]$') then fitted else fitted || '...' end as preview from f"""
)
def preview(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    short = summarize.summaries(docs, 2)
    return docs.join(short, "doc_id").select("doc_id", summarize.preview(F.col("text"), F.col("summary")).alias("preview"))


# Word functions -------------------------------------------------------------------------------------


@query(
    r"""select doc_id, len(t) as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, list_filter(string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\d+\.\d+\.\d+', ' ', 'g'), '\b\d{4}-\d{2}-\d{2}\b', ' ', 'g'), '\b\d+\s*(?:days?|months?|years?)\b', ' ', 'g'), '[_-]', ' ', 'g')), '[^\p{L}\p{N}_\s\p{Z}]', ' ', 'g'), '[\s\p{Z}]+'), lambda t: t <> '') as t from documents)"""
)
def w2v_preprocess(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.embedding_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(
    r"""select p_partkey, array_to_string(list_filter(list_transform(flatten(list_transform(list_filter(string_split_regex(p_name || ' ' || p_type || ' ' || p_brand, '[^\p{L}\p{N}_]+'), lambda t: t <> ''),
  lambda w: case when len(regexp_extract_all(w, '([A-Z]?[a-z]+|[A-Z]{2,}|\d+)', 1)) > 0 then regexp_extract_all(w, '([A-Z]?[a-z]+|[A-Z]{2,}|\d+)', 1) else [w] end)), lambda t: lower(t)),
  lambda t: length(t) >= 3 and not regexp_matches(t, '\p{Nd}')), ' ') as tokens from part"""
)
def camel_tokens(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return part.select("p_partkey", F.array_join(T.camel_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ").alias("tokens"))


@query(
    f"""with {_INDEX} select term, case when ends_with(term, 'ing') then substr(term, 1, length(term) - 3) when ends_with(term, 'ed') then substr(term, 1, length(term) - 2)
  when ends_with(term, 's') then substr(term, 1, length(term) - 1) else term end as stem from terms"""
)
def stems(spark, sf_dir):
    return _index(spark, sf_dir).terms.select("term", T.stem(F.col("term")).alias("stem"))


@query(r"select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(url), '([a-z]+)', 1))), ' ') as terms from pages")
def path_terms(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(T.path_terms(F.col("url"))), " ").alias("terms"))


_ALPHA = f"list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 2 and regexp_full_match(t, '[a-z]+') and t not in ({_STOP}))"


@query(f"select doc_id, len(w) as n_words, len(list_distinct(w)) as n_distinct from (select doc_id, {_ALPHA} as w from documents)")
def alpha_words(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", T.alphabetic_words(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("select count(*) as n_docs, round(avg(length(coalesce(text, ''))), 6) as avg_length, count(*) filter (where coalesce(text, '') = '') as n_empty, count(distinct source) as n_sources from documents")
def collection_metadata(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = cluster.metadata(docs, F.concat("source", F.lit("."), "source"), F.col("text"))
    return found.select("n_docs", _round("avg_length"), "n_empty", F.size("by_extension").cast("long").alias("n_sources"))


# Clusters -------------------------------------------------------------------------------------------

_PARTS = "parts as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as d from embeddings)"
_CENTERS = f"{_PARTS}, means as (select label, d, avg(x) as m from parts group by all)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


@query("select label, count(*) as n_docs from embeddings group by label")
def cluster_distribution(spark, sf_dir):
    return cluster.distribution(_vectors(spark, sf_dir))


@query(f"with {_CENTERS} select label, cast(d as int) as d, round(m, 6) as mean from means")
def cluster_centroids(spark, sf_dir):
    return cluster.centroids(_vectors(spark, sf_dir)).select("label", F.posexplode("centroid").alias("d", "mean")).select("label", "d", _round("mean"))


@query(
    f"""with {_CENTERS}, dist as (select vec_id, m.label, sum((x - m) * (x - m)) as s from parts p join means m using (d) group by vec_id, m.label)
select vec_id as id, arg_min(label, s) as cluster, round(min(s), 6) as distance from dist group by vec_id"""
)
def nearest_centroid(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return cluster.nearest(vectors, cluster.centroids(vectors)).select("id", "cluster", _round("distance"))


@query(f"with {_PARTS} select round(sum(v), 6) as total_variance from (select var_pop(x) as v from parts group by d)")
def total_variance(spark, sf_dir):
    return cluster.total_variance(_vectors(spark, sf_dir)).select(_round("total_variance"))


_SILHOUETTE = """own as (select a, avg(s) as own from pairs where la = lb group by a), other as (select a, min(s) as other from (select a, lb, avg(s) as s from pairs where la <> lb group by a, lb) group by a)
select round(avg(case when own is null or other is null then 0.0 else (other - own) / greatest(own, other) end), {}) as silhouette from (select distinct a from pairs) left join own using (a) left join other using (a)"""
_DISTANCES = "pairs as (select a.vec_id as a, a.label as la, b.label as lb, {} as s from embeddings a join embeddings b on a.vec_id <> b.vec_id)"
_SQUARED = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) ** 2))"


@query("with " + _DISTANCES.format(f"sqrt({_SQUARED})") + ", " + _SILHOUETTE.format(5))
def silhouette_euclidean(spark, sf_dir):
    return cluster.silhouette_euclidean(_vectors(spark, sf_dir)).select(_round("silhouette", 5))


@query("with " + _DISTANCES.format(_SQUARED) + ", " + _SILHOUETTE.format(5))
def silhouette_squared(spark, sf_dir):
    return cluster.silhouette_squared(_vectors(spark, sf_dir)).select(_round("silhouette", 5))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::double * p[2]::double))"


@query(
    f"""with scored as (select q.vec_id as query_id, v.vec_id as id, {_DOT.format('v.embedding', 'q.embedding')} / sqrt({_DOT.format('v.embedding', 'v.embedding')} * {_DOT.format('q.embedding', 'q.embedding')}) as cosine
  from embeddings v join embeddings q on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id)
select query_id, id, round(cosine, 6) as cosine, row_number() over (partition by query_id order by round(cosine, 9) desc, id) as rank from scored qualify rank <= 5"""
)
def cosine_topk(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    found = cluster.most_similar(vectors, vectors.filter("id % 100 = 0"))
    return found.select("query_id", "id", _round("cosine"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""with words as (select source as cluster, unnest({_ALPHA}) as term from documents), counted as (select cluster, term, count(*) as n from words group by all),
totals as (select cluster, sum(n) as total from counted group by cluster), every as (select term, sum(n) as an from counted group by term)
select cluster, term, n, round(n / total, 9) as tf, round((an - n) / ((select sum(n) from counted) - total), 9) as other_tf,
  row_number() over (partition by cluster order by n desc, term) as place from counted join totals using (cluster) join every using (term) qualify place <= 50"""
)
def keyword_scores_tf(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cluster"), F.concat(F.lit("/"), "source").alias("path"), "text")
    found = cluster.term_scores(docs).filter(F.col("place") <= cluster.SCORED)
    return found.select("cluster", "term", "n", _round("tf", 9), _round("other_tf", 9), F.col("place").cast("long").alias("place"))


def _words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents")
    tokens = docs.select("doc_id", F.filter(T.embedding_tokens(F.coalesce("text", F.lit(""))), lambda t: ~t.isin(list(T.STOPWORDS))).alias("tokens"))
    tokens = cluster.stored_tokens(tokens)
    return tokens, cluster.word_vectors(tokens, dimensions=32)


@query()
def word2vec_docs(spark, sf_dir):
    found = cluster.document_vectors(*_words(spark, sf_dir))
    return found.select("id", F.size("vector").alias("dimensions"), F.round(S.dot(F.col("vector"), F.col("vector")), 6).alias("squared_norm"))


@query()
def kmeans_k(spark, sf_dir):
    vectors = _vectors(spark, sf_dir).select("id", "vector")
    return cluster.distribution(cluster.kmeans(vectors, cluster.choose_k(vectors)))


@query()
def cluster_keywords(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cluster"), F.concat(F.lit("/"), "source").alias("path"), "text")
    found = cluster.keywords(cluster.term_scores(docs), _words(spark, sf_dir)[1])
    return found.select("cluster", F.array_join("keywords", " ").alias("keywords"))


@query()
def browsable_structure(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit(None).cast("string").alias("url"), "text")
    return pipeline.clustered(spark, docs).groupBy("cluster", "name", "size").agg(F.count("*").alias("n_documents"), F.count_if(F.col("preview") != "").alias("n_previews"))


@query()
def build_and_search(spark, sf_dir):
    collection = pipeline.build(spark, _table(spark, sf_dir, "pages"), tolerance=1e-4)
    return pipeline.search_collection(spark, collection, "thonon tion").select("page_id", "rank", _round("score"))


# Task state: users as tasks -------------------------------------------------------------------------

_LATEST = "latest as (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def _state_tables(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tasks, index and clustering rows: the latest signup or view, purchase or error, and click or signup of each user."""

    def last(*types: str) -> DataFrame:
        return tasks.latest(events.filter(F.col("event_type").isin(*types)), ["user_id"], "ts", "event_id")

    status = lambda good: F.when(F.col("event_type") == good, "completed").otherwise("running").alias("status")
    return (
        last("signup", "view").select(F.col("user_id").alias("task_id"), status("signup"), F.col("event_id").alias("processed_files")),
        last("purchase", "error").select(F.col("user_id").alias("task_id"), status("purchase"), (F.col("event_id") % 2).alias("processed_files")),
        last("click", "signup").select(F.col("user_id").alias("task_id"), status("click")),
    )


_STATES = """t as (select user_id as task_id, case when event_type = 'signup' then 'completed' else 'running' end as status, event_id as files from events where event_type in ('signup', 'view') qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
i as (select user_id as task_id, case when event_type = 'purchase' then 'completed' else 'running' end as status, event_id % 2 as files from events where event_type in ('purchase', 'error') qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1),
c as (select user_id as task_id, case when event_type = 'click' then 'completed' else 'running' end as status from events where event_type in ('click', 'signup') qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"""


@query(f"with {_LATEST} select user_id, event_id, event_type, round(value, 6) as value from latest")
def task_latest_status(spark, sf_dir):
    return tasks.latest(_events(spark, sf_dir), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type", _round("value"))


@query(
    """select user_id, count(*) as pages, round(avg(value), 2) as average_size, round(sum(value), 2) as total_size, round(round(avg(value), 2) * count(*) / 60, 2) as minutes_1,
  round(round(avg(value), 2) * count(*) / 60 / 5, 2) as minutes_5, round(round(avg(value), 2) * count(*) / 60 / 10, 2) as minutes_10 from events group by user_id"""
)
def task_metrics(spark, sf_dir):
    return tasks.metrics(_events(spark, sf_dir), "value", "value", "user_id").drop("average_seconds")


@query(
    """with o as (select user_id, case event_type when 'purchase' then 'successful' when 'error' then 'failed' when 'click' then 'skipped' else 'open' end as outcome from events)
select user_id, count(*) as total, count(*) filter (where outcome = 'successful') as successful, count(*) filter (where outcome = 'failed') as failed, count(*) filter (where outcome = 'skipped') as skipped,
  round(count(*) filter (where outcome <> 'open') * 100.0::double / count(*), 2) as progress_percentage, round(count(*) filter (where outcome = 'successful') * 100.0::double / count(*), 2) as success_rate from o group by user_id"""
)
def task_progress(spark, sf_dir):
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "successful").when(kind == "error", "failed").when(kind == "click", "skipped").otherwise("open")
    return tasks.progress(_events(spark, sf_dir).withColumn("outcome", outcome), "outcome", "user_id")


@query(
    f"""with {_STATES} select task_id, case when i.status is null and coalesce(t.status, '') <> 'completed' then 'downloading' when i.status is null or i.status <> 'completed' then 'indexing'
  when c.status = 'completed' then 'completed' else 'clustering' end as state, case when coalesce(i.files, 0) = 0 then t.files else i.files end as processed_files
from t full join i using (task_id) left join c using (task_id)"""
)
def pipeline_state(spark, sf_dir):
    return tasks.pipeline_state(*_state_tables(_events(spark, sf_dir)))


@query("select user_id, event_type, count(*) as n, max(event_id) as last_event from events where user_id = 7 group by all")
def status_by_key(spark, sf_dir):
    found = _events(spark, sf_dir).filter("user_id = 7")
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query(f"with {_LATEST} select user_id, event_id, (select min(e.event_id) from events e where e.user_id = latest.user_id and e.ts = (select min(f.ts) from events f where f.user_id = latest.user_id)) as created_event from latest")
def index_listing(spark, sf_dir):
    events = _events(spark, sf_dir)
    first = events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("created_event"))
    rows = tasks.latest(events, ["user_id"], "ts", "event_id").select(F.col("user_id").alias("task_id"), "event_id", F.col("ts").alias("created_at"))
    return tasks.index_listing(rows).join(first.withColumnRenamed("user_id", "task_id"), "task_id").select(F.col("task_id").alias("user_id"), "event_id", "created_event")


@query(f"with {_LATEST} select event_type, count(*) as n from events where user_id not in (select user_id from latest where event_type = 'error') group by event_type")
def cascading_delete(spark, sf_dir):
    events = _events(spark, sf_dir)
    left = tasks.deleted({"events": events}, tasks.latest(events, ["user_id"], "ts", "event_id").filter("event_type = 'error'").select("user_id"), "user_id")["events"]
    return left.groupBy("event_type").agg(F.count("*").alias("n"))


@query("select c_custkey, max(kind) as kind from (select c_custkey, 'old' as kind from customer where c_acctbal >= 0 union all select c_custkey, 'new' from customer where c_acctbal < 0) group by c_custkey")
def insert_if_absent(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    old = customer.filter("c_acctbal >= 0").select("c_custkey", F.lit("old").alias("kind"))
    return tasks.inserted_if_absent(old, customer.select("c_custkey", F.lit("new").alias("kind")), ["c_custkey"])


@query("with d as (select c_custkey, c_acctbal from customer where c_acctbal < 0) select s_suppkey, coalesce(abs(d.c_acctbal), s_acctbal) as s_acctbal from supplier left join d on c_custkey = s_suppkey")
def update_existing(spark, sf_dir):
    changes = _table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("s_suppkey"), F.abs("c_acctbal").alias("s_acctbal"))
    return tasks.updated(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), changes, ["s_suppkey"])


@query("select user_id, coalesce(sum(cast(json_extract(props, '$.k') as bigint)), 0) as k_sum, count(*) filter (where json_extract(props, '$.k') is not null) as n_k from events group by user_id")
def json_roundtrip(spark, sf_dir):
    parsed = _events(spark, sf_dir).select("user_id", F.from_json("props", "k long").alias("p"))
    again = parsed.select("user_id", F.from_json(F.to_json("p"), "k long")["k"].alias("k"))
    return again.groupBy("user_id").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k_sum"), F.count("k").alias("n_k"))


@query(f"with {_STATES} select t.task_id, t.status, t.files as pages_found, coalesce(i.files, 0) as downloaded_pages, coalesce(i.status = 'completed', false) as is_completed from t left join i using (task_id)")
def nested_projection(spark, sf_dir):
    t, i, _ = _state_tables(_events(spark, sf_dir))
    nothing = F.lit(None).cast("string")
    rows = t.select(
        "task_id", "status", nothing.alias("message"), nothing.alias("output_dir"), nothing.alias("webpage_graph_file"), F.lit(False).alias("is_completed"), F.array().cast("array<string>").alias("visited_urls"), F.array().cast("array<string>").alias("downloaded_urls")
    )
    analysis = t.select("task_id", F.col("processed_files").alias("pages_found"), F.lit(0.0).alias("total_size_kb"), F.lit(None).cast("timestamp").alias("completion_time"))
    zero = F.lit(0).cast("long")
    downloads = i.select(
        "task_id", zero.alias("total_pages"), F.col("processed_files").alias("downloaded_pages"), *(zero.alias(c) for c in ("successful_downloads", "failed_downloads", "skipped_downloads")), F.lit(0.0).alias("progress_percentage"), (F.col("status") == "completed").alias("is_completed")
    )
    seen = tasks.selected_status(tasks.scraping_status(rows, analysis, downloads))
    return seen.select("task_id", "status", F.col("analysis.pages_found").alias("pages_found"), F.col("download.downloaded_pages").alias("downloaded_pages"), F.col("download.is_completed").alias("is_completed"))


@query("select origin, count(*) as n_pages from (select regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as origin from pages) group by origin")
def origins(spark, sf_dir):
    return pipeline.origins(_table(spark, sf_dir, "pages"))
