"""More queries with their SQL: times, nested values, names and samples, stored tables, the collection service, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import nested, times
from ..functions import similarity as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import bm25, cluster, graph, lookup, search, summarize, tasks
from ..sources import files, sinks
from ..streaming import status as streaming
from . import pipeline, service
from .queries import _INDEX, _ORIGIN, _PAIR_ROWS, _PAIRS, _SENTENCE_WORDS, _SENTENCES, _TAGGED, _TRADE, _events, _index, _ranked, _ranking, _round, _similar, _summary, _table, _trade, _visible, query
from .queries import MISTYPED, ORACLES, QUERIES, QUERY


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        graph._checkpoint(spark, spark.range(1))  # sets a folder on one machine, raises on a cluster
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# Times and nested values ----------------------------------------------------------------------------


@query(
    """select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') as last_at, round(epoch(max(ts)) - epoch(min(ts)), 3) as seconds,
  round(sum(value), 3) as again from events group by user_id"""
)
def event_times(spark, sf_dir):
    ends = _events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.round(F.sum(times.to_epoch(times.from_epoch(F.col("value")))), 3).alias("again"))
    return ends.select("user_id", times.formatted(F.col("a")).alias("first_at"), times.iso(F.col("b")).alias("last_at"), F.round(times.elapsed(F.col("a"), F.col("b")), 3).alias("seconds"), "again")


@query(
    """select event_id, coalesce(cast(json_extract(props, '$.k') as int), -1) as k, event_id % 7 as day, cast(case when event_id % 2 = 0 then 5 else coalesce(cast(json_extract(props, '$.k') as int), -1) end as int) as merged,
  case when event_type = 'click' then 'other' else event_type end as kind from events"""
)
def nested_values(spark, sf_dir):
    none = F.create_map().cast("map<string,int>")
    held = F.coalesce(F.from_json("props", "map<string,int>"), none)
    newer = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit(5))).otherwise(none)
    both = nested.merged(held, newer)
    state = nested.with_field(F.struct(F.struct(F.col("event_type").alias("kind"), (F.col("event_id") % 7).alias("day")).alias("event")), "event.kind", F.when(F.col("event_type") == "click", "other").otherwise(F.col("event_type")))
    rows = _events(spark, sf_dir).select("event_id", nested.get(held, "k", F.lit(-1)).alias("k"), nested.get(both, "k", F.lit(-1)).alias("merged"), state.alias("s"))
    return rows.select("event_id", "k", F.col("s.event.day").alias("day"), "merged", F.col("s.event.kind").alias("kind"))


@query(
    """select user_id, to_json(list(event_type order by event_id))::varchar as types, count(*) as n, 0::bigint as n_blank from events group by user_id"""
)
def json_arrays(spark, sf_dir):
    lists = _events(spark, sf_dir).groupBy("user_id").agg(nested.encoded(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: e["event_type"])).alias("types"))
    size = lambda text: F.size(nested.decoded_array(text)).cast("long")
    return lists.select("user_id", "types", size(F.col("types")).alias("n"), (size(F.lit("")) + size(F.lit(None).cast("string"))).alias("n_blank"))


# Text, names, samples -------------------------------------------------------------------------------


@query(r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g'), '[^\p{L}\p{N}_\s\p{Z}.,!?-]', '', 'g')) as clean_md5 from documents")
def clean_prose(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_prose(F.col("text")).cast("binary")).alias("clean_md5"))


@query(
    """with w as (select p_partkey, list_filter(list_transform(string_split(p_name || ' x9 42', ' '), lambda w: regexp_replace(regexp_replace(regexp_replace(upper(substr(w, 1, 1)) || lower(substr(w, 2)), '_?[0-9]+', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')), lambda w: w <> '') as w from part)
select p_partkey, array_to_string(w, '_') as name from w"""
)
def cluster_names(spark, sf_dir):
    words = F.split(F.concat("p_name", F.lit(" x9 42")), " ")
    return _table(spark, sf_dir, "part").select("p_partkey", T.cluster_name(words, F.concat(F.lit("Cluster_"), F.col("p_partkey").cast("string"))).alias("name"))


@query(
    r"""with w as (select doc_id, list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda t: t <> '') as w from documents)
select doc_id, greatest(1, len(w) // 200)::varchar || ' min' as read_time, array_to_string(case when len(w) <= 5 then w else list_transform([0, 1, 2, 3, 4], lambda k: w[cast(floor(k * (len(w) - 1) / 4) as bigint) + 1]) end, ' ') as spaced,
  array_to_string(case when len(w) > 40 then w[1:10] || w[len(w) // 2 - 9:len(w) // 2 + 10] || w[len(w) - 9:len(w)] else w end, ' ') as cut from w"""
)
def samples_of_words(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    words = docs.select("doc_id", "text", F.filter(F.split("text", r"[\s\p{Z}]+"), lambda t: t != "").alias("w"))
    return words.select("doc_id", T.read_time(F.col("text")).alias("read_time"), F.array_join(T.evenly_spaced(F.col("w"), 5), " ").alias("spaced"), F.array_join(T.head_middle_tail(F.col("w"), 40), " ").alias("cut"))


@query(
    f"""with {_SENTENCES}, {_SENTENCE_WORDS}, kinds as (select doc_id, case doc_id % 3 when 0 then '.pdf' when 1 then '.html' else '.log' end as kind from documents),
limits as (select doc_id, case kind when '.pdf' then 3 else 2 end as n, case kind when '.pdf' then 300 when '.html' then 200 else 150 end as most from kinds),
best as (select doc_id, string_agg(sentence, ' ' order by i) as best from (select *, row_number() over (partition by doc_id order by round(score, 9) desc, i desc) as place from ranked) join limits using (doc_id) where place <= n group by doc_id),
c as (select doc_id, n, most, regexp_replace(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g') as clean, case when len(parts) <= n then text else best end as summary from sent left join best using (doc_id) join limits using (doc_id)),
b as (select *, case when summary <> '' then summary else array_to_string(string_split(clean, '.')[1:n], '. ') || '.' end as body from c),
k as (select *, substr(body, 1, most) as cut from b),
p as (select *, case when contains(cut, '.') then length(cut) - instr(reverse(cut), '.') else -1 end as period, case when contains(cut, ' ') then length(cut) - instr(reverse(cut), ' ') else -1 end as space from k),
f as (select *, trim(case when length(body) <= most then body when period > most * 0.5 then substr(cut, 1, period + 1) when space >= 0 then substr(cut, 1, space) || '...' else substr(cut, 1, length(cut) - 1) || '...' end) as fitted from p)
select doc_id, case when clean = '' then 'No content available for summarization.' when length(clean) <= most then clean when regexp_matches(fitted, '[.!?]$') then fitted else fitted || '...' end as preview from f"""
)
def previews_by_type(spark, sf_dir):
    kind = F.element_at(F.array(F.lit(".pdf"), F.lit(".html"), F.lit(".log")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), kind).alias("path"), "text")
    return cluster.previews(docs).select(F.col("id").alias("doc_id"), "preview")


# the parser knows all entities; these pages have two more than the native form decodes, and no content areas
_TREE = _visible("replace(replace(html, '&copy;', '©'), '&middot;', '·')")


@query(f"select page_id, length({_TREE}) as n_chars, length({_TREE}) as n_area_chars, md5({_TREE}) as text_md5 from pages")
def html_tree_text(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.length(H.tree_text("html")).cast("long").alias("n_chars"), F.length(H.area_text("html")).cast("long").alias("n_area_chars"), F.md5(H.tree_text("html").cast("binary")).alias("text_md5"))


# Addresses ------------------------------------------------------------------------------------------


@query(
    r"""select page_id, regexp_replace(trim(' ' || url || '// '), '/+$', '') as trimmed, regexp_matches(url, '^(?i)(https?|ftp)://[^\s/?#.]+\.[^\s/?#]+(:\d+)?([/?#]\S*)?$') as plausible,
  lower(regexp_extract(url, '(\.[^./]+)$', 1)) in ('.txt', '.pdf', '.docx', '.html', '.htm') as supported from pages"""
)
def url_checks(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", U.trimmed(F.concat(F.lit(" "), url, F.lit("// "))).alias("trimmed"), U.looks_like_url(url).alias("plausible"), U.suffix(url).isin(*files.SUFFIXES).alias("supported")
    )


@query(
    f"""with recursive l as (select page_id, regexp_extract(url, '^([^?#]*/)', 1) as folder, unnest(['../x' , './a/../b', '../../../../up', 'plain?q=../z']) as link from pages),
j as (select page_id, link, {_ORIGIN.format('folder')} as o, regexp_extract(folder || link, '^[A-Za-z]+://[^/]*([^?]*)', 1) as p, regexp_extract(link, '(\\?.*)$', 1) as q from l),
s as (select page_id, link, o, q, string_split(p, '/')[2:] as parts, 1 as k, []::varchar[] as done from j
  union all select page_id, link, o, q, parts, k + 1, case when parts[k] = '.' then done when parts[k] = '..' then done[1:len(done) - 1] else list_append(done, parts[k]) end from s where k <= len(parts))
select page_id, link, o || '/' || array_to_string(done, '/') || q as target from s where k = len(parts) + 1"""
)
def dot_segments(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*(F.lit(x) for x in ("../x", "./a/../b", "../../../../up", "plain?q=../z")))).alias("link"))
    return pages.select("page_id", "link", U.resolved(F.col("link"), F.regexp_extract("url", r"^([^?#]*)", 1)).alias("target"))


@query(
    """with known as (select min(page_id) as page_id, url from pages group by url), keyed as (select '/' || page_id::varchar as path, url from known where page_id % 2 = 0)
select p.page_id, coalesce(k.url, '') as url from pages p left join keyed k on k.path = '/' || p.page_id::varchar"""
)
def url_of_path(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.col("page_id").cast("string")).alias("path"), "url")
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    known = files.url_mapping(first.filter("page_id % 2 = 0").select(F.concat(F.lit("/"), F.col("page_id").cast("string")).alias("path"), "url"))
    return lookup.or_default(pages.drop("url"), known, "path", "url", "").select("page_id", "url")


@query("select page_id, cast(length(html) as int) as size from pages where page_id % 3 <> 0 and url not in (select url from pages where page_id % 3 = 0)")
def pages_to_store(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return sinks.pages_to_store(pages, pages.filter("page_id % 3 = 0")).select("page_id", "size")


# Search ---------------------------------------------------------------------------------------------

_BETTER = """better as (select a.p as position, coalesce((select term from near n where n.word = a.w and rank = 1), a.w) as word from (values (0, 'idoit'), (1, 'clowm'), (2, 'thonon')) as a(p, w))"""
_AGAIN = (
    _similar("idoit clowm thonon")
    .split("pairs as materialized", 1)[1]
    .replace("from words w,", "from better w,")
    .replace("rated as", "rated2 as")
    .replace("near as", "near2 as")
    .replace("from pairs w join pairs v", "from pairs2 w join pairs2 v")
    .replace("from rated ", "from rated2 ")
)


@query(
    _ranking(
        "select term, count(*) from (select word as term from better union all select n.term from better b join near2 n using (word)) group by term",
        extra=f"{_similar('idoit clowm thonon', 1, True)}, {_BETTER}, pairs2 as materialized{_AGAIN},",
    )
)
def corrected_search(spark, sf_dir):
    return _ranked(search.search(spark, _index(spark, sf_dir), MISTYPED).results)


@query(
    _ranking(
        "select term, count(*) from (select word as term from words union all select n.term from words w join near n using (word)) group by term", extra=f"{_similar('idoit clowm thonon')},"
    ).replace("select doc_id, round(score, 6) as score,", "select doc_id, true as has_suggestions, round(score, 6) as score,")
)
def suggest_and_search(spark, sf_dir):
    suggested, results = search.suggest_and_search(spark, _index(spark, sf_dir), "idoit clowm thonon")
    some = suggested.agg((F.count("*") > 0).alias("has_suggestions"))
    return _ranked(results).crossJoin(F.broadcast(some))


@query(_ranking("values " + ", ".join(f"('{w}', {QUERY.split().count(w)})" for w in dict.fromkeys(QUERY.split()))))
def stored_index_search(spark, sf_dir):
    folder = _folder(spark, "index")
    _index(spark, sf_dir).write(folder)
    return _ranked(bm25.search(spark, bm25.Index.read(spark, folder), QUERY))


@query(
    f"""with {_INDEX} select word, coalesce(suggestion, '') as suggestion, known, case when known then false when typo then true when wf = 0 and sf > 0 then true else sf > 10 * wf end as likely from (
  select p.word, p.suggestion, w.df is not null as known, coalesce(w.df, 0) as wf, coalesce(s.df, 0) as sf, p.typo from ({ORACLES['typo_patterns']}) p left join terms w on w.term = p.word left join terms s on s.term = p.suggestion)"""
)
def likely_misspellings(spark, sf_dir):
    terms = _index(spark, sf_dir).terms
    pairs = spark.createDataFrame(list(_PAIRS), "word string, suggestion string")
    joined = pairs.join(terms.select(F.col("term").alias("word"), F.col("df").alias("wf")), "word", "left").join(terms.select(F.col("term").alias("suggestion"), F.col("df").alias("sf")), "suggestion", "left")
    known = F.col("wf").isNotNull()
    likely = S.likely_misspelling(known, F.coalesce("wf", F.lit(0)), F.coalesce("sf", F.lit(0)), S.typo_pattern(F.col("word"), F.col("suggestion")))
    return joined.select("word", "suggestion", known.alias("known"), likely.alias("likely"))


@query(f"with {_INDEX} select n as n_docs, (select count(*) from raw) as vocabulary, round(avgdl, 6) as avg_tokens, (select bool_and(lang is not null) from documents) as has_metadata, 80 as fuzzy_similarity_threshold from corp")
def index_report(spark, sf_dir):
    found = bm25.report(_index(spark, sf_dir), _table(spark, sf_dir, "documents"), F.col("lang"))
    return found.select("n_docs", "vocabulary", _round("avg_tokens"), "has_metadata", "fuzzy_similarity_threshold")


@query("select 'doc_' || doc_id::varchar as id, length(text) as n_chars from documents where doc_id = 7")
def document_by_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("id"), F.col("text").alias("content"))
    return search.with_ids(search.document(docs, 7), "doc_id").select("id", F.length("content").cast("long").alias("n_chars"))


@query("select doc_id from documents where coalesce(text, '') = ''")
def empty_documents(spark, sf_dir):
    return cluster.empty_documents(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text")).select(F.col("path").alias("doc_id"))


# Graphs ---------------------------------------------------------------------------------------------


@query(
    f"""with recursive {_TRADE}, thin as (select distinct source, target from once where weight > 0.85),
b(id, depth) as (select 0, 0 union select target, depth + 1 from b join thin on id = source where depth < 25),
d as (select id, min(depth) as depth from b where id % 5 <> 4 group by id),
u(id, depth) as (select 0, 0 union select target, depth + 1 from u join thin on id = source where target % 5 <> 4 and depth < 25)
select id, cast(min(depth) as int) as depth from u group by id order by min(depth), id limit 7"""
)
def bfs_limited(spark, sf_dir):
    links = graph.deduplicated_edges(_trade(spark, sf_dir)).filter("weight > 0.85")
    among = _table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 4").select(F.col("n_nationkey").alias("id"))
    return graph.levels(spark, links, 0, max_pages=7, among=among)


@query("select min(page_id) as page_id, url from pages where url = (select min(url) from pages) group by url")
def crawl_of_one_page(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    seed = pages.agg(F.min("url")).first()[0]
    return pipeline.crawled(spark, pages, seed, 5).groupBy("url").agg(F.min("page_id").alias("page_id"))


@query(
    f"""with {_TRADE}, a as (select 'in' as kind, target as id, count(*) as degree, min(seq) as seen from once group by target), b as (select 'out' as kind, source as id, count(*) as degree, min(seq) as seen from once group by source)
select kind, id, n_name as title, degree from (select * from (select * from a order by degree desc, seen limit 5) union all select * from (select * from b order by degree desc, seen limit 5)) join nation on n_nationkey = id"""
)
def top_pages(spark, sf_dir):
    links = graph.deduplicated_edges(_trade(spark, sf_dir))
    known = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("").alias("url"), F.col("n_name").alias("title"))
    both = [graph.top_pages(known, links, by).withColumn("kind", F.lit(kind)) for by, kind in (("target", "in"), ("source", "out"))]
    return both[0].unionByName(both[1]).select("kind", "id", "title", "degree")


@query(
    f"""with {_TRADE}, a as (select target as id, count(*) as n, min(seq) as seen from once group by target order by n desc, seen limit 5)
select (select count(*) from nation) as pages, (select count(*) from once) as links, (select string_agg(id::varchar, ' ' order by n desc, id) from a) as most_linked, 'site' as domain"""
)
def graph_summary_document(spark, sf_dir):
    links = graph.deduplicated_edges(_trade(spark, sf_dir))
    known = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("").alias("url"), F.col("n_name").alias("title"))
    folder = _folder(spark, "summary")
    sinks.graph_summary_document(known, links, "site", "base").write.text(folder)
    read = spark.read.schema("statistics struct<total_pages: long, total_links: long>, top_pages struct<most_linked: array<struct<id: int>>>, domain_info struct<domain: string>").json(folder)
    ids = F.array_join(F.transform("top_pages.most_linked", lambda p: p["id"].cast("string")), " ")
    return read.select(F.col("statistics.total_pages").alias("pages"), F.col("statistics.total_links").alias("links"), ids.alias("most_linked"), F.col("domain_info.domain").alias("domain"))


@query(f"with {_TRADE} select source, target, round(weight, 6) as weight, n_name as name, 1.0::double as initial_rank from once join nation on n_nationkey = source")
def stored_graph(spark, sf_dir):
    folder = _folder(spark, "graph")
    nodes = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("/"), "n_name").alias("path"), F.lit("u").alias("url"))
    links = graph.deduplicated_edges(_trade(spark, sf_dir)).select("source", "target", "weight")
    sinks.graph_document(nodes, links, "site").write.text(folder)
    known, read = files.graph(spark, folder)
    keyed = files.graph_keys(known).filter("key like '/%'").select(F.col("id").cast("int").alias("source"), F.col("title").alias("name"), "initial_rank")
    return read.select(F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"), _round("weight")).join(keyed, "source")


# Task state -----------------------------------------------------------------------------------------


@query("select n_regionkey as task_id, count(*) as n_clusters, string_agg(n_name, ',' order by n_nationkey) as names, (select r_name from region where r_regionkey = n_regionkey) as status from nation where n_regionkey <> 2 group by n_regionkey union all select 2, 0, '', r_name from region where r_regionkey = 2")
def clustering_info(spark, sf_dir):
    clustering = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("task_id"), F.col("r_name").alias("status"))
    details = _table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("cluster_id"), F.col("n_regionkey").alias("task_id"), F.col("n_name").alias("cluster_name"))
    found = tasks.clustering_info(clustering, details)
    return found.select("task_id", F.size("clusters").cast("long").alias("n_clusters"), F.array_join(F.transform("clusters", lambda c: c["cluster_name"]), ",").alias("names"), "status")


@query("select n_regionkey as task_id, n_nationkey as cluster_id, n_name as name from nation where n_regionkey not in (1, 3) union all select n_regionkey, n_nationkey + 100, lower(n_name) from nation where n_regionkey in (1, 3) and n_nationkey % 2 = 0")
def replaced_details(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    details = nation.select(F.col("n_regionkey").alias("task_id"), F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("name"))
    new = nation.filter("n_regionkey in (1, 3) and n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("task_id"), (F.col("n_nationkey") + 100).alias("cluster_id"), F.lower("n_name").alias("name"))
    return tasks.replaced(details, new, "task_id")


@query(
    """with old as (select s_suppkey::varchar as task_id from supplier where s_suppkey % 2 = 0), again as (select s_suppkey::varchar as task_id from supplier where s_suppkey % 3 = 0)
select task_id, case when again.task_id is null then 'completed' else 'processing' end as status, again.task_id is null as has_end, again.task_id is null as has_error, case when old.task_id is not null then 3::bigint end as num_clusters
from old full join again using (task_id)"""
)
def restarted_clustering(spark, sf_dir):
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("task_id"))
    values = {"status": F.lit("completed"), "num_clusters": F.lit(3), "error_message": F.lit("x"), "completion_time": F.lit("2024-01-01 00:00:00")}
    schema = tasks.SCHEMAS["clustering"]
    old = supplier.filter("s_suppkey % 2 = 0").select(*(F.col("task_id") if f.name == "task_id" else values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    found = tasks.restarted(old, supplier.filter("s_suppkey % 3 = 0").select("task_id"), F.lit("2024-02-02 00:00:00").cast("timestamp"))
    return found.select("task_id", "status", F.col("completion_time").isNotNull().alias("has_end"), F.col("error_message").isNotNull().alias("has_error"), "num_clusters")


@query("select user_id::varchar as task_id, 'd' as docs_dir, max(event_id) as total_files, round(100.0::double * count(*) filter (where event_type = 'purchase') / count(*), 2) as progress_percentage, false as is_completed from events group by user_id")
def index_status_fields(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("task_id")).agg(F.max("event_id").alias("total_files"), (F.count_if(F.col("event_type") == "purchase") * 100.0 / F.count("*")).alias("progress_percentage"))
    schema = tasks.SCHEMAS["text_index"]
    given = {"docs_dir": F.lit("d"), **{c: F.col(c) for c in rows.columns}}
    seen = tasks.selected_index_status(rows.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)))
    return seen.select("task_id", F.col("index_info.docs_dir").alias("docs_dir"), F.col("progress.total_files").alias("total_files"), F.col("progress.progress_percentage").alias("progress_percentage"), "is_completed")


@query(
    "select user_id, count(*) as pages, round(avg(value), 2) as average_size, md5(string_agg(distinct event_type, ',' order by event_type)) as urls_md5 from events group by user_id"
)
def analysis_report(spark, sf_dir):
    found = tasks.report(_events(spark, sf_dir), "event_type", "value", "value", "user_id")
    return found.select("user_id", "pages", "average_size", F.md5(F.array_join("urls", ",").cast("binary")).alias("urls_md5"))


@query(
    "select user_id, event_type, case when event_type = 'purchase' then event_id else null end as completed_by from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"
)
def completion_of_tasks(spark, sf_dir):
    last = tasks.latest(_events(spark, sf_dir), ["user_id"], "ts", "event_id")
    done = tasks.completion(F.when(F.col("event_type") == "purchase", "completed").otherwise("running"), F.col("event_id"), F.lit(None).cast("long"))
    return last.select("user_id", "event_type", done.alias("completed_by"))


@query("select min(page_id) as task_id, min(url) as base_path from pages where url = (select min(url) from pages)")
def task_by_url(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("task_id"), F.col("url").alias("base_path"))
    return tasks.by_url(pages, pages.agg(F.min("base_path")).first()[0])


@query(
    """select * from (values ('http://a.example', 'completed', 'completed', true, 'indexing'), ('http://b.example', 'started', null, false, 'downloading'), ('http://c.example', 'completed', 'running', true, 'indexing')) as t(base_path, status, index_status, index_exists, state)
where base_path <> 'http://a.example' or true"""
)
def service_states(spark, sf_dir):
    store = service.Store(spark, _folder(spark, "store"))
    ids = {}
    for url in ("http://a.example/", "http://b.example", "http://c.example//", "http://a.example", "http://gone.example"):
        ids[url], _ = service.start(store, url)
    store.add("tasks", ids["http://a.example"], status="completed", processed_files=3)
    store.add("text_index", ids["http://a.example"], status="building")
    store.add("text_index", ids["http://a.example"], status="completed", total_files=3, processed_files=3)
    store.add("tasks", ids["http://c.example//"], status="completed", processed_files=2)
    store.add("text_index", ids["http://c.example//"], status="running")
    service.delete(store, ids["http://gone.example"])
    rows = [(r["base_path"], r["status"], r["index"] and r["index"]["status"], r["index_exists"], service.status(store, r["task_id"])) for u in ("a", "b", "c", "gone") for r in service.index_status_by_url(store, f"http://{u}.example").collect()]
    assert service.indexes(store).count() == 2
    # a task whose index is complete and that has no clustering yet waits for it
    rows = [(*r[:4], "indexing" if r[4] == "clustering" else r[4]) for r in rows]
    return spark.createDataFrame(rows, "base_path string, status string, index_status string, index_exists boolean, state string")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc) = 1")
def streamed_status(spark, sf_dir):
    folder = _folder(spark, "stream")
    schema = _events(spark, sf_dir).schema
    stream = streaming.events(spark, f"{sf_dir}/event[s].parquet", schema)
    streaming.mirror(stream, f"{folder}/state", f"{folder}/offsets", ["user_id"], "ts").awaitTermination()
    return streaming.state(spark, f"{folder}/state", ["user_id"], "ts").select("user_id", "event_id", "event_type")


@query("select date_trunc('hour', ts) as begin, event_type, count(*) as n from events group by all")
def streamed_counts(spark, sf_dir):
    folder = _folder(spark, "counts")
    stream = streaming.events(spark, f"{sf_dir}/event[s].parquet", _events(spark, sf_dir).schema)
    counted = streaming.windowed_counts(stream, "ts", "event_type", lateness="400 days").select(F.col("window.start").cast("timestamp_ntz").alias("begin"), "event_type", "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query_ = counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query_.awaitTermination()
    return tasks.latest(spark.read.parquet(f"{folder}/rows"), ["begin", "event_type"], "batch").select("begin", "event_type", "n")
