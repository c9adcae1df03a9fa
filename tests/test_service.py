import pytest
from pyspark.sql import functions as F

from inkstone.functions import nested, times
from inkstone.plans import service
from inkstone.streaming import log

ROOT = "http://a.org"


def _pages(spark):
    words = ["spark tables shuffle joins and plans", "garden tomato soil water and seeds"]
    rows = [(0, ROOT, "<title>Home</title><p>start page about everything here</p>" + "".join(f'<a href="/p{k}">page {k}</a>' for k in range(12)))]
    rows += [(k + 1, f"{ROOT}/p{k}", f"<title>Page {k}</title><p>{words[k % 2]} number{k} {words[k % 2]}. More about it.</p>") for k in range(12)]
    return spark.createDataFrame([*rows, (99, "http://b.org/x", "<p>elsewhere</p>")], "page_id long, url string, html string")


def test_a_task_from_start_to_deletion(spark, tmp_path):
    store = service.Store(spark, str(tmp_path))
    task, new = service.start(store, ROOT + "/")
    assert new and service.start(store, ROOT) == (task, False)
    assert service.status(store, task) == "downloading" and service.status(store, "other") is None
    with pytest.raises(LookupError):
        service.search_text(store, task, "tomato")
    service.run(store, task, _pages(spark), tolerance=1e-3, clusters=3)
    assert service.status(store, task) == "completed"
    answer, pages = service.search_url(store, ROOT, "tomatto soil!", k=3)
    assert answer.suggested_query == "tomato soil" and all("tomato" in r["content"] for r in pages.collect())
    assert service.indexes(store).count() == 1
    row = service.index_status_by_url(store, ROOT).first()
    assert row["index_exists"] and row["index"]["processed_files"] == 13
    detail = service.index_detail(store, task)
    assert detail["graph/nodes"].count() == 13 and detail["clusters"].count() == 13
    assert service.previews(store, task).filter("preview = ''").count() == 0
    with pytest.raises(ValueError):
        service.search_text(store, task, "  ")
    service.kill(store, task)
    assert service.status(store, task) is None and not (tmp_path / "data" / task).exists()
    assert service.start(store, ROOT)[1]


def test_a_failed_stage_leaves_its_reason(spark, tmp_path):
    store = service.Store(spark, str(tmp_path))
    task, _ = service.start(store, "http://nowhere.org")
    with pytest.raises(Exception):
        service.run(store, task, spark.createDataFrame([(1, None, None)], "page_id long, url string, html int"))
    failed = [r["status"] for name in ("tasks", "text_index", "clustering") for r in store.state(name).collect()]
    assert "failed" in failed


def test_times_and_nested_values(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    at = times.from_epoch(F.lit(1700000000.5))
    assert value(times.formatted(at)) == "2023-11-14 22:13:20" and value(times.iso(at)) == "2023-11-14T22:13:20.500000"
    assert value(times.elapsed(times.from_epoch(F.lit(10)), times.from_epoch(F.lit(12.5)))) == 2.5 and value(times.to_epoch(at)) == 1700000000.5
    struct = F.struct(F.struct(F.lit(1).alias("b"), F.lit(2).alias("c")).alias("a"))
    assert value(nested.with_field(struct, "a.b", F.lit(9)))["a"].asDict() == {"b": 9, "c": 2}
    m = nested.merged(F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2)), F.create_map(F.lit("y"), F.lit(3)))
    assert value(m) == {"x": 1, "y": 3} and value(nested.get(m, "z", F.lit(7))) == 7
    assert [value(nested.decoded_array(F.lit(t))) for t in (None, "", "[", '["a"]')] == [[], [], [], ["a"]]
    assert value(nested.encoded(F.array(F.lit(1)))) == "[1]"


def test_listener(spark):
    listener = log.listen(spark)
    spark.streams.removeListener(listener)
