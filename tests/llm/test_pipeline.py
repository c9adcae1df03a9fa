import corpus_pipeline
from inkstone.llm import decontaminate, neardup, pii, quality

from .conftest import prose, rows


def test_stages_in_order_and_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, small).cache()
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns and docs.schema == before.schema
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] <= sizes[5]
    assert docs.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_decisions_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, small)
    verdict = quality.quality(spark, docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert rows(good, "doc_id") == rows(verdict.filter("kept"), "doc_id")
    single = corpus_pipeline.near_duplicates(spark, good, small)
    assert rows(single, "doc_id") == rows(neardup.near_duplicates(spark, good).filter("kept"), "doc_id")
    clean = corpus_pipeline.decontamination(spark, single, small)
    leaked = decontaminate.overlaps(spark, single, spark.read.parquet(f"{small}/benchmark.parquet"))
    assert {r[0] for r in rows(single, "doc_id")} - {r[0] for r in rows(clean, "doc_id")} == {r[0] for r in rows(leaked, "doc_id")}
    private = corpus_pipeline.personal_data(spark, clean, small)
    assert all(not pii.base_spans(r["text"]) for r in private.collect())
    assert not private.filter("n_chars <> length(text)").count()


def test_run(spark, small):
    found = corpus_pipeline.run(spark, small)
    assert found.count() > 0 and not found.filter("offset + length > 2048").count()


def test_odd_rows(spark, odd, empty, small):
    # by stage: the ids of the rows that stay; nulls and repeats are judged by their own text
    expected = [
        [3, 3, 3, 6, 7, 8, None],  # fewer than 50 words go
        [1, 2, 3, 3, 4, 5, 6, 8, 9, None, None],  # the copies of one text of 3 and 7 leave one row; texts without words stay
        [1, 2, 3, 3, 3, 4, 5, 6, 7, 8, 9, None, None],
        [1, 2, 3, 3, 3, 4, 5, 6, 7, 8, 9, None, None],
    ]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, expected):
        found = stage(spark, odd, small)
        assert found.schema == odd.schema, name
        assert sorted((r["doc_id"] for r in found.collect()), key=lambda i: (i is None, i)) == ids, name
        assert stage(spark, empty, small).count() == 0
    packed = corpus_pipeline.best_fit_packing(spark, odd, small)
    assert packed.filter("piece = 0").count() == odd.count() and not packed.filter("offset + length > 2048").count()
    assert corpus_pipeline.best_fit_packing(spark, empty, small).count() == 0


def test_repeated_and_null_ids(spark, small):
    texts = [prose(80, 1), prose(80, 1), prose(80, 2), prose(80, 3), prose(80, 4), prose(80, 4)]
    docs = spark.createDataFrame(list(zip([1, 1, 1, None, None, 9], texts, range(6))), "doc_id long, text string, extra int")
    assert sorted(r["extra"] for r in corpus_pipeline.quality_rules(spark, docs, small).collect()) == list(range(6))
    single = corpus_pipeline.near_duplicates(spark, docs, small)
    # of two equal rows with id 1 one stays; a text with id 9 and with none stays with its id
    assert single.columns == docs.columns
    assert sorted(r["extra"] for r in single.collect()) in ([0, 2, 3, 5], [1, 2, 3, 5])


def test_a_leak_removes_its_own_row_only(spark, small):
    item = spark.read.parquet(f"{small}/benchmark.parquet").filter("length(text) > 60").orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(1, item, 0), (1, prose(80, 1), 1), (None, item, 2), (None, prose(80, 2), 3)], "doc_id long, text string, extra int")
    assert sorted(r["extra"] for r in corpus_pipeline.decontamination(spark, docs, small).collect()) == [1, 3]
