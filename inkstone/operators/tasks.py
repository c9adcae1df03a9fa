"""Task state as append-only logs: latest rows, status queries, listings and deletions.

Parquet has no in-place update, so a table is a log of rows with a time; its state is the
latest row of each key, and ``compacted`` rewrites it as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS, _NUMBERS = T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())


def _table(key: tuple[str, ...], **columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name not in key) for name, kind in columns.items()])


_S, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

#: The six tables of task state.
SCHEMAS: dict[str, T.StructType] = {
    "tasks": _table(
        ("task_id",), task_id=_S, domain=_S, base_path=_S, output_dir=_S, visited_urls=_TEXTS, page_sizes=_NUMBERS, request_times=_NUMBERS, downloaded_files=_TEXTS, downloaded_urls=_TEXTS,
        status=_S, message=_S, webpage_graph_file=_S, start_time=_TS, is_completed=_B, completion_time=_TS,
    ),
    "analysis": _table(("task_id",), task_id=_S, pages_found=_I, urls_in_queue=_I, average_page_size=_D, total_size_kb=_D, average_request_time=_D, start_time=_TS, completion_time=_TS),
    "downloads": _table(
        ("task_id",), task_id=_S, total_pages=_I, downloaded_pages=_I, successful_downloads=_I, failed_downloads=_I, skipped_downloads=_I, current_batch=_TEXTS, failed_urls=_TEXTS,
        progress_percentage=_D, start_time=_TS, completion_time=_TS, is_completed=_B,
    ),
    "text_index": _table(
        ("task_id", "docs_dir", "index_path", "status", "created_at", "updated_at"), task_id=_S, docs_dir=_S, index_path=_S, status=_S, message=_S, total_files=_I, processed_files=_I, failed_files=_I,
        progress_percentage=_D, current_file=_S, start_time=_TS, completion_time=_TS, created_at=_TS, updated_at=_TS, is_completed=_B, error=_S, scraping_url=_S,
    ),
    "clustering": _table(("task_id",), task_id=_S, status=_S, num_clusters=_I, cluster_structure_path=_S, metadata_path=_S, model_path=_S, summary_path=_S, error_message=_S, start_time=_TS, completion_time=_TS),
    "cluster_details": _table(("cluster_id", "task_id"), cluster_id=_S, task_id=_S, cluster_name=_S, size=_I, keywords=_TEXTS, document_paths=_TEXTS, document_urls=_TEXTS),
}


def latest(log: DataFrame, keys: list[str], at: str, *ties: str) -> DataFrame:
    """The row of each key with the greatest time, then the greatest ``ties``.

    An aggregate of one struct per key, so partial maxima are formed before the shuffle and
    a key with most of the rows needs no more room than any other.
    """
    rest = [c for c in log.columns if c not in {at, *ties, *keys}]
    row = F.max(F.struct(at, *ties, F.struct(*rest).alias("rest")) if rest else F.struct(at, *ties)).alias("row")
    picked = log.groupBy(*keys).agg(row)
    columns = [F.col(c) if c in keys else F.col(f"row.{c}") if c in {at, *ties} else F.col(f"row.rest.{c}") for c in log.columns]
    return picked.select(*columns)


def compacted(log: DataFrame, keys: list[str], at: str, created: str | None = None) -> DataFrame:
    """The latest row of each key; with ``created``, that column is the key's first time, whatever later rows say."""
    rows = latest(log, keys, at)
    if created is None:
        return rows
    first = log.groupBy(*keys).agg(F.min(created).alias("__first"))
    return rows.drop(created).join(first, keys).withColumnRenamed("__first", created).select(*log.columns)


def inserted_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose key it doesn't have."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def updated(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the non-null values of ``changes`` (one row per key) put in; keys that it lacks change nothing."""
    names = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in names))
    return table.join(renamed, keys, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in table.columns))


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with all rows of the keys in ``rows`` replaced by them."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows)


def deleted(tables: dict[str, DataFrame], ids: DataFrame, key: str = "task_id") -> dict[str, DataFrame]:
    """Every table without the rows of some keys."""
    gone = ids.select(key).distinct()
    return {name: table.join(gone, key, "left_anti").select(*table.columns) for name, table in tables.items()}


def restarted(clustering: DataFrame, ids: DataFrame, now: Column, status: str = "processing") -> DataFrame:
    """clustering with the tasks of ids (task_id) started again: their end and error are forgotten, new tasks are added."""
    begun = ids.select("task_id").distinct().select("task_id", F.lit(status).alias("status"), now.alias("start_time"))
    blank = begun.select(*(F.col(f.name) if f.name in begun.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in clustering.schema))
    old = clustering.join(begun.select("task_id", F.lit(True).alias("again")), "task_id", "left")
    new = {"status": F.lit(status), "start_time": now, "completion_time": F.lit(None), "error_message": F.lit(None)}
    kept = old.select(*(F.when(F.col("again"), new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in clustering.schema))
    return inserted_if_absent(kept, blank, ["task_id"])


def completion(status: Column, now: Column, before: Column) -> Column:
    """A completion time that is set only by the status completed."""
    return F.when(status == "completed", now).otherwise(before)


def by_url(tasks: DataFrame, url: str) -> DataFrame:
    """The first task (by id) of an address."""
    return tasks.filter(F.col("base_path") == F.lit(url)).orderBy("task_id").limit(1)


def scraping_status(tasks: DataFrame, analysis: DataFrame, downloads: DataFrame) -> DataFrame:
    """One nested row per task; processed_files is the number of distinct addresses visited."""
    a = analysis.select("task_id", F.struct(*[c for c in analysis.columns if c != "task_id"]).alias("analysis"))
    d = downloads.select("task_id", F.struct(*[c for c in downloads.columns if c != "task_id"]).alias("download"))
    joined = tasks.join(a, "task_id", "left").join(d, "task_id", "left")
    return joined.withColumn("processed_files", F.size(F.array_distinct(F.coalesce("visited_urls", F.array().cast("array<string>")))))


def selected_status(status: DataFrame) -> DataFrame:
    """The fields of a scraping status that callers see, with defaults."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return status.select(
        "task_id",
        "status",
        "message",
        F.col("output_dir").alias("data_location"),
        "webpage_graph_file",
        "is_completed",
        F.coalesce("downloaded_urls", F.array().cast("array<string>")).alias("downloaded_urls"),
        F.struct(*(zero(f"analysis.{c}").alias(c) for c in ("pages_found", "total_size_kb")), F.col("analysis.completion_time")).alias("analysis"),
        F.struct(
            *(zero(f"download.{c}").alias(c) for c in ("total_pages", "downloaded_pages", "successful_downloads", "failed_downloads", "skipped_downloads", "progress_percentage")),
            F.coalesce("download.is_completed", F.lit(False)).alias("is_completed"),
        ).alias("download"),
    )


def selected_index_status(index: DataFrame) -> DataFrame:
    """An index status regrouped as index_info, progress and timing."""
    return index.select(
        "task_id",
        "status",
        "message",
        F.struct("docs_dir", "index_path").alias("index_info"),
        F.struct("total_files", "processed_files", "failed_files", F.round(F.coalesce("progress_percentage", F.lit(0.0)), 2).alias("progress_percentage"), "current_file").alias("progress"),
        F.struct("start_time", "completion_time", "created_at", "updated_at").alias("timing"),
        F.coalesce("is_completed", F.lit(False)).alias("is_completed"),
        "error",
    )


def index_listing(index: DataFrame) -> DataFrame:
    return index.orderBy(F.desc("created_at"), "task_id")


def clustering_info(clustering: DataFrame, details: DataFrame) -> DataFrame:
    """Each clustering with the array of its clusters, empty where it has none."""
    entry = F.struct(*[c for c in details.columns if c != "task_id"])
    nested = details.groupBy("task_id").agg(F.array_sort(F.collect_list(entry)).alias("clusters"))
    return clustering.join(nested, "task_id", "left").withColumn("clusters", F.coalesce("clusters", F.array().cast(nested.schema["clusters"].dataType)))


def pipeline_state(tasks: DataFrame, index: DataFrame, clustering: DataFrame) -> DataFrame:
    """task_id, state, processed_files.

    tasks: task_id, status, processed_files; index: task_id, status, processed_files;
    clustering: task_id, status.  downloading, indexing, clustering or completed; a task
    that has neither row doesn't show.
    """
    t = tasks.select("task_id", F.col("status").alias("task_status"), F.col("processed_files").alias("task_files"))
    i = index.select("task_id", F.col("status").alias("index_status"), F.col("processed_files").alias("index_files"))
    c = clustering.select("task_id", F.col("status").alias("cluster_status"))
    joined = t.join(i, "task_id", "full").join(c, "task_id", "left")
    done = lambda name: F.coalesce(F.col(name) == "completed", F.lit(False))
    state = (
        F.when(F.col("index_status").isNull() & ~done("task_status"), "downloading")
        .when(F.col("index_status").isNull() | ~done("index_status"), "indexing")
        .when(done("cluster_status"), "completed")
        .otherwise("clustering")
    )
    files = F.when(F.coalesce("index_files", F.lit(0)) == 0, F.col("task_files")).otherwise(F.col("index_files"))
    return joined.select("task_id", state.alias("state"), files.alias("processed_files"))


def metrics(rows: DataFrame, size: str, seconds: str, *by: str) -> DataFrame:
    """Pages, mean and total size and mean time, rounded to 2, and estimated minutes with 1, 5 and 10 workers."""
    average = F.round(F.coalesce(F.avg(seconds), F.lit(0.0)), 2)
    grouped = rows.groupBy(*by).agg(
        F.count("*").alias("pages"), F.round(F.coalesce(F.avg(size), F.lit(0.0)), 2).alias("average_size"), F.round(F.coalesce(F.sum(size), F.lit(0.0)), 2).alias("total_size"), average.alias("average_seconds")
    )
    minutes = F.col("average_seconds") * F.col("pages") / 60
    return grouped.select("*", *(F.round(minutes / n, 2).alias(f"minutes_{n}") for n in (1, 5, 10)))


def report(rows: DataFrame, url: str, size: str, seconds: str, *by: str) -> DataFrame:
    """``metrics`` with the sorted distinct addresses of a task's pages."""
    return metrics(rows, size, seconds, *by).join(rows.groupBy(*by).agg(F.array_sort(F.collect_set(url)).alias("urls")), list(by))


def progress(rows: DataFrame, outcome: str, *by: str) -> DataFrame:
    """Counts of outcomes successful, failed and skipped, progress and success rate in percent."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col(outcome) == name).alias(name) for name in ("successful", "failed", "skipped")))
    done = F.col("successful") + F.col("failed") + F.col("skipped")
    percent = lambda part: F.round(F.coalesce(F.try_divide(part * 100.0, F.col("total")), F.lit(0.0)), 2)
    return counts.select("*", percent(done).alias("progress_percentage"), percent(F.col("successful")).alias("success_rate"))
