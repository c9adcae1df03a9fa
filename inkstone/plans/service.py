"""The collection service as functions over a folder: start, run, watch, search and delete tasks.

A store is a folder of append-only Parquet logs (tasks, text_index, clustering) and, per
task, its graph, index, documents and clusters.  States are the latest rows of the logs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as T
from ..operators import bm25, search, summarize, tasks
from ..sources import sinks
from . import pipeline

_LOGS = {
    "tasks": "task_id string, at timestamp, number long, base_path string, status string, message string, processed_files long, deleted boolean",
    "text_index": "task_id string, at timestamp, number long, index_path string, status string, message string, total_files long, processed_files long, created_at timestamp, deleted boolean",
    "clustering": "task_id string, at timestamp, number long, status string, num_clusters long, error_message string, deleted boolean",
}


@dataclass
class Store:
    spark: SparkSession
    folder: str

    def log(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(_LOGS[name]).parquet(f"{self.folder}/{name}")
        except AnalysisException:  # nothing has been written yet
            return self.spark.createDataFrame([], _LOGS[name])

    def state(self, name: str) -> DataFrame:
        """The latest row of each task that isn't deleted; an index keeps its first created_at."""
        rows = tasks.compacted(self.log(name), ["task_id"], "number", "created_at" if name == "text_index" else None)
        return rows.filter("not coalesce(deleted, false)").drop("deleted", "number")

    def add(self, name: str, task_id: str, **values) -> None:
        """Append a row; columns not given keep their latest values."""
        log = self.log(name)
        last = tasks.latest(log.filter(F.col("task_id") == task_id), ["task_id"], "number").first()
        row = (last.asDict() if last and not last["deleted"] else {}) | {"task_id": task_id, "number": (last["number"] if last else 0) + 1, "deleted": False} | values
        schema = log.schema
        frame = self.spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema).withColumn("at", F.current_timestamp())
        if name == "text_index":
            frame = frame.withColumn("created_at", F.coalesce("created_at", "at"))
        frame.coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def path(self, task_id: str, name: str) -> str:
        return f"{self.folder}/data/{task_id}/{name}"


def start(store: Store, url: str) -> tuple[str, bool]:
    """(task id, whether it is new) for an address; one task per address."""
    url = pipeline.validated(url)
    known = tasks.by_url(store.state("tasks"), url).first()
    if known:
        return known["task_id"], False
    task_id = uuid.uuid4().hex
    store.add("tasks", task_id, base_path=url, status="started", processed_files=0)
    return task_id, True


def run(store: Store, task_id: str, pages: DataFrame, *, max_pages: int = 40, tolerance: float = 1e-6, clusters: int = 10) -> None:
    """Graph, index and clusters of the pages that a crawl from the task's address reaches.

    Every stage leaves its state in the logs; a failed one leaves its reason and ends the run.
    """
    spark, stage = store.spark, "tasks"
    spark.addTag(task_id)  # all jobs of the run, so that ``kill`` stops whichever is at work
    url = store.state("tasks").filter(F.col("task_id") == task_id).first()["base_path"]
    try:
        store.add("tasks", task_id, status="downloading")
        reached = pipeline.crawled(spark, pages, url, max_pages)
        store.add("tasks", task_id, status="completed", processed_files=reached.count())
        stage = "text_index"
        store.add("text_index", task_id, status="building", index_path=store.path(task_id, "index"))
        collection = pipeline.build(spark, reached, tolerance=tolerance)
        sinks.write_graph(collection.nodes, collection.links, store.path(task_id, "graph"))
        collection.index.write(store.path(task_id, "index"))
        collection.documents.write.mode("overwrite").parquet(store.path(task_id, "documents"))
        number = spark.read.parquet(store.path(task_id, "documents")).count()
        store.add("text_index", task_id, status="completed", total_files=number, processed_files=number)
        stage = "clustering"
        store.add("clustering", task_id, status="running", error_message=None)
        documents = spark.read.parquet(store.path(task_id, "documents"))
        docs = documents.select(F.col("page_id").alias("id"), F.col("url").alias("path"), "url", F.col("content").alias("text"))
        structure = pipeline.clustered(spark, docs, largest=clusters)
        structure.write.mode("overwrite").parquet(store.path(task_id, "clusters"))
        store.add("clustering", task_id, status="completed", num_clusters=spark.read.parquet(store.path(task_id, "clusters")).select("cluster").distinct().count())
    except Exception as error:
        reason = {"clustering": "error_message"}.get(stage, "message")
        store.add(stage, task_id, status="failed", **{reason: str(error)[:1000]})
        raise
    finally:
        spark.removeTag(task_id)


def status(store: Store, task_id: str) -> str | None:
    """downloading, indexing, clustering or completed; None for an unknown task."""
    index = store.state("text_index").select("task_id", "status", "processed_files")
    row = tasks.pipeline_state(store.state("tasks").select("task_id", "status", "processed_files"), index, store.state("clustering").select("task_id", "status")).filter(F.col("task_id") == task_id).first()
    return row["state"] if row else None


def indexes(store: Store) -> DataFrame:
    return tasks.index_listing(store.state("text_index"))


def index_status_by_url(store: Store, url: str) -> DataFrame:
    """The task of an address with its index's state and whether there is one."""
    found = tasks.by_url(store.state("tasks"), url.strip().rstrip("/")).select("task_id", "base_path", "status")
    index = store.state("text_index").select("task_id", F.struct("status", "index_path", "total_files", "processed_files", "created_at").alias("index"))
    return found.join(index, "task_id", "left").withColumn("index_exists", F.col("index").isNotNull())


def search_text(store: Store, task_id: str, query: str, *, k: int = 5) -> tuple[search.Answer, DataFrame]:
    """(answer, its pages in order); LookupError without a completed index, ValueError for a blank query."""
    if not query.strip():
        raise ValueError("the query is blank")
    row = store.state("text_index").filter((F.col("task_id") == task_id) & (F.col("status") == "completed")).first()
    if row is None:
        raise LookupError(f"no completed index for task {task_id}")
    answer = search.search(store.spark, bm25.Index.read(store.spark, row["index_path"]), query, k=k)
    documents = store.spark.read.parquet(store.path(task_id, "documents"))
    pages = documents.join(F.broadcast(answer.results), documents["page_id"] == answer.results["doc_id"]).drop("doc_id")
    return answer, pages.orderBy("rank")


def search_url(store: Store, url: str, query: str, *, k: int = 5) -> tuple[search.Answer, DataFrame]:
    row = tasks.by_url(store.state("tasks"), url.strip().rstrip("/")).first()
    if row is None:
        raise LookupError(f"no task for {url}")
    return search_text(store, row["task_id"], query, k=k)


def index_detail(store: Store, task_id: str) -> dict[str, DataFrame]:
    """The index's row, its graph and its clusters, where they exist."""
    out = {"index": store.state("text_index").filter(F.col("task_id") == task_id)}
    for name in ("graph/nodes", "graph/links", "clusters"):
        try:
            out[name] = store.spark.read.parquet(store.path(task_id, name))
        except AnalysisException:
            continue
    return out


def previews(store: Store, task_id: str, n: int = 2) -> DataFrame:
    """page_id, preview of a task's documents."""
    documents = store.spark.read.parquet(store.path(task_id, "documents")).select(F.col("page_id").alias("doc_id"), F.col("content").alias("text"))
    short = summarize.summaries(documents, n, T.STOPWORDS)
    return documents.join(short, "doc_id").select(F.col("doc_id").alias("page_id"), summarize.preview(F.col("text"), F.col("summary"), n).alias("preview"))


def delete(store: Store, task_id: str) -> None:
    """Mark a task deleted in every log, last log first, and remove its data."""
    for name in ("clustering", "text_index", "tasks"):
        store.add(name, task_id, deleted=True)
    spark = store.spark
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store.folder}/data/{task_id}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kill(store: Store, task_id: str) -> None:
    pipeline.cancel(store.spark, task_id)
    delete(store, task_id)
