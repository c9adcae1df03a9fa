"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of text in one Arrow batch; bounds the memory of Python workers.
TEXT_ROWS_PER_BATCH = 512
#: Whether Spark removes a query's shuffle files when it ends, or when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset on one machine.

    RuntimeError on a cluster without one: a folder of one machine would lose data there.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="inkstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """A run's own subfolder; ``save`` cuts lineage by writing a table and reading it again.

    A lost executor never costs more than the stage at hand, since every saved table
    is in the shared folder.  Text operators need small Arrow batches; the limit is lowered
    for the session if it is higher, and stays so, since results are computed later.
    tidy: the shuffle files of each save go as soon as its table is written.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
        if rows <= 0 or rows > TEXT_ROWS_PER_BATCH:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS_PER_BATCH))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def save(self, frame: DataFrame, name: str, rows: int | None = None, per_file: int = 10_000) -> DataFrame:
        """Write and read again; with about ``rows`` rows known, in no more files than one per ``per_file`` of them."""
        schema = frame.schema
        if rows is not None:
            frame = frame.coalesce(max(1, -(-rows // per_file)))
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, str(self.tidy or before == "true").lower())
        try:
            frame.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
