"""Log events: the progress of streaming queries as log records."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class LogListener(StreamingQueryListener):
    """Writes start, progress and end of every streaming query to a logger."""

    def __init__(self, logger: logging.Logger | None = None):
        self.logger = logger or logging.getLogger("inkstone.streaming")

    def onQueryStarted(self, event):
        self.logger.info("query %s started", event.name or event.id)

    def onQueryProgress(self, event):
        self.logger.info("query %s: batch %s, %s rows", event.progress.name or event.progress.id, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.logger.log(logging.ERROR if event.exception else logging.INFO, "query %s ended%s", event.id, f": {event.exception}" if event.exception else "")


def listen(spark: SparkSession, logger: logging.Logger | None = None) -> LogListener:
    listener = LogListener(logger)
    spark.streams.addListener(listener)
    return listener
