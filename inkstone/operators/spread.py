"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input for each core under which rows are dealt out; larger inputs come in enough partitions.
SMALL = 32 << 20


def spread(frame: DataFrame) -> DataFrame:
    """Deal the rows of a small input, which may lie in one row group, to all cores.

    Larger inputs, by the optimizer's estimate, stay as they are: their texts are not shuffled.
    """
    spark = frame.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return frame.repartition(cores) if size < SMALL * cores else frame
