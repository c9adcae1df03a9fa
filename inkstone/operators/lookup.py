"""Prioritised lookup: the first of several candidate keys that a table knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def page_keys(url: Column) -> Column:
    """Keys under which a page is known, best first: its URL, without fragment and query, its path, its base name."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.array(url, bare, U.path(url), U.basename(bare))


def first_match(rows: DataFrame, keys: Column, table: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the value of the first of their keys in the table (one row per key), null without one.

    One join for all candidates; the best is a minimum per array of keys, formed before the
    shuffle, so rows that try the same keys share it.
    """
    keyed = rows.withColumn("__keys", keys)
    tried = keyed.select("__keys").distinct().select("__keys", F.posexplode("__keys").alias("__priority", key))
    found = tried.join(table.select(key, value), key).groupBy("__keys").agg(F.min(F.struct("__priority", value)).alias("best"))
    return keyed.join(found.select("__keys", F.col(f"best.{value}").alias(value), F.col("best.__priority").alias("priority")), "__keys", "left").drop("__keys")


def or_default(rows: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """rows with the value of their key in the table (one row per key), the default without one."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
