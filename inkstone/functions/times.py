"""Times: epochs, formats and differences as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_epoch(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / 1e6


def formatted(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def elapsed(begin: Column, end: Column) -> Column:
    """Seconds between two times; up to now for a null end."""
    return to_epoch(F.coalesce(end.cast("timestamp"), F.current_timestamp())) - to_epoch(begin)
