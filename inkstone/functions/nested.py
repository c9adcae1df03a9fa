"""Nested values: dotted updates, merges, and JSON with defaults as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_field(struct: Column, path: str, value: Column) -> Column:
    """struct with the field at a dotted path set; fields on the way must exist."""
    return struct.withField(path, value)


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; the second's entries win."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def get(mapping: Column, key: str, default: Column) -> Column:
    return F.coalesce(F.try_element_at(mapping, F.lit(key)), default)


def encoded(value: Column) -> Column:
    return F.to_json(value)


def decoded_array(text: Column, element: str = "string") -> Column:
    """A JSON array; empty for null, blank or broken text."""
    return F.coalesce(F.from_json(text, f"array<{element}>"), F.array().cast(f"array<{element}>"))
