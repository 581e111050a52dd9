"""Ranges and limits over the ordinal of records, pairs or groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(start: int | None = None, end: int | None = None, *, start_excluded: bool = False, end_included: bool = False) -> tuple[int, int | None]:
    """(first, past the last) of a range; None is open. A range that ends before it starts is empty."""
    low = 0 if start is None else start + start_excluded
    if low < 0 or (end is not None and end < 0):
        raise ValueError("ordinals aren't negative")
    return low, None if end is None else max(low, end + end_included)


def in_range(ordinal: str | Column, start: int | None = None, end: int | None = None, **kinds: bool) -> Column:
    low, high = bounds(start, end, **kinds)
    c = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return c >= low if high is None else (c >= low) & (c < high)


def take_range(rows: DataFrame, start: int | None = None, end: int | None = None, ordinal: str = "rec_index", **kinds: bool) -> DataFrame:
    """Rows whose ordinal is in the range, in every file or group; past the end there is nothing."""
    return rows.where(in_range(ordinal, start, end, **kinds))


def limit_records(records: DataFrame, n: int) -> DataFrame:
    """The first n records of each file."""
    return take_range(records, 0, n)


def peek(records: DataFrame, n: int) -> DataFrame:
    """The first n records in order, without using them up: a source can be read again."""
    return records.where(F.col("rec_index") < n).orderBy("file", "rec_index").limit(n)
