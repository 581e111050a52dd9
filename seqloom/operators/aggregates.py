"""Counts and byte sums over records, pairs and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import byte_sum


def seq_sum(records: DataFrame) -> DataFrame:
    """(n_records, byte_sum): how many records, and the sum of their sequences' bytes."""
    return records.agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum(byte_sum("seq")), F.lit(0)).alias("byte_sum"))


def seq_sum_groups(combined: DataFrame) -> DataFrame:
    """(n_groups, byte_sum) over pairs or groups: each counts once, all of its records are summed."""
    names = [c for c in combined.columns if c[0] == "r" and c[1:].isdigit()]
    # Bytes add up over a group's sequences, so they are summed as one.
    whole = F.concat(*(F.col(n).seq for n in names)) if names else F.array_join(F.transform("members", lambda r: r.seq.cast("string")), "").cast("binary")
    total = byte_sum(whole)
    return combined.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("byte_sum"))


def count_records(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("n_records"))


def lengths(records: DataFrame) -> DataFrame:
    return records.select("file", "rec_index", F.octet_length("seq").cast("long").alias("seq_length"))
