"""What the corpus operators share: shared storage, batches, table checks, bit votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.storage import remove, scratch

#: Tables that fit in this many bytes may be collected or broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, survives lost executors and has a known size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what materialize wrote, where nothing reads it any more."""
    for df in tables:
        remove(df.sparkSession, df._scratch)


def held_small(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table of fixed-width columns that was materialized, at 8 bytes a column and 40 a row, stays within the limit: its rows are counted."""
    return df.count() * (40 + 8 * len(df.columns)) <= limit_bytes


def small_rows(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> list | None:
    """All rows if their measured bytes stay within the limit, otherwise None."""
    length = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("binary")) if t in ("string", "binary") else F.lit(16), F.lit(16)) for c, t in df.dtypes), F.lit(64))
    held = df.agg(F.sum(length)).first()[0] or 0
    return df.collect() if held <= limit_bytes else None


def crc32_mod(column: Column, modulus: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % modulus


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


#: Bytes of a batch that a worker has in hand at once.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], limit_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some MB, whatever a row's length (one row at least), so that a worker's memory stays bounded."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * limit_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


_HELD: list[tuple[tuple, object]] = []


def one_a_worker(key: tuple, make: Callable[[], object]):
    """What make() gives, kept by a worker for its later tasks. A worker keeps one such object: another key's takes its place. key[0] is its kind."""
    if not _HELD or _HELD[0][0] != key:
        _HELD.clear()
        _HELD.append((key, make()))
    return _HELD[0][1]


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, limit_bytes: int = SLICE_BYTES, keeps: str = "") -> DataFrame:
    """mapInArrow over bounded slices. What the worker keeps for another kind of work than `keeps` goes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _HELD and _HELD[0][0][0] != keeps:
            _HELD.clear()
        return work(slices(batches, limit_bytes))

    return df.mapInArrow(run, schema)


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each row the words whose bits are set in over half of the row's hashes.

    hashes: uint64 of shape (n, words), the rows' hashes one after another. lengths: how many each row has; a row of none gets zeros.
    Bits are counted in byte lanes: a row's hashes are cut into parts of at most 255, so that no lane overflows.
    """
    hashes = np.ascontiguousarray(hashes).reshape(len(hashes), -1)
    words = hashes.shape[1] if len(hashes) else 1
    out = np.zeros((len(lengths), words), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    lengths = lengths[full].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    parts = (lengths + 254) // 255
    first = np.cumsum(parts) - parts
    which = np.repeat(np.arange(len(lengths)), parts)
    part_starts = starts[which] + 255 * (np.arange(len(which)) - first[which])
    ends = np.append(part_starts[1:], len(hashes))
    counts = np.empty((len(which), 64 * words), dtype=np.uint8)
    step = max(1, (1 << 15) // 255 // words)
    for a in range(0, len(which), step):
        b = min(len(which), a + step)
        lanes = np.unpackbits(hashes[part_starts[a] : ends[b - 1]].view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        counts[a:b] = np.add.reduceat(lanes, part_starts[a:b] - part_starts[a], axis=0).view(np.uint8)
    totals = counts.astype(np.int64) if len(which) == len(lengths) else np.add.reduceat(counts, first, axis=0, dtype=np.int64)
    out[full] = np.packbits(totals * 2 > lengths[:, None], axis=1, bitorder="little").view("<u8")
    return out
