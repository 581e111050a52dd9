"""Splits of plain files that are fixed when a table is made: whatever changes in the session or the cluster later, the same bytes are read.

A split owns the records that begin in its bytes and reads past its end to finish the last one. One pass counts what begins in each split (lines of
FASTQ, whose records are four lines whatever they hold; records of FASTA; alignments of SAM); running totals, a number for each split, are the place in
the file at which it begins. Files of one split, and the last split of each file, aren't counted. Splits outside a range of rec_index are never opened.
"""

from __future__ import annotations

import base64
import json
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seqloom.schema import FASTQ
from seqloom.sources import parse
from seqloom.sources.remote import open_file


@dataclass
class Split:
    file: str
    size: int  # of the whole file
    start: int
    end: int
    #: Lines (FASTQ) or records (others) that begin before the split, and before the next one; None behind the last.
    before: int
    until: int | None

    def rows(self, kind: str, arity: int = 1) -> tuple[int, int | None]:
        """Which records, or groups of `arity`, begin here: from, and before which."""
        per = arity * (4 if kind == FASTQ else 1)
        return -(-self.before // per), None if self.until is None else -(-self.until // per)

    def outside(self, kind: str, first: int, stop: int | None, arity: int = 1) -> bool:
        """Whether no record (group) of first <= rec_index < stop begins here."""
        low, high = self.rows(kind, arity)
        return high == low or (high is not None and high <= first) or (stop is not None and low >= stop)


def split_bytes(spark: SparkSession, total: int, files: int) -> int:
    """The size of splits, by the same settings and rule as Spark's own file sources."""
    conf = spark._jsparkSession.sessionState().conf()
    cost = conf.filesOpenCostInBytes()
    least = conf.filesMinPartitionNum()
    parallel = least.get() if least.isDefined() else spark.sparkContext.defaultParallelism
    return max(1, min(conf.filesMaxPartitionBytes(), max(cost, (total + files * cost) // max(1, parallel))))


def plan_splits(spark: SparkSession, files: list[tuple[str, int]], kind: str) -> list[Split]:
    """The splits of files (path, size), counted."""
    step = split_bytes(spark, sum(n for _, n in files), len(files))
    cuts = {file: [n * i // k for i in range(k + 1)] for file, n in files for k in [max(1, -(-n // step))]}
    counted = [(file, a, b) for file, c in cuts.items() for a, b in zip(c[:-2], c[1:-1], strict=True)]
    counts: dict[tuple[str, int], int] = {}
    if counted:

        def count(batches):
            for batch in batches:
                found = [parse.count_begun(open_file(f, max(a - 1, 0)), kind, a, b) for f, a, b in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("start"), pa.array(found, pa.int64())], ["file", "start", "n"])

        names, starts, ends = zip(*counted, strict=True)
        rows = spark.createDataFrame(pa.table({"file": names, "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64())}))
        # Each row is a split's worth of reading; a number for each comes back.
        dealt = rows.repartition(min(len(counted), 4 * spark.sparkContext.defaultParallelism))
        counts = {(r.file, r.start): r.n for r in dealt.mapInArrow(count, "file string, start long, n long").collect()}
    out = []
    for file, size in files:
        if not size:
            continue
        before, c = 0, cuts[file]
        for a, b in zip(c[:-1], c[1:], strict=True):
            until = before + counts[file, a] if b < size else None
            out.append(Split(file, size, a, b, before, until))
            before = until or 0
    return out


def packed(splits: list[Split]) -> str:
    """Splits as text for a data source's options."""
    files = list(dict.fromkeys((s.file, s.size) for s in splits))
    at = {f: i for i, f in enumerate(files)}
    rows = [[at[s.file, s.size], s.start, s.end, s.before, s.until] for s in splits]
    return base64.b64encode(zlib.compress(json.dumps([files, rows]).encode())).decode()


def unpacked(text: str) -> list[Split]:
    files, rows = json.loads(zlib.decompress(base64.b64decode(text)))
    return [Split(*files[i], *rest) for i, *rest in rows]


def grouped(splits: list[Split], most: int, cost: int) -> list[list[Split]]:
    """Splits in order, as many to a partition as `most` bytes hold; each counts with `cost` on top."""
    out: list[list[Split]] = []
    room = 0
    for s in splits:
        n = s.end - s.start
        if not out or room < n:
            out.append([])
            room = most
        out[-1].append(s)
        room -= n + cost
    return out


def load_splits(spark: SparkSession, files: list[tuple[str, int]], kind: str, options, batch: int, arity: int = 0) -> DataFrame:
    """Plain files as a DataFrame."""
    from seqloom.sources.datasource import load

    files = list(dict.fromkeys(files))
    step = split_bytes(spark, sum(n for _, n in files), len(files))
    cost = min(step, spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    return load(spark, [], options, kind, batch, splits=packed(plan_splits(spark, files, kind)), most=step, cost=cost, arity=arity)


def read_split(split: Split, kind: str, mode: str, first: int, stop: int | None, size: int, arity: int = 0, fields=None):
    """Batches of a split's records with first <= rec_index < stop; with an arity of its groups, whose last may reach far into the next splits."""
    stream = open_file(split.file, max(split.start - 1, 0), split.size)
    try:
        if not arity:
            yield from parse.batches(stream, split.file, kind, mode, first, stop, size, split.start, split.end, split.before, fields)
            return
        low, high = split.rows(kind, arity)
        ends = [x for x in (high, stop) if x is not None]
        records = parse.batches(stream, split.file, kind, mode, max(low, first) * arity, min(ends) * arity if ends else None, size, split.start, None, split.before, fields)
        yield from parse.groups(records, arity, split.file, fields)
    finally:
        stream.close()
