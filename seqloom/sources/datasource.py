"""The data source "fastx": splits of plain files, fixed beforehand, and whole files or addresses that can't be split.

The latter are compressed files (any codec, found by content), HTTP, SSH and gcloud addresses and BAM, one to a partition, read as streams in bounded
memory. Paths are opened on the executors. Comparisons of rec_index are pushed down: splits outside aren't opened, records before are passed over unbuilt
and reading stops at the last.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from seqloom.schema import BAM, ERROR_FIELD, FAILFAST, FLAG_FIELD, PERMISSIVE, SAM, ReadOptions


class FilePartition(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


class SplitsPartition(InputPartition):
    def __init__(self, splits: list, start: int, stop: int | None):
        self.splits, self.start, self.stop = splits, start, stop


class ZipPartition(InputPartition):
    """Records low <= rec_index < high of the files of a group, each read from a split that begins before them; whole streams have no splits."""

    def __init__(self, group: int, sides: list, low: int, high: int | None):
        self.group, self.sides, self.low, self.high = group, sides, low, high


class FastxReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.paths, self.format = json.loads(options["paths"]), options.get("format", "auto")
        self.mode, self.columns, self.schema = options.get("mode", FAILFAST), schema.fieldNames(), schema
        self.tuples = json.loads(options.get("tuples", "[]"))
        self.size, self.open = int(options.get("batch", 1024)), json.loads(options.get("open", "{}"))
        self.start, self.stop = 0, int(options["limit"]) if options.get("limit") else None
        #: What records are built of: these columns; in a group those of its members.
        self.fields = schema["members"].dataType.elementType.fieldNames() if options.get("arity") else self.columns
        self.arity = int(options.get("arity", 0))
        if self.arity and self.stop is not None:  # a limit of records; a group cut by it is an error, so it is read
            self.stop = -(-self.stop // self.arity)
        self.splits, self.most, self.cost = options.get("splits"), int(options.get("most", 1)), int(options.get("cost", 1))

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("rec_index",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = {GreaterThanOrEqual: f.value, GreaterThan: f.value + 1, EqualTo: f.value}.get(type(f), 0)
                high = {LessThan: f.value, LessThanOrEqual: f.value + 1, EqualTo: f.value + 1}.get(type(f))
                self.start = max(self.start, low)
                if high is not None:
                    self.stop = high if self.stop is None else min(self.stop, high)
            yield f  # Spark applies it as well

    def _zip_partitions(self):
        from seqloom.sources.splits import unpacked

        splits: dict[str, list] = {}
        for s in unpacked(self.splits):
            splits.setdefault(s.file, []).append(s)
        out = []
        for g, sides in enumerate(self.tuples):
            if any(whole for *_, whole in sides):  # a stream can't be entered in the middle
                out.append(ZipPartition(g, [(file, kind, None) for file, kind, _ in sides], self.start, self.stop))
                continue
            # Ranges are those of the file with most splits; the others are entered at the last split that begins before.
            lead = max((s for s in sides if s[0] in splits), key=lambda s: len(splits[s[0]]), default=None)
            for s in splits[lead[0]] if lead else []:
                low, high = s.rows(lead[1])
                if low == high or s.outside(lead[1], self.start, self.stop):
                    continue
                low, ends = max(low, self.start), [x for x in (high, self.stop) if x is not None]
                entered = [(file, kind, max((t for t in splits.get(file, []) if t.rows(kind)[0] <= low), key=lambda t: t.start, default=None)) for file, kind, _ in sides]
                out.append(ZipPartition(g, entered, low, min(ends) if ends else None))
        return out or [ZipPartition(0, [], 0, 0)]

    def _read_zip(self, partition: ZipPartition):
        from contextlib import ExitStack

        import pyarrow as pa

        from seqloom.sources import parse
        from seqloom.sources.codec import decompressed
        from seqloom.sources.remote import open_file, open_stream

        fields = [f.name for f in self.schema["r1"].dataType.fields]
        with ExitStack() as opened:
            sides = []
            for file, kind, split in partition.sides:
                if split is None:
                    raw = open_stream(file, **self.open)
                    opened.callback(raw.close)
                    sides.append(parse.batches(decompressed(raw), file, kind, self.mode, partition.low, partition.high, self.size, fields=fields))
                else:
                    raw = opened.enter_context(open_file(file, max(split.start - 1, 0), split.size))
                    sides.append(parse.batches(raw, file, kind, self.mode, partition.low, partition.high, self.size, split.start, None, split.before, fields))
            for batch in parse.zipped(sides, fields) if sides else ():
                if "group_id" in self.columns:
                    batch = batch.append_column("group_id", pa.repeat(pa.scalar(partition.group, pa.int64()), batch.num_rows))
                yield batch.select(self.columns)

    def partitions(self):
        if self.tuples:
            return self._zip_partitions()
        if self.splits is not None:
            from seqloom.sources.splits import grouped, unpacked

            wanted = [s for s in unpacked(self.splits) if not s.outside(self.format, self.start, self.stop, self.arity or 1)]
            # Spark wants a partition even of nothing.
            return [SplitsPartition(g, self.start, self.stop) for g in grouped(wanted, self.most, self.cost)] or [SplitsPartition([], 0, 0)]
        return [FilePartition(p, self.start, self.stop) for p in self.paths]

    def read(self, partition):
        from seqloom.sources import bam, parse
        from seqloom.sources.codec import decompressed
        from seqloom.sources.remote import open_stream

        if isinstance(partition, ZipPartition):
            yield from self._read_zip(partition)
            return
        if isinstance(partition, SplitsPartition):
            from seqloom.sources.splits import read_split

            for split in partition.splits:
                for batch in read_split(split, self.format, self.mode, partition.start, partition.stop, self.size, self.arity, self.fields):
                    yield batch.select(self.columns)
            return
        raw = open_stream(partition.path, **self.open)
        try:
            stream = decompressed(raw)
            if self.format == BAM:
                found = bam.batches(stream, partition.path, partition.start, partition.stop, self.size)
            else:
                k = self.arity or 1
                found = parse.batches(stream, partition.path, self.format, self.mode, partition.start * k, None if partition.stop is None else partition.stop * k, self.size, fields=self.fields)
                found = parse.groups(found, self.arity, partition.path, self.fields) if self.arity else found
            for batch in found:
                yield batch.select(self.columns)
        finally:
            raw.close()


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> StructType:
        extra = [FLAG_FIELD] if self.options.get("format") in (BAM, SAM) else [ERROR_FIELD] if self.options.get("mode") == PERMISSIVE else []
        file, index, *rest = wanted = ReadOptions(columns=json.loads(self.options.get("columns", "null"))).fields(extra)
        if self.options.get("tuples"):
            group = [StructField("group_id", LongType(), False)] if self.options.get("grouped") == "true" else []
            sides = len(json.loads(self.options["tuples"])[0])
            return StructType([*group, index, *(StructField(f"r{i + 1}", StructType(wanted), False) for i in range(sides))])
        if self.options.get("arity"):
            return StructType([file, index, StructField("members", ArrayType(StructType([index, *rest])), False)])
        return StructType(wanted)

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastxReader(dict(self.options), schema)


def load(spark: SparkSession, paths: list[str], options: ReadOptions, kind: str, batch: int, *, splits: str | None = None, most: int = 1, cost: int = 1, arity: int = 0, tuples: list | None = None, grouped: bool = False, **open_options):
    """The files or addresses as a DataFrame; of plain files their splits."""
    spark.dataSource.register(FastxSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("fastx").option("paths", json.dumps(paths)).option("format", kind).option("mode", options.mode)
    reader = reader.option("batch", batch).option("open", json.dumps(open_options))
    if options.columns is not None:
        reader = reader.option("columns", json.dumps(options.columns))
    if splits is not None:
        reader = reader.option("splits", splits).option("most", most).option("cost", cost)
    if tuples:
        reader = reader.option("tuples", json.dumps(tuples)).option("grouped", str(grouped).lower())
    if arity:
        reader = reader.option("arity", arity)
    if options.record_limit is not None:
        reader = reader.option("limit", options.record_limit)
    return reader.load()
