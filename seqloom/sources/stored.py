"""Compressed and BAM files in stores that only Spark's readers open: their bytes come through Spark's line reader, in order, and are parsed as a stream.

Spark's reader gives lines without their ends. Of bytes as they are stored, lines joined by their ends are the file again, to its known size. A name by
which Hadoop knows a codec is decompressed on the way; then whether the last line had an end isn't known, and it is taken to have none.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.schema import BAM, ERROR_FIELD, FLAG_FIELD, PERMISSIVE, SAM, ReadOptions
from seqloom.sources import bam, parse
from seqloom.sources.codec import decompressed
from seqloom.sources.plain import pinned

#: More than any file has: each is then one split of its own.
WHOLE = 1 << 50


def hadoop_codec(spark: SparkSession, path: str) -> bool:
    """Whether Hadoop decompresses a file of this name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(jvm.org.apache.hadoop.fs.Path(path)) is not None


def _whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, size, value): lines of whole files, one to a partition, in order."""
    settings = {"spark.sql.files.maxPartitionBytes": str(WHOLE), "spark.sql.files.openCostInBytes": str(WHOLE), "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        lines = spark.read.option("lineSep", "\n").text(paths)
        return pinned(lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value")))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Lines(io.RawIOBase):
    """The bytes of one file from its lines; `size` is given where they must come to that."""

    def __init__(self, lines: Iterator[bytes], size: int | None):
        self.lines, self.size, self.given, self.held, self.first = lines, size, 0, b"", True

    def readable(self) -> bool:
        return True

    def _fill(self) -> None:
        line = next(self.lines, None)
        if line is not None:
            self.held = line if self.first else b"\n" + line
            self.first = False
        elif self.size is not None and self.given == self.size - 1:
            self.held = b"\n"

    def readinto(self, buffer) -> int:
        while not self.held:
            was_first = self.first
            self._fill()
            if not self.held and self.first == was_first:
                return 0
        n = min(len(buffer), len(self.held))
        buffer[:n] = self.held[:n]
        self.held, self.given = self.held[n:], self.given + n
        return n


def load_stored(spark: SparkSession, paths: list[str], kind: str, options: ReadOptions, batch: int) -> DataFrame:
    """The files' records; each file is one task's stream in bounded memory."""
    parts, extra = [], [FLAG_FIELD] if kind in (BAM, SAM) else [ERROR_FIELD] if options.mode == PERMISSIVE else []
    fields = options.fields(extra)
    names, schema = [f.name for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    for known in (False, True):
        files = [p for p in paths if hadoop_codec(spark, p) == known]
        if not files:
            continue

        def parse_files(batches, known=known):
            def rows():
                for b in batches:
                    yield from zip(b.column("file").to_pylist(), b.column("size").to_pylist(), b.column("value").to_pylist(), strict=True)

            found = rows()
            row = next(found, None)
            while row is not None:
                file, size, _ = row

                def lines(file=file):
                    nonlocal row
                    while row is not None and row[0] == file:
                        yield row[2]
                        row = next(found, None)

                own = lines()
                raw = io.BufferedReader(_Lines(own, None if known else size), 1 << 20)
                stream = decompressed(raw)
                if kind == BAM:
                    records = bam.batches(stream, file, 0, options.record_limit, batch)
                else:
                    records = parse.batches(stream, file, kind, options.mode, 0, options.record_limit, batch, fields=names)
                for r in records:
                    yield r.select(names)
                for _ in own:  # past a limit
                    pass

        parts.append(_whole_files(spark, files).mapInArrow(parse_files, schema))
    out = parts[0]
    return out.unionByName(parts[1]) if len(parts) > 1 else out
