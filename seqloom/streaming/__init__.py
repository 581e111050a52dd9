"""New files of a folder as a stream of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.schema import ERROR_FIELD, PERMISSIVE, ReadOptions
from seqloom.sources.remote import local_path, open_file
from seqloom.storage import file_system


def read_stream(spark: SparkSession, folder: str, max_files: int | None = None, **options) -> DataFrame:
    """Records of the files that come into a folder. A file is read once, whole, when it is there: it must be moved in complete.

    A file is streamed where workers can open it; one in a store that only Spark opens is a row in memory, of 2 GB at most. Compression and format are found by content; a file of nothing, compressed or not, has no records. A file's records have its own rec_index, so a restarted stream gives the same rows.
    """
    opts = ReadOptions.of(options)
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    local = local_path(file_system(spark, folder)[1].toUri().toString()) is not None and file_system(spark, folder)[0].getScheme() == "file"

    def parse_files(batches):
        import io

        from seqloom.sources.codec import decompressed
        from seqloom.sources.parse import batches as records

        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                # Workers open a local file and stream it; a store's comes as a row.
                raw = open_file(path) if local else io.BytesIO(batch.column("content")[i].as_buffer())
                with raw:
                    stream = decompressed(raw)
                    if not stream.peek(1):  # compressed nothing, as Spark's writers leave for an empty partition
                        continue
                    for r in records(stream, path, opts.format, opts.mode, 0, opts.record_limit, opts.records_per_batch, fields=names):
                        yield r.select(names)

    fields = opts.fields([ERROR_FIELD] if opts.mode == PERMISSIVE else [])
    names = [f.name for f in fields]
    files = reader.load(folder).where(F.col("length") > 0).select("path", *([] if local else ["content"]))
    return files.mapInArrow(parse_files, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))


def each_batch(records: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Starts a stream that hands each micro-batch and its number to a function."""
    return records.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
