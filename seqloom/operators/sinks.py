"""Writers: records, pairs and groups as FASTA or FASTQ text.

Spark's text writer copies a string's bytes as they are, so any bytes can be written, to any file system, through Spark's commit protocol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import fasta_line, fastq_line
from seqloom.schema import FASTA, FASTQ
from seqloom.storage import file_system, list_files, remove, scratch


def _lines(rows: DataFrame, kind: str) -> Column:
    if kind not in (FASTA, FASTQ):
        raise ValueError(f"format {kind!r} is not fasta or fastq")
    line = fasta_line if kind == FASTA else fastq_line
    names = [c for c in rows.columns if c[0] == "r" and c[1:].isdigit()]
    if names:
        parts = [line(n) for n in names]
        return F.concat(parts[0], *(x for p in parts[1:] for x in (F.lit(b"\n"), p)))
    if "members" in rows.columns:
        return F.array_join(F.transform("members", lambda r: line(r).cast("string")), "\n").cast("binary")
    return line()


def to_lines(rows: DataFrame, kind: str) -> DataFrame:
    """(keys, value): each row's text, the records of a pair or group in order."""
    keys = [c for c in ("group_id", "file", "rec_index") if c in rows.columns]
    return rows.select(*keys, _lines(rows, kind).cast("string").alias("value"))


def write_records(rows: DataFrame, path: str, kind: str = FASTQ, ordered: bool = False, compression: str | None = None) -> None:
    """Part files under path. ordered: in order of file and rec_index, within files and from one to the next."""
    out = to_lines(rows, kind)
    keys = out.columns[:-1]
    if ordered:
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = out.select("value").write.option("lineSep", "\n")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_file(rows: DataFrame, path: str, kind: str = FASTQ) -> None:
    """One file in order of file and rec_index. Parts are written by all executors, then joined as streams on the driver."""
    spark = rows.sparkSession
    parts = scratch(spark, "parts")
    write_records(rows, parts, kind, ordered=True)
    merge_parts(spark, parts, path)


def merge_parts(spark, parts: str, path: str, head: bytes = b"", cut: int = 0) -> None:
    """The part files under a folder, in order of their names, as one file; bounded memory."""
    join_files(spark, list_files(spark, [parts]), path, head, cut)
    remove(spark, parts)


def join_files(spark, files: list[tuple[str, int]], path: str, head: bytes = b"", cut: int = 0) -> None:
    """Files (path, size) as one behind `head`, each without its last `cut` bytes; copied as streams by the driver's JVM."""
    fs, where = file_system(spark, path)
    copy = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge
    out = fs.create(where, True)
    try:
        if head:
            out.write(bytearray(head))
        for file, size in files:
            from_fs, source = file_system(spark, file)
            stream = from_fs.open(source)
            try:
                if copy(stream, out, 0, size - cut) != size - cut:
                    raise EOFError(f"{file} has fewer than {size} bytes")
            finally:
                stream.close()
    finally:
        out.close()
