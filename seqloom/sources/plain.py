"""Plain FASTQ, FASTA and SAM text by JVM expressions alone, on any file system that Spark knows.

What `splits` does for files that workers can open, Spark's own line reader does here for all others. A record's place in its file needs the lines (or
chunks) before its block. One pass counts them for each block; running totals over blocks, a row for each, give every block its first number. The
blocks are those of one scan that is planned once: every later use reads the very same, whatever has changed in the session or the cluster since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.schema import DROPMALFORMED, FAILFAST, FASTA, FASTQ, PERMISSIVE, RECORD_COLUMNS, SAM
from seqloom.storage import file_system, list_files, read_bytes, scratch

#: The table of blocks is broadcast up to this many bytes and merged beyond.
BLOCK_TABLE_BYTES = 64 << 20
#: Of FASTQ files so many bytes are grouped in a task; lines of some 14 bytes take 27 times as much memory there.
DEALT_BYTES = 8 << 20
NEWLINE = "\n"


def pinned(df: DataFrame) -> DataFrame:
    """df with its physical plan, and so its splits, as they are now: a later query over it doesn't plan its scan again."""
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def _raw(spark: SparkSession, paths: list[str], separator: str) -> DataFrame:
    lines = spark.read.option("lineSep", separator).text(paths)  # a separator of its own: the default also splits at carriage returns
    return pinned(lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"), F.monotonically_increasing_id().alias("mid")))


def numbered(spark: SparkSession, paths: list[str], separator: str = NEWLINE, marked: Column | None = None) -> DataFrame:
    """(file, n, total, marked, value): each line with its 0-based number in its file, and how many the file has. JVM only.

    marked: an aggregate over a block's lines (file, block, mid, value), added up for each file in the same pass.
    Lines of a block have consecutive ids in a task, so the block's least id and first number give each line's. Both passes are over one scan.
    The table of blocks is written to the shared folder, so its size is known. A line whose block wasn't counted is an error.
    """
    raw = _raw(spark, paths, separator)
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("mid").alias("least"), (F.lit(0) if marked is None else marked).cast("long").alias("marked"))
    file = Window.partitionBy("file")
    before = F.coalesce(F.sum("lines").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", (before - F.col("least")).alias("shift"), F.sum("lines").over(file).alias("total"), F.sum("marked").over(file).alias("marked"))
    path = scratch(spark, "blocks")
    blocks.write.parquet(path)
    blocks = spark.read.schema(blocks.schema).parquet(path)
    size = blocks.agg(F.sum(F.octet_length("file") + 64)).first()[0] or 0
    blocks = F.broadcast(blocks) if size <= BLOCK_TABLE_BYTES else blocks.hint("merge")
    known = F.col("shift").isNotNull()
    lost = F.raise_error(F.concat(F.lit("a block that wasn't counted: "), F.col("file"), F.lit(" from "), F.col("block").cast("string")))
    joined = raw.join(blocks, ["file", "block"], "left").where(F.when(known, F.lit(True)).otherwise(lost.cast("boolean")))
    return joined.select("file", (F.col("mid") + F.col("shift")).alias("n"), "total", "marked", "value")


def _checked(df: DataFrame, error: Column, mode: str) -> DataFrame:
    if mode == FAILFAST:
        fail = F.raise_error(F.concat(error, F.lit(": "), F.col("file"), F.lit(", record "), F.col("rec_index").cast("string")))
        # In a filter, which no choice of columns takes away.
        return df.where(F.when(error.isNotNull(), fail.cast("boolean")).otherwise(F.lit(True))).select(*RECORD_COLUMNS)
    df = df.withColumn("_error", error)
    return df.where("_error is null").select(*RECORD_COLUMNS) if mode == DROPMALFORMED else df.select(*RECORD_COLUMNS, "_error")


def _strip_sign(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.octet_length(c))


def _ended_files(spark: SparkSession, totals: DataFrame) -> list[str]:
    """Of files whose last group has three lines those that end with a newline: there an empty fourth line is meant."""
    return [r.file for r in totals.where("total % 4 = 3").select("file").distinct().toLocalIterator() if _last_byte(spark, r.file) == b"\n"]


def _last_byte(spark: SparkSession, file: str) -> bytes:
    fs, where = file_system(spark, file)
    return read_bytes(spark, file, fs.getFileStatus(where).getLen() - 1, 1)


def read_fastq(spark: SparkSession, paths: list[str], mode: str = FAILFAST) -> DataFrame:
    """FASTQ records from a group of four numbered lines; JVM only, at the price of a shuffle."""
    lines = numbered(spark, paths).withColumn("value", F.col("value").cast("binary")).withColumn("rec_index", F.expr("n div 4"))
    # Lines are dealt before they are grouped: a block's lines would be sorted in one task's memory to group them where they are read.
    # Their number goes with the bytes, so that a task's memory doesn't.
    keys = ["file", "rec_index"]
    lines = lines.repartition(max(1, -(-sum(size for _, size in list_files(spark, paths)) // DEALT_BYTES)), *keys)
    part = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    grouped = lines.groupBy(*keys).agg(*(part(k).alias(f"l{k}") for k in range(4)), F.max("total").alias("total"))
    short = grouped.where("l3 is null and l2 is not null").select("file", "total")
    ended = _ended_files(spark, short)
    if ended:
        grouped = grouped.withColumn("l3", F.when(F.col("l2").isNotNull() & F.col("file").isin(ended), F.coalesce("l3", F.lit(b""))).otherwise(F.col("l3")))
    r = grouped.where("l3 is not null")
    begins = lambda c, sign: F.coalesce(F.substring(F.col(c), 1, 1) == F.lit(sign), F.lit(False))
    error = (
        F.when(~begins("l0", b"@"), "INVALID_HEADER").when(~begins("l2", b"+"), "INVALID_SEPARATOR")
        .when(F.octet_length("sequence") != F.octet_length("quality"), "UNEQUAL_LENGTHS")
    )
    r = r.select("file", "rec_index", "l0", "l2", F.col("l1").alias("sequence"), F.col("l3").alias("quality")).select(
        "file", "rec_index", _strip_sign(F.col("l0")).alias("id"), F.col("sequence").alias("seq"), F.col("sequence").alias("seq_raw"), F.col("quality").alias("qual"), F.col("l2").alias("sep"), F.lit(FASTQ).alias("format"), error.alias("e")
    )
    return _checked(r, F.col("e"), mode)


def read_fasta(spark: SparkSession, paths: list[str], mode: str = FAILFAST) -> DataFrame:
    """FASTA records, one or many lines each; JVM only. Chunks between "\\n>" are numbered; a file's first is a record only if it begins with >."""
    junk = F.when((F.col("block") == 0) & ~F.min_by(F.col("value").startswith(">"), "mid"), 1).otherwise(0)
    chunks = numbered(spark, paths, "\n>", junk)
    first, last = F.col("n") == 0, F.col("n") == F.col("total") - 1
    # Bytes stay as they are: positions count bytes, and nothing decodes them.
    binary = F.col("value").cast("binary")
    begin, end = F.when(first, 2).otherwise(1), F.octet_length("value") - F.when(last & F.col("value").endswith(NEWLINE), 1).otherwise(0)
    rows = chunks.where(~(first & (F.col("marked") > 0)))
    rows = rows.select("file", (F.col("n") - F.col("marked")).alias("rec_index"), F.substring(binary, begin, end - begin + 1).alias("v"))
    header = F.substring_index(F.col("v").cast("string"), NEWLINE, 1)
    raw = F.substring("v", F.octet_length(header) + 2, F.octet_length("v"))
    out = rows.select(
        "file", "rec_index", header.cast("binary").alias("id"), F.replace(raw.cast("string"), F.lit(NEWLINE), F.lit("")).cast("binary").alias("seq"),
        raw.alias("seq_raw"), F.lit(None).cast("binary").alias("qual"), F.lit(None).cast("binary").alias("sep"), F.lit(FASTA).alias("format"),
    )
    return out.withColumn("_error", F.lit(None).cast("string")) if mode == PERMISSIVE else out


def read_sam(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SAM alignments in file order, one row each whatever the flags; JVM only. * for a missing quality is null, seq_raw too."""
    # Header lines come first: their number is the alignments' shift.
    lines = numbered(spark, paths, marked=F.count_if(F.col("value").startswith("@"))).where("value <> ''")
    f = F.split("value", "\t")
    text = lambda k: F.get(f, F.lit(k))
    present = lambda k: F.when(text(k) != "*", text(k)).cast("binary")
    rows = lines.where(~F.col("value").startswith("@"))
    rows = rows.where(F.when(F.size(f) < 11, F.raise_error(F.concat(F.lit("not an alignment: "), F.col("file"))).cast("boolean")).otherwise(F.lit(True)))
    return rows.select(
        "file", (F.col("n") - F.col("marked")).alias("rec_index"), text(0).cast("binary").alias("id"), F.coalesce(present(9), F.lit(b"")).alias("seq"),
        F.lit(None).cast("binary").alias("seq_raw"), present(10).alias("qual"), F.lit(None).cast("binary").alias("sep"), F.lit(SAM).alias("format"), text(1).cast("int").alias("flag"),
    )
