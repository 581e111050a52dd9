"""Sequence files made from the tables, with the engine's own writers. A file is made once for a session and folder of tables."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.sinks import merge_parts, to_lines, write_file, write_records
from seqloom.storage import file_system, scratch

#: Text in a compressed member.
MEMBER_BYTES = 4 << 20

_made: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    """The path of a file that `make` writes if it isn't there yet."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        path = f"{scratch(spark, name)}/{name}"
        make(path)
        _made[key] = path
    return _made[key]


def sequence(key: str, salt: str = "") -> str:
    """SQL of the bases for a key: 8 to 32 of them; the same text in Spark and DuckDB."""
    return f"substr(translate(md5({salt!r} || cast({key} as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(8 + {key} % 25 as int))"


def records(spark: SparkSession, sf_dir: str, salt: str = "", name: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """Records of a table's keys; qualities are all @, the sign that also begins a header."""
    out = table(spark, sf_dir, name).selectExpr("'x' as file", f"{key} as rec_index", f"binary('seq.' || {key}) as id", f"binary({sequence(key, salt)}) as seq")
    return out.withColumn("qual", F.repeat(F.lit("@"), F.octet_length("seq")).cast("binary"))


def fastq(spark: SparkSession, sf_dir: str, salt: str = "", name: str = "orders", key: str = "o_orderkey") -> str:
    return made(spark, sf_dir, f"{name}{salt}.fastq", lambda p: write_file(records(spark, sf_dir, salt, name, key), p))


def fasta(spark: SparkSession, sf_dir: str) -> str:
    return made(spark, sf_dir, "orders.fasta", lambda p: write_file(records(spark, sf_dir), p, "fasta"))


def documents(spark: SparkSession, sf_dir: str) -> str:
    """documents as FASTA, their texts' lines as the sequences' lines."""
    d = table(spark, sf_dir, "documents").selectExpr("'x' as file", "doc_id as rec_index", "binary('doc ' || doc_id) as id", "binary(coalesce(text, '')) as seq")
    return made(spark, sf_dir, "documents.fasta", lambda p: write_file(d, p, "fasta"))


def lines_file(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame) -> str:
    """A text file of rows (k, value) in order of k."""

    def make(path: str) -> None:
        parts = scratch(spark, "parts")
        rows.repartitionByRange("k").sortWithinPartitions("k").select("value").write.option("lineSep", "\n").text(parts)
        merge_parts(spark, parts, path)

    return made(spark, sf_dir, name, make)


def broken(spark: SparkSession, sf_dir: str) -> str:
    """Orders as FASTQ; of each seven records the first has a bad header, the second a bad separator, the third a quality that is too short."""
    q, s = "repeat('I', length(s))", sequence("o_orderkey")
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", f"{s} as s").selectExpr("k", f"""
        if(k % 7 = 0, 'X', '@') || 'seq.' || k || '\\n' || s || '\\n' || if(k % 7 = 1, '-', '+') || '\\n' || if(k % 7 = 2, substr({q}, 2), {q}) as value""")  # fmt: skip
    return lines_file(spark, sf_dir, "broken.fastq", rows)


def sam(spark: SparkSession, sf_dir: str) -> str:
    """Orders as alignments under two header lines: flags 77 and 141 by turns, every eleventh quality missing."""
    s = sequence("o_orderkey")
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", f"{s} as s").selectExpr("k", """
        concat_ws('\\t', 'seq.' || (k div 2), if(k % 2 = 0, '77', '141'), '*', '0', '0', '*', '*', '0', '0', s, if(k % 11 = 0, '*', repeat('I', length(s)))) as value""")  # fmt: skip
    heads = spark.createDataFrame([(-2, "@HD\tVN:1.6"), (-1, "@CO\tmade")], "k long, value string")
    return lines_file(spark, sf_dir, "orders.sam", rows.union(heads))


def compressed(spark: SparkSession, sf_dir: str) -> str:
    """Orders as gzipped FASTQ under a name that doesn't say so."""

    def make(path: str) -> None:
        parts = scratch(spark, "gz")
        write_records(records(spark, sf_dir), parts, ordered=True, compression="gzip")
        merge_parts(spark, parts, path)

    return made(spark, sf_dir, "orders.data", make)


def encoded(spark: SparkSession, rows: DataFrame, encode: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], path: str, head: bytes = b"") -> None:
    """One file of `head` and the bytes that `encode` makes of each partition of rows, in order of partitions. The workers encode and write.

    Spark's text writer takes the bytes as lines; the newline that it adds behind the last is cut off again.
    """

    def lines(batches):
        held = b""
        for piece in encode(batches):
            *ended, held = (held + piece).split(b"\n")
            for i in range(0, len(ended), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(ended[i : i + 10_000], pa.binary())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], ["value"])

    parts = scratch(spark, "encoded")
    rows.mapInArrow(lines, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(parts)
    merge_parts(spark, parts, path, head, cut=1)


def packed(spark: SparkSession, sf_dir: str, pack: Callable[[bytes], bytes], path: str) -> None:
    """The text of `fastq`, compressed: members of some 4 MB of text each, one behind the other."""

    def members(batches):
        held, n = [], 0
        for batch in batches:
            held += (x + b"\n" for x in batch.column("value").to_pylist())
            n += batch.column("value").nbytes
            if n >= MEMBER_BYTES:
                yield pack(b"".join(held))
                held, n = [], 0
        if held:
            yield pack(b"".join(held))

    rows = to_lines(records(spark, sf_dir), "fastq").repartitionByRange("rec_index").sortWithinPartitions("rec_index")
    encoded(spark, rows.select(F.col("value").cast("binary").alias("value")), members, path)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Bytes from the driver as a file: small ones, and those of a form that Spark can't write."""
    fs, where = file_system(spark, path)
    out = fs.create(where)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def bam(spark: SparkSession, sf_dir: str) -> str:
    """The alignments of `sam` as BAM: gzip members of many records each, made by the workers behind one that holds the header."""

    def members(batches):
        codes = bytes.maketrans(b"=ACMGRSVTWYHKDBN", b"0123456789abcdef")
        body = bytearray()
        for batch in batches:
            for k, s in zip(batch.column("k").to_pylist(), batch.column("s").to_pylist(), strict=True):
                n = len(s)
                digits = s.translate(codes)
                name = b"seq.%d\0" % (k // 2)
                qual = (b"\xff" if k % 11 == 0 else b"\x28") * n  # 40, I in SAM
                one = struct.pack("<iiBBHHHiiii", -1, -1, len(name), 0, 0, 0, 141 if k % 2 else 77, n, -1, -1, 0) + name + bytes.fromhex((digits if n % 2 == 0 else digits + b"0").decode()) + qual
                body += struct.pack("<i", len(one)) + one
                if len(body) > 60_000:
                    yield gzip.compress(body)
                    body.clear()
        if body:
            yield gzip.compress(body)

    head = gzip.compress(b"BAM\x01" + struct.pack("<i", 4) + b"@CO\t" + struct.pack("<i", 0))
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as k", f"binary({sequence('o_orderkey')}) as s").repartitionByRange("k").sortWithinPartitions("k")
    return made(spark, sf_dir, "orders.bam", lambda p: encoded(spark, rows, members, p, head))
