"""Column functions over records, all JVM only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRED, FIRST, LAST = 0x1, 0x40, 0x80
DEFAULT_QUALITY = "?"
NUCLEOTIDES = "ACGTNacgtn"


def as_text(c: str | Column) -> Column:
    """A binary field as a string; bytes that aren't UTF-8 are an error."""
    return F.validate_utf8((F.col(c) if isinstance(c, str) else c).cast("string"))


def qual_text(c: str | Column = "qual") -> Column:
    return F.coalesce(as_text(c), F.lit(""))


def seq_length(c: str | Column = "seq") -> Column:
    return F.octet_length(c)


def strip_newlines(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(c.cast("string"), F.lit("\n"), F.lit("")).cast("binary")


def byte_sum(c: str | Column = "seq") -> Column:
    """The sum of a field's byte values, for any bytes.

    Of nucleotides each letter's count is how much shorter the field gets without it. A field with any other byte is summed byte by byte.
    """
    c = F.col(c) if isinstance(c, str) else c
    text, n = c.cast("string"), F.octet_length(c)
    letters = reduce(add, ((n - F.octet_length(F.replace(text, F.lit(x), F.lit("")))) * ord(x) for x in NUCLEOTIDES))
    return F.when(text.rlike(f"[^{NUCLEOTIDES}]"), _each_byte(c)).otherwise(letters.cast("long"))


def _each_byte(c: Column) -> Column:
    pairs = F.split(F.regexp_replace(F.hex(c), "(..)(?=.)", "$1 "), " ")
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda total, x: total + F.conv(x, 16, 10).cast("long"))


def phred33(c: str | Column) -> Column:
    """Phred scores (one byte each) as printable qualities; an empty or missing field is null."""
    c = F.col(c) if isinstance(c, str) else c
    values = F.transform(F.split(F.regexp_replace(F.hex(c), "(..)(?=.)", "$1 "), " "), lambda x: F.char((F.conv(x, 16, 10).cast("int") + 33)))
    return F.when(F.octet_length(c) > 0, F.array_join(values, "").cast("binary"))


def default_quality(qual: str | Column = "qual", seq: str | Column = "seq") -> Column:
    qual = F.col(qual) if isinstance(qual, str) else qual
    return F.coalesce(qual, F.repeat(F.lit(DEFAULT_QUALITY), F.octet_length(seq)).cast("binary"))


def fasta_line(record: str | Column | None = None) -> Column:
    """A record as FASTA, its sequence on one line, without the last newline."""
    g = _getter(record)
    return F.concat(F.lit(b">"), g("id"), F.lit(b"\n"), g("seq"))


def fastq_line(record: str | Column | None = None) -> Column:
    """A record as FASTQ without the last newline: the separator is bare, a missing quality is filled in."""
    g = _getter(record)
    return F.concat(F.lit(b"@"), g("id"), F.lit(b"\n"), g("seq"), F.lit(b"\n+\n"), default_quality(g("qual"), g("seq")))


def _getter(record):
    if record is None:
        return F.col
    c = F.col(record) if isinstance(record, str) else record
    return c.getField


def has_flag(c: str | Column, bit: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit(bit)) != 0


def batch_records(bases: int, length: Column) -> Column:
    """Records of a length that hold `bases`, rounded up; 1 for an empty one."""
    return F.when(length > 0, F.ceil(F.lit(bases) / length)).otherwise(F.lit(1)).cast("long")
