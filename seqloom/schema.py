"""The record schema and the options of the readers."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

FASTA, FASTQ, SAM, BAM = "fasta", "fastq", "sam", "bam"
DEFAULT_BATCH = 1024

RECORD_SCHEMA = StructType(
    [
        StructField("file", StringType(), False),
        StructField("rec_index", LongType(), False),  # 0-based in the file, whatever the partitioning
        StructField("id", BinaryType(), True),  # the whole header line without its sign
        StructField("seq", BinaryType(), True),
        StructField("seq_raw", BinaryType(), True),  # with the line ends inside
        StructField("qual", BinaryType(), True),
        StructField("sep", BinaryType(), True),
        StructField("format", StringType(), False),
    ]
)
ERROR_FIELD = StructField("_error", StringType(), True)
FLAG_FIELD = StructField("flag", IntegerType(), True)
RECORD_COLUMNS = RECORD_SCHEMA.fieldNames()

FAILFAST, PERMISSIVE, DROPMALFORMED = "FAILFAST", "PERMISSIVE", "DROPMALFORMED"


@dataclass(frozen=True)
class ReadOptions:
    """format: auto, fasta or fastq. mode: what to do with invalid records. record_limit: the first n records of each file.

    columns: which of a record's fields are built, besides file and rec_index; all if None. Readers in Python can't tell what a query leaves out.
    records_per_batch or bases_per_batch (divided by the first sequence's length, rounded up) set the rows of a batch.
    """

    format: str = "auto"
    mode: str = FAILFAST
    record_limit: int | None = None
    records_per_batch: int = DEFAULT_BATCH
    bases_per_batch: int | None = None
    columns: list[str] | None = None

    def __post_init__(self):
        if self.format not in ("auto", FASTA, FASTQ):
            raise ValueError(f"format {self.format!r} is not auto, fasta or fastq")
        if self.mode not in (FAILFAST, PERMISSIVE, DROPMALFORMED):
            raise ValueError(f"mode {self.mode!r} is not FAILFAST, PERMISSIVE or DROPMALFORMED")
        if self.records_per_batch <= 0 or (self.bases_per_batch is not None and self.bases_per_batch <= 0):
            raise ValueError("a batch has at least one record")
        if self.columns is not None and (unknown := set(self.columns) - set(RECORD_COLUMNS)):
            raise ValueError(f"a record has no {', '.join(sorted(unknown))}")
        if self.record_limit is not None and self.record_limit < 0:
            raise ValueError("record_limit is negative")

    def fields(self, extra: list[StructField] = ()) -> list[StructField]:
        """The fields of a record that are wanted, and extra ones."""
        return [f for f in RECORD_SCHEMA.fields if self.columns is None or f.name in ("file", "rec_index", *self.columns)] + list(extra)

    @classmethod
    def of(cls, options: dict) -> ReadOptions:
        unknown = options.keys() - {f.name for f in fields(cls)}
        if unknown:
            raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**options)


def batch_for_bases(bases: int, first_length: int) -> int:
    """Records of the first one's length that hold `bases`, rounded up; 1 if that is empty."""
    return -(-bases // first_length) if first_length else 1
