"""One entry for all inputs: files, folders, globs, standard input, bytes and remote addresses."""

from __future__ import annotations

import io
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.errors import FastxFormatError
from seqloom.schema import BAM, DROPMALFORMED, FASTA, FASTQ, PERMISSIVE, SAM, ReadOptions, batch_for_bases
from seqloom.sources import plain
from seqloom.sources.codec import BLOCK_BYTES, MAGIC_BYTES, beginning, decompressed, sniff
from seqloom.sources.datasource import load
from seqloom.sources.parse import sniff_format
from seqloom.sources.remote import is_remote, local_path
from seqloom.sources.splits import load_splits, packed, plan_splits
from seqloom.sources.stored import load_stored
from seqloom.storage import PIECE, Pieces, has_file_system, list_files, read_bytes, scratch, write_bytes


def _peek(spark: SparkSession, path: str, kind: str) -> tuple[str | None, str]:
    """(codec, format) of a file by its first bytes; an empty file has no format unless one was asked for."""
    head = read_bytes(spark, path, 0, MAGIC_BYTES)
    codec = sniff(head)
    if codec is None:
        return None, kind if kind != "auto" or not head else sniff_format(head)
    return codec, sniff_format(beginning(read_bytes(spark, path, 0, BLOCK_BYTES), 1)) if kind == "auto" else kind


def streams(spark: SparkSession, path: str, open_options: dict | None) -> bool:
    """Whether a path is an address that one task streams: http(s) and ssh always; gs only without a Hadoop file system for it, or with options for gcloud."""
    return is_remote(path) and not (path.startswith("gs://") and not open_options and has_file_system(spark, "gs"))


def read_groups(spark: SparkSession, paths: str | list[str], arity: int, *, open_options: dict | None = None, **options) -> DataFrame:
    """(file, rec_index, members): what combine.interleaved_multi gives of read_fastx, framed where records are read, without a shuffle.

    A group is read where its first record begins. What only Spark opens, and records of which some are dropped, are grouped by the shuffle.
    """
    if arity < 1:
        raise ValueError("a group has at least one record")
    opts = ReadOptions.of(options)
    given = [paths] if isinstance(paths, str) else list(paths)
    read = [p for path in given for p in ([path] if streams(spark, path, open_options) else [f for f, _ in list_files(spark, [path])])]
    whole = opts.record_limit is None or opts.record_limit % arity == 0
    if whole and opts.mode != DROPMALFORMED and all(is_remote(p) or local_path(p) is not None for p in read):
        return read_fastx(spark, paths, open_options=open_options, _arity=arity, **options)
    from seqloom.operators.combine import interleaved_multi

    return interleaved_multi(read_fastx(spark, paths, open_options=open_options, **options), arity)


def read_fastx(spark: SparkSession, paths: str | list[str], *, open_options: dict | None = None, _arity: int = 0, **options) -> DataFrame:
    """Records of FASTA and FASTQ files; see RECORD_SCHEMA and ReadOptions.

    Plain files are split, and their splits fixed here: by the workers themselves where these can open a path, else by Spark's reader. Compressed ones
    and addresses are streamed, one to a task. format="auto" looks at each file's first byte and refuses an empty file; a named format reads it as no
    records. A format that is asked for is held against the first byte of plain FASTQ by validation.
    """
    opts = ReadOptions.of(options)
    given = [paths] if isinstance(paths, str) else list(paths)
    if not given:
        raise ValueError("no paths")
    own: dict[str, list[tuple[str, int]]] = {}  # workers open these
    spark_own: dict[str, list[str]] = {}  # only Spark opens these
    stream: dict[str, list[str]] = {}
    stored: dict[str, list[str]] = {}
    for path in given:
        if streams(spark, path, open_options):
            stream.setdefault(opts.format, []).append(path)
            continue
        for file, size in list_files(spark, [path]):
            local = local_path(file) is not None
            if not size:
                if opts.format == "auto":
                    raise FastxFormatError(f"an empty file has no format: {file}")
                own.setdefault(opts.format, []).append((file, 0))
                continue
            codec, kind = _peek(spark, file, opts.format)
            if codec is not None:
                (stream if local else stored).setdefault(kind, []).append(file)
            elif local:
                own.setdefault(kind, []).append((file, size))
            else:
                spark_own.setdefault(kind, []).append(file)
    parts = []
    for kind, files in own.items():
        parts.append(load_splits(spark, files, kind, opts, _batch(opts, lambda kind=kind, files=files: load_splits(spark, files[:1], kind, _PEEK, 1)), _arity))
    for kind, files in spark_own.items():
        found = {FASTQ: plain.read_fastq, FASTA: plain.read_fasta}[kind](spark, files, opts.mode)
        found = found if opts.record_limit is None else found.where(F.col("rec_index") < opts.record_limit)
        parts.append(found if opts.columns is None else found.select(*(c for c in found.columns if c in ("file", "rec_index", *opts.columns, "_error"))))
    for kind, files in stream.items():
        parts.append(load(spark, files, opts, kind, _batch(opts, lambda kind=kind, files=files: load(spark, files[:1], _PEEK, kind, 1, **(open_options or {}))), arity=_arity, **(open_options or {})))
    for kind, files in stored.items():
        parts.append(load_stored(spark, files, kind, opts, _batch(opts, lambda kind=kind, files=files: load_stored(spark, files[:1], kind, _PEEK, 1))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: For the first record of a file.
_PEEK = ReadOptions(mode=PERMISSIVE, record_limit=1)


def _batch(opts: ReadOptions, first: Callable[[], DataFrame]) -> int:
    """Records in a batch: as asked for, or as many of the first one's length as hold the bases asked for."""
    if not opts.bases_per_batch:
        return opts.records_per_batch
    row = first().select(F.octet_length("seq_raw").alias("n")).first()
    return batch_for_bases(opts.bases_per_batch, row.n if row else 0)


def read_zipped(spark: SparkSession, groups: list[list[str]], grouped: bool = False, **options) -> DataFrame | None:
    """(rec_index, r1, r2, …) of files in step, read in step: what combine.multi gives of their records, without a shuffle. grouped: with a group_id.

    The ranges of records of one file's splits are looked up in the others' counts, so of those at most a split more is passed over for each. Compressed
    files are streamed from their beginning, a group to a task. None if only Spark opens some file, or records may be dropped: then combine.multi has
    to join them.
    """
    opts = ReadOptions.of(options)
    if len({len(g) for g in groups}) != 1 or not groups[0]:
        raise ValueError("groups of the same number of files are read in step")
    if opts.mode == DROPMALFORMED:
        return None
    tuples, plain_files = [], {}
    for group in groups:
        sides = []
        for path in group:
            if is_remote(path):
                return None
            (file, size), *more = list_files(spark, [path])
            if more or local_path(file) is None:
                return None
            if not size and opts.format == "auto":
                raise FastxFormatError(f"an empty file has no format: {file}")
            codec, kind = _peek(spark, file, opts.format) if size else (None, opts.format)
            sides.append((file, kind, codec is not None))
            if codec is None:
                plain_files.setdefault(kind, {})[file] = size
        tuples.append(sides)
    split = {file for sides in tuples if not any(whole for *_, whole in sides) for file, *_ in sides}
    splits = [s for kind, files in plain_files.items() for s in plan_splits(spark, [(f, n) for f, n in files.items() if f in split], kind)]
    return load(spark, [], opts, "zip", opts.records_per_batch, splits=packed(splits), tuples=tuples, grouped=grouped)


def batch_size(records: DataFrame, bases: int) -> int:
    """How many records of the first one's length hold `bases`."""
    row = records.where("rec_index = 0").select(F.octet_length("seq_raw").alias("n")).first()
    return batch_for_bases(bases, row.n if row else 0)


def read_fasta(spark: SparkSession, paths, **options) -> DataFrame:
    return read_fastx(spark, paths, format=FASTA, **options)


def read_fastq(spark: SparkSession, paths, **options) -> DataFrame:
    return read_fastx(spark, paths, format=FASTQ, **options)


def expect_format(records: DataFrame, kind: str) -> DataFrame:
    """The records, all of one format; another is an error, whatever is asked of them."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {kind}, found "), F.col("format"), F.lit(" in "), F.col("file")))
    return records.where(F.when(F.col("format") == kind, F.lit(True)).otherwise(wrong.cast("boolean")))


def from_bytes(spark: SparkSession, data: bytes | Iterable[bytes], **options) -> DataFrame:
    """Records of bytes in memory, whole or in pieces as they come, by a file in the shared folder, which holds them decompressed: so it can be split."""
    path = scratch(spark, "bytes")
    whole = isinstance(data, (bytes, bytearray, memoryview))
    write_bytes(spark, path, decompressed(io.BytesIO(data) if whole else io.BufferedReader(Pieces(iter(data)), PIECE)))
    return read_fastx(spark, path, **options)


def from_stdin(spark: SparkSession, stream=None, **options) -> DataFrame:
    """Records of the driver's standard input, which is first written to a file in the shared folder, decompressed: so it can be split."""
    path = scratch(spark, "stdin")
    write_bytes(spark, path, decompressed(stream or sys.stdin.buffer))
    return read_fastx(spark, path, **options)


def from_optional_path(spark: SparkSession, path: str | None, **options) -> DataFrame:
    return from_stdin(spark, **options) if path is None else read_fastx(spark, path, **options)


def from_url(spark: SparkSession, url: str, **options) -> DataFrame:
    return read_fastx(spark, url, **options)


def from_ssh(spark: SparkSession, url: str, ssh_args: list[str] | None = None, **options) -> DataFrame:
    """ssh:// addresses, and the short form host:path."""
    from seqloom.sources.remote import SshUrl

    u = SshUrl.parse(url)
    if not url.startswith("ssh://"):
        path = u.path if u.path.startswith("/") else f"/./{u.path}"
        url = f"ssh://{u.ssh_host}{path}"
    return read_fastx(spark, url, open_options={"ssh_args": list(ssh_args or [])}, **options)


def from_gcs(spark: SparkSession, url: str, gcloud_args: list[str] | None = None, project: str | None = None, billing_project: str | None = None, impersonate: str | None = None, **options) -> DataFrame:
    from seqloom.sources.remote import GcsUrl

    named = {"project": project, "billing_project": billing_project, "impersonate": impersonate}
    found = {k: v for k, v in (named | {"gcloud_args": list(gcloud_args or [])}).items() if v}
    return read_fastx(spark, GcsUrl.parse(url).gs_path, open_options=found, **options)


def read_alignments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignments of SAM (plain or compressed) and BAM files, with `flag`. CRAM needs its reference sequences and is refused."""
    own, spark_own, stream, stored = [], [], {}, {}
    for file, size in list_files(spark, [paths] if isinstance(paths, str) else list(paths)):
        head, local = read_bytes(spark, file, 0, MAGIC_BYTES), local_path(file) is not None
        if head.startswith(b"CRAM"):
            raise FastxFormatError(f"CRAM is not supported: {file}")
        if not sniff(head):
            own.append((file, size)) if local else spark_own.append(file)
            continue
        kind = BAM if beginning(read_bytes(spark, file, 0, BLOCK_BYTES), 4) == b"BAM\x01" else SAM
        (stream if local else stored).setdefault(kind, []).append(file)
    options, parts = ReadOptions(), []
    if own:
        parts.append(load_splits(spark, own, SAM, options, 1024))
    if spark_own:
        parts.append(plain.read_sam(spark, spark_own))
    parts += [load(spark, files, options, kind, 1024) for kind, files in stream.items()]
    parts += [load_stored(spark, files, kind, options, 1024) for kind, files in stored.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
