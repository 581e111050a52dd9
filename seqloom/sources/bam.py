"""BAM records from a plain (decompressed) stream; BGZF is gzip members in a row, which the codec reads as one."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa

from seqloom.errors import FastxFormatError

#: A base is half a byte, so a hexadecimal digit.
_BASES = str.maketrans("0123456789abcdef", "=ACMGRSVTWYHKDBN")
_PHRED33 = bytes(min(q + 33, 255) for q in range(256))


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    while len(data) < n and (more := stream.read(n - len(data))):
        data += more
    if len(data) < n:
        raise FastxFormatError("a BAM record is cut short")
    return data


def alignments(stream) -> Iterator[tuple[bytes, int, bytes, bytes | None]]:
    """(name, flag, sequence, quality) in file order. Quality is phred + 33; where it is missing (0xFF throughout), or empty, None."""
    if _exactly(stream, 4) != b"BAM\x01":
        raise FastxFormatError("not a BAM file")
    _exactly(stream, struct.unpack("<i", _exactly(stream, 4))[0])
    for _ in range(struct.unpack("<i", _exactly(stream, 4))[0]):
        _exactly(stream, struct.unpack("<i", _exactly(stream, 4))[0] + 4)
    while head := stream.read(4):
        size = struct.unpack("<i", head + _exactly(stream, 4 - len(head)) if len(head) < 4 else head)[0]
        data = _exactly(stream, size)
        name_len, n_cigar, flag, n_bases = data[8], *struct.unpack_from("<HHi", data, 12)
        at = 32 + name_len
        name, at = data[32 : at - 1], at + 4 * n_cigar
        half = (n_bases + 1) // 2
        seq = data[at : at + half].hex().translate(_BASES)[:n_bases].encode()
        qual = data[at + half : at + half + n_bases]
        missing = not qual or qual == b"\xff" * n_bases
        yield name, flag, seq, None if missing else qual.translate(_PHRED33)


def batches(stream, file: str, start: int = 0, stop: int | None = None, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes, int, bytes, bytes | None]] = []

    def out():
        index, name, flag, seq, qual = (list(c) for c in zip(*held, strict=True))
        n = len(held)
        columns = {
            "file": pa.array([file] * n), "rec_index": pa.array(index, pa.int64()), "id": pa.array(name, pa.binary()), "seq": pa.array(seq, pa.binary()), "seq_raw": pa.nulls(n, pa.binary()),
            "qual": pa.array(qual, pa.binary()), "sep": pa.nulls(n, pa.binary()), "format": pa.array(["bam"] * n), "flag": pa.array(flag, pa.int32()),
        }
        held.clear()
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    for i, (name, flag, seq, qual) in enumerate(alignments(stream)):
        if stop is not None and i >= stop:
            break
        if i >= start:
            held.append((i, name, flag, seq, qual))
            if len(held) >= size:
                yield out()
    if held:
        yield out()
