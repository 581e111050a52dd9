"""Transparent decompression by content: the first bytes decide, not the name."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zlib

MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
MAGIC_BYTES = 6
#: Compressed bytes that hold a first block of any of them.
BLOCK_BYTES = 4 << 20


def sniff(head: bytes) -> str | None:
    """The codec of bytes that begin so; None for plain bytes."""
    return next((name for magic, name in MAGIC.items() if head.startswith(magic)), None)


class _Joined(io.RawIOBase):
    """Bytes put back before a stream."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.head[: len(buffer)] if self.head else self.rest.read(len(buffer))
        if self.head:
            self.head = self.head[len(data) :]
        buffer[: len(data)] = data
        return len(data)


def decompressed(stream) -> io.BufferedReader:
    """A stream of the plain bytes of a stream; several compressed members in a row are read as one."""
    head = b""
    while len(head) < MAGIC_BYTES and (more := stream.read(MAGIC_BYTES - len(head))):
        head += more
    whole = io.BufferedReader(_Joined(head, stream), 1 << 16)
    kind = sniff(head)
    if kind == "gzip":
        return io.BufferedReader(gzip.GzipFile(fileobj=whole), 1 << 20)
    if kind == "bzip2":
        return io.BufferedReader(bz2.BZ2File(whole), 1 << 20)
    if kind == "xz":
        return io.BufferedReader(lzma.LZMAFile(whole), 1 << 20)
    if kind == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True), 1 << 20)
    return whole


def beginning(head: bytes, n: int) -> bytes:
    """The first plain bytes of a file whose first compressed bytes are given."""
    kind = sniff(head)
    if kind == "gzip":
        return zlib.decompressobj(31).decompress(head, n)
    if kind == "bzip2":
        return bz2.BZ2Decompressor().decompress(head, n)
    if kind == "xz":
        return lzma.LZMADecompressor().decompress(head, n)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(head)).read(n)
    return head[:n]
