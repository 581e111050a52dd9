"""Paths in the folder that driver and executors share, and small reads through Hadoop's file systems."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from seqloom.errors import ConfigurationError

#: Bytes that are held at once where a file passes through the driver.
PIECE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only in local mode (tests), where driver and executors are one machine, is a folder made and set if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ConfigurationError(f"spark.checkpoint.dir must name a folder that driver and executors share: the master is {spark.sparkContext.master}")
        found = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def has_file_system(spark: SparkSession, scheme: str) -> bool:
    """Whether Hadoop knows a file system for a scheme."""
    try:
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getFileSystemClass(scheme, spark.sparkContext._jsc.hadoopConfiguration())
    except Py4JJavaError:
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    try:
        fs, where = file_system(spark, path)
        fs.delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/seqloom-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def list_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the files that paths, folders and globs name, in the order given; names that begin with _ or . are passed over in folders."""
    out = []
    for path in paths:
        fs, where = file_system(spark, path)
        found = fs.globStatus(where)
        if not found:
            raise FileNotFoundError(path)
        for status in sorted(found, key=lambda s: s.getPath().toString()):
            inside = sorted(fs.listStatus(status.getPath()), key=lambda s: s.getPath().toString()) if status.isDirectory() else [status]
            out += [(s.getPath().toString(), s.getLen()) for s in inside if s.isFile() and (s is status or s.getPath().getName()[0] not in "_.")]
    return out


def read_bytes(spark: SparkSession, path: str, at: int, n: int) -> bytes:
    """Up to n bytes of a file from a position."""
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    try:
        stream.seek(at)
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


class Pieces(io.RawIOBase):
    """Pieces of bytes as a stream; one is held at a time."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.held = memoryview(piece)
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


def open_bytes(spark: SparkSession, path: str):
    """A file's bytes as a stream on the driver, in bounded memory."""
    fs, where = file_system(spark, path)
    if fs.getScheme() == "file":
        return open(where.toUri().getPath(), "rb")

    def pieces():
        stream, left = fs.open(where), fs.getFileStatus(where).getLen()
        try:
            while left:
                piece = bytes(stream.readNBytes(min(PIECE, left)))
                if not piece:
                    raise EOFError(f"{path} ends {left} bytes early")
                left -= len(piece)
                yield piece
        finally:
            stream.close()

    return io.BufferedReader(Pieces(pieces()), PIECE)


def write_bytes(spark: SparkSession, path: str, stream) -> None:
    """A stream's bytes as a new file, in bounded memory."""
    fs, where = file_system(spark, path)
    if fs.getScheme() == "file":
        fs.mkdirs(where.getParent())
        with open(where.toUri().getPath(), "xb") as out:
            shutil.copyfileobj(stream, out, PIECE)
        return
    with tempfile.NamedTemporaryFile() as spool:
        shutil.copyfileobj(stream, spool, PIECE)
        spool.flush()
        fs.copyFromLocalFile(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{spool.name}"), where)
