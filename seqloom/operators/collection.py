"""Many files as one table: single, in pairs or groups of consecutive files, or interleaved."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.errors import CollectionSizeMismatchError
from seqloom.operators import combine
from seqloom.operators.ranges import take_range
from seqloom.sources.plain import BLOCK_TABLE_BYTES
from seqloom.sources.reader import read_fastx, read_groups, streams
from seqloom.storage import list_files

KINDS = ("single", "paired", "interleaved", "multi", "interleaved_multi")


@dataclass
class Collection:
    """paths in order; kind: one of KINDS; arity: files (multi) or records (interleaved_multi) in a group.

    One job reads all files; the scheduler spreads it, so there is no budget of threads for each.
    """

    spark: SparkSession
    paths: list[str]
    kind: str = "single"
    arity: int = 2
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind {self.kind!r} is not one of {', '.join(KINDS)}")
        if not self.paths:
            raise CollectionSizeMismatchError(1, 0)
        if self.arity < 1:
            raise ValueError("a group has at least one member")
        self._fits(self.files_in_group)

    @property
    def files_in_group(self) -> int:
        return {"paired": 2, "multi": self.arity}.get(self.kind, 1)

    def _fits(self, n: int) -> None:
        if len(self.paths) % n:
            raise CollectionSizeMismatchError(n, len(self.paths))

    def limited(self, n: int) -> Collection:
        return Collection(self.spark, self.paths, self.kind, self.arity, self.options | {"record_limit": n})

    def _ordered(self, read: Callable[..., DataFrame], *args) -> DataFrame:
        """What read gives of all files, with file_ord, the file's place in the collection."""
        names = [(f, i) for i, p in enumerate(self.paths) for f, _ in ([(p, 0)] if streams(self.spark, p, None) else list_files(self.spark, [p]))]
        order = self.spark.createDataFrame(names, "named string, file_ord int")  # a row for each path given, so a path may come twice
        files = list(dict.fromkeys(f for f, _ in names))
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
        rows = read(self.spark, files, *args, **self.options)
        # A row for each file: broadcast while that is small, as measured.
        small = sum(len(f) + 64 for f, _ in names) <= BLOCK_TABLE_BYTES
        return rows.join(F.broadcast(order) if small else order, plain(F.col("file")) == plain(F.col("named"))).drop("named")

    def records(self) -> DataFrame:
        """All records with file_ord, the file's place in the collection."""
        return self._ordered(read_fastx)

    def _in_step(self, n: int) -> DataFrame:
        self._fits(n)
        return combine.read_in_step(self.spark, [self.paths[i : i + n] for i in range(0, len(self.paths), n)], grouped=True, **self.options)

    def _warn(self, kind: str) -> None:
        if kind != self.kind:
            warnings.warn(f"a {self.kind} collection is read as {kind}", stacklevel=3)

    def single(self, start: int | None = None, end: int | None = None) -> DataFrame:
        self._warn("single")
        return take_range(self.records(), start, end)

    def paired(self, start: int | None = None, end: int | None = None) -> DataFrame:
        self._warn("paired")
        return take_range(self._in_step(2), start, end)

    def multi(self, start: int | None = None, end: int | None = None) -> DataFrame:
        self._warn("multi")
        return take_range(self._in_step(self.arity), start, end)

    def interleaved(self, start: int | None = None, end: int | None = None) -> DataFrame:
        self._warn("interleaved")
        pairs = self._ordered(read_groups, 2)
        return take_range(pairs.select("file", "rec_index", F.col("members")[0].alias("r1"), F.col("members")[1].alias("r2"), "file_ord"), start, end)

    def interleaved_multi(self, start: int | None = None, end: int | None = None) -> DataFrame:
        self._warn("interleaved_multi")
        return take_range(self._ordered(read_groups, self.arity), start, end)

    def unique_format(self) -> str | None:
        """The format of all files, or None if they differ; one row for each format comes to the driver."""
        found = [r.format for r in self.records().select("format").distinct().collect()]
        return found[0] if len(found) == 1 else None
