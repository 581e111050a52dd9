"""User-defined map-reduce: a processor is cloned for each task, sees its batches, and gives rows of partial results to aggregate.

Tasks may be run again, so what counts is the rows that a processor returns; side effects happen at least once.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


class Processor:
    """Override process_record or process_batch, and on_complete to return rows (dicts of the result's columns).

    A row may be a record, a pair (r1, r2) or a group (members): each is a dict. Every task begins with a pristine copy of the processor.
    """

    #: Whether rows are to come in order of file and rec_index within each task.
    requires_ordering = False
    worker_id: int = 0

    def process_record(self, row: dict[str, Any]) -> None:
        raise NotImplementedError

    def process_batch(self, rows: Iterable[dict[str, Any]]) -> None:
        for row in rows:
            self.process_record(row)

    def on_batch_complete(self) -> Iterable[dict[str, Any]]:
        """Rows to emit after a batch."""
        return ()

    def on_complete(self) -> Iterable[dict[str, Any]]:
        """Rows to emit after a task's last batch."""
        return ()


class FunctionProcessor(Processor):
    """A function of a batch's rows that returns rows."""

    def __init__(self, function: Callable[[Iterator[dict[str, Any]]], Iterable[dict[str, Any]] | None]):
        self.function, self.held = function, []

    def process_batch(self, rows):
        self.held = list(self.function(iter(rows)) or ())

    def on_batch_complete(self):
        out, self.held = self.held, []
        return out


def process(rows: DataFrame, processor: Processor | Callable, schema: str) -> DataFrame:
    """What the processor emits over all rows, as a DataFrame of the schema. An exception in it fails the job."""
    first = processor if isinstance(processor, Processor) else FunctionProcessor(processor)
    if first.requires_ordering:
        keys = [c for c in ("group_id", "file", "rec_index") if c in rows.columns]
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = _arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.deepcopy(first)
        context = TaskContext.get()
        own.worker_id = context.partitionId() if context else 0
        for batch in batches:
            own.process_batch(iter(batch.to_pylist()))
            if found := list(own.on_batch_complete()):
                yield pa.RecordBatch.from_pylist(found, kinds)
        if found := list(own.on_complete()):
            yield pa.RecordBatch.from_pylist(found, kinds)

    return rows.mapInArrow(run, schema)


def _arrow_schema(rows: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
