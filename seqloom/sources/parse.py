"""The formats themselves: streams of bytes to batches of records. Every reader's results are held against these.

FASTQ has four lines to a record whatever is in them; an unterminated fourth line counts at the end, and anything shorter is passed over. FASTA
records begin with > at a line's start; what comes before the first is passed over. Lines end with a newline only: a carriage return is data.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seqloom.errors import RECORD_ERRORS, ArityError, FastxFormatError, LengthMismatchError
from seqloom.schema import DROPMALFORMED, FAILFAST, FASTA, FASTQ, PERMISSIVE, SAM

CHUNK = 4 << 20
#: Rows that are built at once where batches are smaller.
BUILT = 4096
_NEWLINE, _GREATER, _AT, _PLUS = b"\n>@+"


def sniff_format(first: bytes) -> str:
    """The format of a file by its first byte."""
    if first[:1] == b"@":
        return FASTQ
    if first[:1] == b">":
        return FASTA
    raise FastxFormatError(f"a file begins with {first[:1]!r}, not with > or @" if first else "an empty file has no format")


def _begun_lines(data: bytes, at: int, end: int, position: int) -> np.ndarray:
    """Where lines begin in data, whose first byte stands at `position` of its file, with at <= place < end. Data begins a byte before `at`, or both at 0."""
    found = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == _NEWLINE) + (position + 1)
    found = np.concatenate([[0], found]) if position == 0 and at == 0 else found
    return found[(found >= at) & (found < end)]


def count_begun(stream, kind: str, at: int, end: int) -> int:
    """How many lines (FASTQ), records (FASTA) or alignments (SAM) begin in at <= place < end. The stream stands a byte before `at`, or at 0."""
    position, n, last = max(at - 1, 0), 0, b"\n" if at == 0 else b""
    try:
        # A line that begins in the range may do so at its last byte, so what it begins with is always within.
        while position < end and (data := stream.read(min(CHUNK, end - position))):
            if kind == FASTQ:
                n += data.count(b"\n", 0, len(data) - (position + len(data) == end)) + (position == 0 and at == 0)
            else:
                whole = last + data
                begun = np.frombuffer(whole, dtype=np.uint8)
                firsts = begun[1:][begun[:-1] == _NEWLINE]
                n += int((firsts == _GREATER).sum()) if kind == FASTA else int(((firsts != _AT) & (firsts != _NEWLINE)).sum())
                last = data[-1:]
            position += len(data)
    finally:
        stream.close()
    return n


class _Window:
    """A stream's bytes from a place on: `data` begins at `position`; more() adds the next ones, as many again where a record is longer than what is held."""

    def __init__(self, stream, at: int):
        self.stream, self.data, self.position, self.ended = stream, b"", at, False

    def more(self) -> None:
        chunk = self.stream.read(max(CHUNK, len(self.data)))
        self.ended = not chunk
        self.data += chunk

    def drop(self, n: int) -> None:
        self.data, self.position = self.data[n:], self.position + n

    def newlines(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.data, dtype=np.uint8) == _NEWLINE)

    def to_line(self, at: int) -> bool:
        """Goes on to the first line that begins at `at` or later; False if there is none."""
        if at == 0:
            return True
        while (found := self.data.find(b"\n")) < 0:
            self.drop(len(self.data))
            self.more()
            if self.ended:
                return False
        self.drop(found + 1)
        return True


def _pieces(data: bytes, bounds: np.ndarray, n: int, wanted: list[bool]) -> list[pa.Array]:
    """bounds: begin, end, begin, end, … in ascending order, n ranges to a record; an array for each that is wanted, nulls for others."""
    bounds = np.append(bounds, bounds[-1]).astype(np.int32)
    both = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    places = [np.arange(2 * k, len(bounds) - 1, 2 * n) for k in range(n)]
    return [both.take(pa.array(at, pa.int32())) if want else pa.nulls(len(at), pa.binary()) for at, want in zip(places, wanted, strict=True)]


class _Range:
    """Records first <= rec_index < stop, in batches of `size` rows at most; of their fields those named, or all."""

    def __init__(self, first: int, stop: int | None, size: int, fields: Collection[str] | None = None):
        self.first, self.stop, self.size, self.fields = first, stop, size, fields

    def has(self, *names: str) -> bool:
        return self.fields is None or any(n in self.fields for n in names)

    def parts(self, at: int, n: int):
        """(a, b) of the records at, at + 1, … at + n - 1 that are wanted, counted from the first of them."""
        low, high = max(self.first - at, 0), n if self.stop is None else min(n, self.stop - at)
        for a in range(low, high, self.size):
            yield a, min(high, a + self.size)

    def over(self, at: int) -> bool:
        return self.stop is not None and at >= self.stop


def _fastq(w: _Window, file: str, mode: str, want: _Range, at: int, end: int | None, line: int) -> Iterator[pa.RecordBatch]:
    if not w.to_line(at):
        return
    skip, index = -line % 4, (line + 3) // 4
    while not want.over(index):
        nl = w.newlines()
        if skip:  # lines that finish the record before
            if len(nl) < skip:
                if w.ended:
                    return
                skip -= len(nl)
                w.drop(int(nl[-1]) + 1 if len(nl) else 0)
                w.more()
                continue
            w.drop(int(nl[skip - 1]) + 1)
            nl, skip = nl[skip:] - (int(nl[skip - 1]) + 1), 0
        n = len(nl) // 4
        begins = np.concatenate([[0], nl[3 : 4 * n : 4] + 1])
        if end is not None:
            n = min(n, int(np.searchsorted(begins + w.position, end)))
        for a, b in want.parts(index, n):
            ends = nl[4 * a : 4 * b]
            lines = np.concatenate([[begins[a]], ends[:-1] + 1])
            yield _fastq_batch(file, index + a, w.data, lines, ends, mode, want)
        index += n
        w.drop(int(begins[n]))
        if (end is not None and w.position >= end) or want.over(index):
            return
        if w.ended:
            nl = w.newlines()
            if len(nl) == 3:  # an unterminated fourth line, which may be empty
                for _ in want.parts(index, 1):
                    yield _fastq_batch(file, index, w.data, np.append(0, nl + 1), np.append(nl, len(w.data)), mode, want)
            return
        w.more()


def _fastq_batch(file: str, first: int, data: bytes, begins: np.ndarray, ends: np.ndarray, mode: str, want: _Range) -> pa.RecordBatch:
    """A batch from the places of the lines of consecutive records."""
    buf = np.frombuffer(data, dtype=np.uint8)
    starts_with = lambda k, sign: (ends[k::4] > begins[k::4]) & (buf[np.minimum(begins[k::4], len(buf) - 1)] == sign)
    lengths = ends - begins
    error = np.select([~starts_with(0, _AT), ~starts_with(2, _PLUS), lengths[1::4] != lengths[3::4]], [1, 2, 3], 0)
    bounds = np.stack([begins, ends], axis=1)
    bounds[::4, 0] = np.minimum(bounds[::4, 0] + 1, bounds[::4, 1])
    header, seq, sep, qual = _pieces(data, bounds.ravel(), 4, [want.has("id"), want.has("seq", "seq_raw"), want.has("sep"), want.has("qual")])
    errors = pa.DictionaryArray.from_arrays(pa.array(error - 1, pa.int32(), mask=error == 0), pa.array(list(RECORD_ERRORS))).dictionary_decode()
    return _batch(file, pa.array(np.arange(first, first + len(header)), pa.int64()), header, seq, seq, qual, sep, FASTQ, errors, mode)


def _fasta(w: _Window, file: str, want: _Range, at: int, end: int | None, index: int) -> Iterator[pa.RecordBatch]:
    begun = False
    while not want.over(index):
        data = w.data
        buf = np.frombuffer(data, dtype=np.uint8)
        signs = np.flatnonzero(buf == _GREATER)
        signs = signs[((signs > 0) & (buf[signs - 1] == _NEWLINE)) | ((signs == 0) & (begun or w.position == 0))]
        if not begun:
            signs = signs[signs + w.position >= at]
            if not len(signs):
                if w.ended or (end is not None and w.position + len(data) > end):
                    return
                w.drop(max(0, len(data) - 1))  # a line end may be cut from its sign
                w.more()
                continue
            begun = True
        begins = signs
        n = len(begins) - 1 + w.ended
        ends = np.append(begins[1:] - 1, len(data) - (data[-1:] == b"\n"))[:n]
        if end is not None:
            n = min(n, int(np.searchsorted(begins + w.position, end)))
        nl = w.newlines() if n else None
        for a, b in want.parts(index, n):
            yield _fasta_batch(file, index + a, data, begins[a:b] + 1, np.maximum(ends[a:b], begins[a:b] + 1), nl, want)
        index += n
        if w.ended or (end is not None and n < len(begins) and begins[n] + w.position >= end):
            return
        w.drop(int(begins[n]))
        w.more()


def _fasta_batch(file: str, first: int, data: bytes, begins: np.ndarray, ends: np.ndarray, nl: np.ndarray, want: _Range) -> pa.RecordBatch:
    at = np.searchsorted(nl, begins)
    header = np.minimum(np.append(nl, len(data))[at], ends)
    raw = np.minimum(header + 1, ends)
    ids, seq_raw = _pieces(data, np.stack([begins, header, raw, ends], axis=1).ravel(), 2, [want.has("id"), want.has("seq", "seq_raw")])
    many = want.has("seq") and (np.searchsorted(nl, ends) > np.searchsorted(nl, raw)).any()
    seq = pc.replace_substring(seq_raw, b"\n", b"") if many else seq_raw
    none = pa.nulls(len(ids), pa.binary())
    return _batch(file, pa.array(np.arange(first, first + len(ids)), pa.int64()), ids, seq, seq_raw, none, none, FASTA, pa.nulls(len(ids), pa.string()), FAILFAST)


def _sam(w: _Window, file: str, want: _Range, at: int, end: int | None, index: int) -> Iterator[pa.RecordBatch]:
    """Alignments, whatever their flags: lines that aren't empty and don't begin with @. * for a missing quality is null."""
    if not w.to_line(at):
        return
    while not want.over(index):
        nl = w.newlines()
        begins = np.concatenate([[0], nl + 1])
        n = len(nl) + (w.ended and begins[-1] < len(w.data))
        if end is not None:
            n = min(n, int(np.searchsorted(begins + w.position, end)))
        lines = [x for x in w.data.split(b"\n", n)[:n] if x and x[:1] != b"@"]
        for a, b in want.parts(index, len(lines)):
            yield _sam_batch(file, index + a, lines[a:b])
        index += len(lines)
        if w.ended or (end is not None and n < len(begins) and begins[n] + w.position >= end):
            return
        w.drop(int(begins[n]))
        w.more()


def _sam_batch(file: str, first: int, lines: list[bytes]) -> pa.RecordBatch:
    rows = [x.split(b"\t", 11) for x in lines]
    if any(len(r) < 11 for r in rows):
        raise FastxFormatError(f"not an alignment: {file}, record {first + next(i for i, r in enumerate(rows) if len(r) < 11)}")
    n, none = len(rows), pa.nulls(len(rows), pa.binary())
    column = lambda k, missing: pa.array([missing if r[k] == b"*" else r[k] for r in rows], pa.binary())
    columns = {
        "file": _same(file, n), "rec_index": pa.array(np.arange(first, first + n), pa.int64()), "id": pa.array([r[0] for r in rows], pa.binary()), "seq": column(9, b""), "seq_raw": none,
        "qual": column(10, None), "sep": none, "format": _same(SAM, n), "flag": pa.array([int(r[1]) for r in rows], pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _same(value: str, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(value, pa.string()), n)


def _batch(file, index, ids, seq, raw, qual, sep, kind, error, mode) -> pa.RecordBatch:
    n = len(index)
    columns = {"file": _same(file, n), "rec_index": index, "id": ids, "seq": seq, "seq_raw": raw, "qual": qual, "sep": sep, "format": _same(kind, n), "_error": error}
    return _held(pa.RecordBatch.from_arrays(list(columns.values()), list(columns)), file, mode)


def _held(batch: pa.RecordBatch, file: str, mode: str) -> pa.RecordBatch:
    """A batch as its errors and the mode leave it."""
    error = batch.column("_error")
    if error.null_count < len(error):
        if mode == FAILFAST:
            at = next(i for i in range(len(error)) if error[i].is_valid)
            raise RECORD_ERRORS[error[at].as_py()](f"{file}, record {batch.column('rec_index')[at].as_py()}: {error[at].as_py()}")
        if mode == DROPMALFORMED:
            batch = batch.filter(pc.is_null(error))
    return batch


def _cut(found: Iterator[pa.RecordBatch], size: int, file: str, mode: str) -> Iterator[pa.RecordBatch]:
    """Batches built in PERMISSIVE mode as those of `size` rows at most, each held against the mode when it is its turn."""
    for batch in found:
        clean = batch.column("_error").null_count == batch.num_rows
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            yield part if clean else _held(part, file, mode)


def batches(stream, file: str, kind: str, mode: str = FAILFAST, start: int = 0, stop: int | None = None, size: int = 1024, at: int = 0, end: int | None = None, before: int = 0, fields: Collection[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of a plain stream, of records start <= rec_index < stop; `size` rows to a batch at most. Reading ends at stop.

    Fields that aren't named are null. Of a split only what begins in at <= place < end is read: its stream stands a byte before `at`, and `before` lines (FASTQ) or records begin before.
    """
    if kind == "auto":
        kind = sniff_format(stream.peek(1)[:1])
    # Small batches are slices of larger ones, whose cost in Python is that of one.
    w, want = _Window(stream, max(at - 1, 0)), _Range(start, stop, -(-BUILT // size) * size if size < BUILT and kind == FASTQ else size, fields)
    if kind == FASTQ:
        yield from _cut(_fastq(w, file, PERMISSIVE, want, at, end, before), size, file, mode)
    elif kind == SAM:
        yield from _sam(w, file, want, at, end, before)
    else:
        yield from _fasta(w, file, want, at, end, before)


def groups(found: Iterator[pa.RecordBatch], arity: int, file: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """(file, rec_index, members): consecutive records, which begin with a group's first, in groups of `arity`. A rest is an error."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in found:
        held.append(batch)
        rows += batch.num_rows
        if rows >= arity:
            whole = pa.concat_batches(held)
            n = rows // arity * arity
            kept = whole.slice(0, n)
            names = ["rec_index", *(c for c in columns if c not in ("file", "rec_index"))]
            members = pa.StructArray.from_arrays([kept.column(c) for c in names], names)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, arity), pa.int32()), members)
            first = pc.divide(whole.column("rec_index").take(pa.array(np.arange(0, n, arity))), arity)
            yield pa.RecordBatch.from_arrays([_same(file, n // arity), first, lists], ["file", "rec_index", "members"])
            held, rows = [whole.slice(n)] if rows > n else [], rows - n
    if rows:
        raise ArityError(f"ARITY_MISMATCH: records aren't a multiple of {arity} in {file}")


def zipped(sides: list[Iterator[pa.RecordBatch]], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """(rec_index, r1, r2, …): records of several files in step, each with these columns. A file that ends before another is an error."""
    held: list[pa.RecordBatch | None] = [None] * len(sides)
    names, at = [f"r{i + 1}" for i in range(len(sides))], None
    while True:
        for i, side in enumerate(sides):
            while held[i] is None or not held[i].num_rows:
                held[i] = next(side, None)
                if held[i] is None:
                    break
        ended = [n for n, h in zip(names, held, strict=True) if h is None]
        if ended:
            if len(ended) < len(sides):
                at = min(h.column("rec_index")[0].as_py() for h in held if h is not None)
                raise LengthMismatchError(f"LENGTH_MISMATCH: fewer records in {', '.join(ended)} at record {at}")
            return
        n = min(h.num_rows for h in held)
        parts = [h.slice(0, n) for h in held]
        held = [h.slice(n) for h in held]
        yield pa.RecordBatch.from_arrays([parts[0].column("rec_index"), *(pa.StructArray.from_arrays([p.column(c) for c in columns], columns) for p in parts)], ["rec_index", *names])
