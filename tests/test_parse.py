"""The parsers on streams: edge cases, and random bytes against line-by-line definitions."""

import bz2
import gzip
import io
import lzma
import random

import pytest
import zstandard

from seqloom import errors
from seqloom.schema import DROPMALFORMED, FAILFAST, FASTA, FASTQ, PERMISSIVE, ReadOptions, batch_for_bases
from seqloom.sources import parse
from seqloom.sources.codec import decompressed


def rows(data, kind, mode=PERMISSIVE, **kinds):
    return [r for b in parse.batches(io.BufferedReader(io.BytesIO(data)), "f", kind, mode, **kinds) for r in b.to_pylist()]


def fields(found, *names):
    return [tuple(r[n] for n in names) for r in found]


FASTQ_CASES = [
    (b"@a b\nACTG\n+x\nIIII\n", [(b"a b", b"ACTG", b"IIII", b"+x", None)]),
    (b"@a\nACTG\n+\nIIII", [(b"a", b"ACTG", b"IIII", b"+", None)]),  # no newline at the end
    (b"", []),
    (b"\n\n", []),
    (b"@a\nAC\n+\nII\n@b\nAC\n+\n", [(b"a", b"AC", b"II", b"+", None), (b"b", b"AC", b"", b"+", "UNEQUAL_LENGTHS")]),  # an empty fourth line
    (b"@a\nAC\n+\nII\n@b\nAC\n+", [(b"a", b"AC", b"II", b"+", None)]),  # a tail of three lines
    (b"Xa\nACTG\n+\nIIII\n", [(b"a", b"ACTG", b"IIII", b"+", "INVALID_HEADER")]),
    (b"@a\nACTG\nX\nIIII\n", [(b"a", b"ACTG", b"IIII", b"X", "INVALID_SEPARATOR")]),
    (b"@a\nACTG\n+\nIII\n", [(b"a", b"ACTG", b"III", b"+", "UNEQUAL_LENGTHS")]),
    (b"@a\n\n+\n\n", [(b"a", b"", b"", b"+", None)]),
    (b"@a\r\nAC\r\n+\r\nII\r\n", [(b"a\r", b"AC\r", b"II\r", b"+\r", None)]),
    (b"@\xff\n\xff\n+\n\xff\n", [(b"\xff", b"\xff", b"\xff", b"+", None)]),
]
FASTA_CASES = [
    (b"XACTG\nTGCA\n", []),
    (b"X\n>a\nACTG\n", [(b"a", b"ACTG", b"ACTG")]),
    (b"\n>a\nAC\n", [(b"a", b"AC", b"AC")]),
    (b">m x\nACTG\nTGCA\nGG\n", [(b"m x", b"ACTGTGCAGG", b"ACTG\nTGCA\nGG")]),
    (b">last\nACTG", [(b"last", b"ACTG", b"ACTG")]),
    (b">last", [(b"last", b"", b"")]),
    (b">", [(b"", b"", b"")]),
    (b">\n>\n>a\nA>C\n\n", [(b"", b"", b""), (b"", b"", b""), (b"a", b"A>C", b"A>C\n")]),
    (b">a\r\nAC\r\nGT\r\n", [(b"a\r", b"AC\rGT\r", b"AC\r\nGT\r")]),
    (b"", []),
]


@pytest.mark.parametrize(("data", "want"), FASTQ_CASES)
def test_fastq(data, want):
    assert fields(rows(data, FASTQ), "id", "seq", "qual", "sep", "_error") == want


@pytest.mark.parametrize(("data", "want"), FASTA_CASES)
def test_fasta(data, want):
    assert fields(rows(data, FASTA), "id", "seq", "seq_raw") == want


@pytest.mark.parametrize(("data", "error"), [(b"Xa\nA\n+\nI\n", errors.InvalidHeaderError), (b"@a\nA\n-\nI\n", errors.InvalidSeparatorError), (b"@a\nAA\n+\nI\n", errors.UnequalLengthsError)])
def test_modes(data, error):
    good = b"@g\nA\n+\nI\n"
    with pytest.raises(error):
        rows(good + data, FASTQ, "FAILFAST")
    assert fields(rows(data + good, FASTQ, DROPMALFORMED), "rec_index", "id") == [(1, b"g")]


def test_auto_format():
    assert rows(b"@a\nA\n+\nI\n", "auto")[0]["format"] == FASTQ and rows(b">a\nA\n", "auto")[0]["format"] == FASTA
    for data in (b"", b"x\n>a\nA\n"):
        with pytest.raises(errors.FastxFormatError):
            rows(data, "auto")


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, bz2.compress, lzma.compress, zstandard.compress, lambda x: gzip.compress(x[:100]) + gzip.compress(x[100:]), lambda x: zstandard.compress(x[:100]) + zstandard.compress(x[100:])])
def test_compression_is_found_by_content(pack):
    data = b"".join(b"@s%d\nACGT\n+\nIIII\n" % i for i in range(500))
    assert decompressed(io.BytesIO(pack(data))).read() == data


def fastq_by_lines(data):
    lines = data.split(b"\n")
    n = len(lines) // 4 if len(lines) % 4 == 0 else (len(lines) - 1) // 4
    return [(lines[4 * i][1:], lines[4 * i + 1], lines[4 * i + 3]) for i in range(n)]


def fasta_by_lines(data):
    out = []
    for i, line in enumerate((data.removesuffix(b"\n") if data else data).split(b"\n")):
        if line[:1] == b">":
            out.append([line[1:], []])
        elif out and (i or data):
            out[-1][1].append(line)
    return [(h, b"".join(s), b"\n".join(s)) for h, s in out]


@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 20])
def test_random_bytes(monkeypatch, chunk):
    monkeypatch.setattr(parse, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(300):
        data = bytes(rng.choice(b"@>+\n\nAC\r\xff") for _ in range(rng.randrange(60)))
        assert fields(rows(data, FASTQ, size=rng.randrange(1, 5)), "id", "seq", "qual") == fastq_by_lines(data)
        assert fields(rows(data, FASTA, size=rng.randrange(1, 5)), "id", "seq", "seq_raw") == fasta_by_lines(data)
        low, high = rng.randrange(4), rng.randrange(5)
        assert fields(rows(data, FASTQ, start=low, stop=high), "rec_index", "seq") == [(i, x[1]) for i, x in enumerate(fastq_by_lines(data))][low:high]


def test_options():
    for bad in ({"format": "sam"}, {"mode": "x"}, {"records_per_batch": 0}, {"bases_per_batch": 0}, {"record_limit": -1}):
        with pytest.raises(ValueError):
            ReadOptions.of(bad)
    with pytest.raises(TypeError):
        ReadOptions.of({"threads": 4})
    assert (batch_for_bases(1000, 300), batch_for_bases(900, 300), batch_for_bases(5, 0)) == (4, 3, 1)


def test_small_batches_are_slices_of_larger_ones(monkeypatch):
    built = []
    one = parse._fastq_batch
    monkeypatch.setattr(parse, "_fastq_batch", lambda *a: built.append(1) or one(*a))
    data = b"".join(b"@%d\nA\n+\nI\n" % i for i in range(1000)) + b"@x\nA\n-\nI\n"
    read = lambda mode: parse.batches(io.BufferedReader(io.BytesIO(data)), "f", FASTQ, mode, 0, None, 37)
    found = list(read(PERMISSIVE))
    assert [b.num_rows for b in found] == [37] * 27 + [2] and len(built) == 1
    assert [i for b in found for i in b.column("rec_index").to_pylist()] == list(range(1001))
    assert [b.num_rows for b in read(DROPMALFORMED)] == [37] * 27 + [1]
    seen = []
    with pytest.raises(errors.InvalidSeparatorError, match="record 1000"):
        seen.extend(b.num_rows for b in read(FAILFAST))
    assert sum(seen) <= 999
    first = read(FAILFAST)
    assert sum(next(first).num_rows for _ in range(27)) == 999  # what comes before a bad batch is given
