"""Files through Spark: the same records as the stream parsers give, whatever the splits, codec or address."""

import bz2
import gzip
import http.server
import io
import lzma
import os
import random
import struct
import threading
import uuid
from contextlib import contextmanager

import pytest
import zstandard

from seqloom import errors, storage
from seqloom.operators import combine
from seqloom.schema import FASTA, FASTQ, PERMISSIVE, RECORD_COLUMNS
from seqloom.sources import parse, plain, reader
from seqloom.sources.remote import GcsUrl, SshUrl
from seqloom.storage import Pieces

NAMES = ["rec_index", "id", "seq", "seq_raw", "qual", "sep", "format"]


@contextmanager
def split_bytes(spark, n):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def parsed(data, kind):
    return [tuple(r[c] for c in NAMES) for b in parse.batches(io.BufferedReader(io.BytesIO(data)), "f", kind, PERMISSIVE) for r in b.to_pylist()]


def collected(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*NAMES).collect()), key=repr)


def fastq(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.randrange(0, 40)
        out.append(b"@s%d x\n%s\n+\n%s\n" % (i, bytes(rng.choice(b"ACGT") for _ in range(k)), bytes(rng.choice(b"@+I>") for _ in range(k))))
    return b"".join(out)


def fasta(n, seed=1):
    rng = random.Random(seed)
    return b"".join(b">s%d > x\n" % i + b"".join(bytes(rng.choice(b"ACGT>") if j else 65 for j in range(rng.randrange(1, 30))) + b"\n" for _ in range(rng.randrange(0, 5))) for i in range(n))


def put(path, data):
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_fastq_splits(spark, tmp_path, size):
    datas = [fastq(120), fastq(33, 2)[:-1], fastq(50, 3) + b"@t\nAC\n+", fastq(7, 4) + b"@t\nAC\n+\n", b"@one\nA\n+\nI\n"]
    paths = [put(tmp_path / f"{i}.fq", d) for i, d in enumerate(datas)]
    want = sorted((r for d in datas for r in parsed(d, FASTQ)), key=repr)
    with split_bytes(spark, size):
        assert collected(reader.read_fastq(spark, paths, mode=PERMISSIVE)) == want
        assert collected(plain.read_fastq(spark, paths, PERMISSIVE)) == want


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_fasta_splits(spark, tmp_path, size):
    datas = [fasta(80), fasta(20, 2)[:-1], b"junk\n>a\nAC\nGT\n", b"no records\n", b">\n>\n>b", b"\n>c\nA\n", b">d\r\nA\r\n"]
    paths = [put(tmp_path / f"{i}.fa", d) for i, d in enumerate(datas)]
    with split_bytes(spark, size):
        want = sorted((r for d in datas for r in parsed(d, FASTA)), key=repr)
        assert collected(plain.read_fasta(spark, paths)) == want and collected(reader.read_fasta(spark, paths)) == want


def test_random_bytes(spark, tmp_path):
    rng = random.Random(7)
    datas = [bytes(rng.choice(b"@>+\n\nAC\r\xff") for _ in range(rng.randrange(1, 200))) for _ in range(25)]
    paths = [put(tmp_path / f"{i}", d) for i, d in enumerate(datas)]
    with split_bytes(spark, 37):
        assert collected(reader.read_fastq(spark, paths, mode=PERMISSIVE)) == sorted((r for d in datas for r in parsed(d, FASTQ)), key=repr)
        assert collected(plain.read_fastq(spark, paths, PERMISSIVE)) == sorted((r for d in datas for r in parsed(d, FASTQ)), key=repr)
        want = sorted((r for d in datas for r in parsed(d, FASTA)), key=repr)
        assert collected(plain.read_fasta(spark, paths)) == want and collected(reader.read_fasta(spark, paths)) == want


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_compressed(spark, tmp_path, pack):
    for kind, data in ((FASTQ, fastq(60)), (FASTA, fasta(60))):
        path = put(tmp_path / "reads.data", pack(data))
        got = reader.read_fastx(spark, path)
        assert collected(got) == sorted(parsed(data, kind), key=repr) and got.columns == RECORD_COLUMNS
        assert collected(got.where("rec_index >= 10 and rec_index < 20")) == sorted(parsed(data, kind)[10:20], key=repr)
        assert reader.read_fastx(spark, path, record_limit=7, records_per_batch=3).count() == 7
        assert reader.read_fastx(spark, path, bases_per_batch=100).count() == 60


def test_a_range_reaches_the_source(spark, tmp_path):
    path = put(tmp_path / "x.gz", gzip.compress(fastq(60)))
    plan = reader.read_fastx(spark, path).where("rec_index >= 10 and rec_index < 20")._jdf.queryExecution().executedPlan().toString()
    assert "rec_index" in plan and "BatchScan" in plan


def test_formats_and_errors(spark, tmp_path):
    q, a = put(tmp_path / "a", b"@a\nA\n+\nI\n"), put(tmp_path / "b", b">b\nA\n")
    both = reader.read_fastx(spark, [q, a])
    assert sorted((r.format, bytes(r.id)) for r in both.collect()) == [(FASTA, b"b"), (FASTQ, b"a")]
    assert reader.expect_format(reader.read_fastx(spark, a), FASTA).count() == 1
    with pytest.raises(Exception, match="expected fasta"):
        reader.expect_format(both, FASTA).collect()
    empty = put(tmp_path / "c", b"")
    with pytest.raises(errors.FastxFormatError):
        reader.read_fastx(spark, empty)
    assert reader.read_fastq(spark, empty).count() == 0 and reader.read_fasta(spark, empty).count() == 0
    with pytest.raises(errors.FastxFormatError):
        reader.read_fastx(spark, put(tmp_path / "d", b"plain text\n"))
    with pytest.raises(FileNotFoundError):
        reader.read_fastx(spark, str(tmp_path / "missing"))
    with pytest.raises(Exception, match="INVALID_HEADER"):
        reader.read_fastq(spark, a + "*").collect() if False else reader.read_fastq(spark, put(tmp_path / "e", b"xx\nA\n+\nI\n")).collect()


def test_validation_and_formats_hold_whatever_is_asked(spark, tmp_path):
    bad, fa = put(tmp_path / "bad", b"xx\nA\n+\nI\n" * 5), put(tmp_path / "fa", b">a\nA\n")
    asks = (lambda df: df.count(), lambda df: df.select("seq").collect(), lambda df: df.select("file").distinct().collect())
    for ask in asks:
        for records in (reader.read_fastq(spark, bad), plain.read_fastq(spark, [bad])):
            with pytest.raises(Exception, match="INVALID_HEADER"):
                ask(records)
        with pytest.raises(Exception, match="expected fastq"):
            ask(reader.expect_format(reader.read_fastx(spark, fa), FASTQ))
        with pytest.raises(Exception, match="not an alignment"):
            ask(reader.read_alignments(spark, fa))


SETTINGS = [("spark.sql.files.maxPartitionBytes", "700"), ("spark.sql.files.maxPartitionBytes", "1g"), ("spark.sql.leafNodeDefaultParallelism", "97"), ("spark.sql.leafNodeDefaultParallelism", "1"), ("spark.sql.files.minPartitionNum", "61")]


def test_no_record_is_lost_when_settings_change(spark, tmp_path):
    """Tables made under one setting and read under another; by workers and by Spark's reader."""
    n = 900
    q, a, s = put(tmp_path / "q", fastq(n)), put(tmp_path / "a", fasta(n)), put(tmp_path / "s", b"@HD\n" + b"".join(b"r%d\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n" % i for i in range(n)))
    with split_bytes(spark, 3000):
        made = [reader.read_fastq(spark, q), plain.read_fastq(spark, [q]), reader.read_fasta(spark, a), plain.read_fasta(spark, [a]), reader.read_alignments(spark, s), plain.read_sam(spark, [s])]
    want = [[tuple(r) for r in df.select("rec_index", "id", "seq").sort("rec_index").collect()] for df in made]
    assert all(len(w) == n and [r[0] for r in w] == list(range(n)) for w in want) and want[0] == want[1] and want[2] == want[3] and want[4] == want[5]
    for key, value in SETTINGS:
        spark.conf.set(key, value)
        try:
            for df, w in zip(made, want, strict=True):
                assert df.count() == n
                if key != "spark.sql.files.minPartitionNum" and value != "1":
                    assert [tuple(r) for r in df.select("rec_index", "id", "seq").sort("rec_index").collect()] == w
        finally:
            spark.conf.unset(key)


def test_splits_outside_a_range_are_not_read(spark, tmp_path):
    data = fastq(2000)
    path = put(tmp_path / "q", data)
    with split_bytes(spark, len(data) // 20):
        records = reader.read_fastq(spark, path)
        limited = reader.read_fastq(spark, path, record_limit=30)
        tail = reader.read_alignments(spark, put(tmp_path / "s", b"".join(b"r%d\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n" % i for i in range(3000))))
    parts = lambda df: df._jdf.queryExecution().executedPlan().execute().getNumPartitions()
    assert parts(records) >= 20 and parts(limited) == 1 and limited.count() == 30
    some = records.where("rec_index >= 1000 and rec_index < 1010")
    assert parts(some) <= 2 and [r.rec_index for r in some.sort("rec_index").collect()] == list(range(1000, 1010))
    assert parts(records.where("rec_index = 1999")) == 1 and records.where("rec_index = 1999").count() == 1
    assert records.where("rec_index > 5000").count() == 0 and records.where("rec_index < 0").count() == 0
    assert parts(tail.where("rec_index >= 2990")) <= 1 + parts(tail) // 20 and tail.where("rec_index >= 2990").count() == 10


def test_a_changed_file_is_an_error(spark, tmp_path):
    path = put(tmp_path / "q", fastq(50))
    records = reader.read_fastq(spark, path)
    put(tmp_path / "q", fastq(51))
    with pytest.raises(Exception, match="when the table was made"):
        records.count()


def test_only_the_columns_asked_for_are_built(spark, tmp_path, store):
    """By every reader; validation doesn't depend on them."""
    for data, kind, bad in ((fastq(50), FASTQ, b"@a\nA\n-\nI\n"), (fasta(50), FASTA, None)):
        put(tmp_path / "p", data), put(tmp_path / "z.data", gzip.compress(data))
        for at in (str(tmp_path), store):
            for name in ("p", "z.data"):
                for columns in (["seq"], ["id", "qual"], [], ["seq_raw", "format", "sep"]):
                    got = reader.read_fastx(spark, f"{at}/{name}", columns=columns)
                    assert got.columns == ["file", "rec_index", *(c for c in RECORD_COLUMNS if c in columns)]
                    want = [tuple(dict(zip(NAMES, r, strict=True))[c] for c in got.columns[1:]) for r in parsed(data, kind)]
                    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[1:]) for r in got.collect()), key=repr) == sorted(want, key=repr)
            if bad:
                put(tmp_path / "bad", bad)
                with pytest.raises(Exception, match="INVALID_SEPARATOR"):
                    reader.read_fastx(spark, f"{at}/bad", columns=["id"]).count()
                assert reader.read_fastx(spark, f"{at}/bad", columns=["id"], mode=PERMISSIVE).columns == ["file", "rec_index", "id", "_error"]
    with pytest.raises(ValueError):
        reader.read_fastx(spark, f"{store}/p", columns=["sequence"])


@pytest.mark.parametrize("kind", [FASTQ, FASTA])
def test_long_records_over_many_splits(spark, tmp_path, kind):
    lines = [b"ACGT" * 50_000, b"A", b"C" * 70_000, b"", b"G" * 300_000]
    data = b"".join(b"@r\n" + x + b"\n+\n" + b"I" * len(x) + b"\n" if kind == FASTQ else b">r\n" + b"\n".join(x[i : i + 80] for i in range(0, len(x), 80)) + b"\n" for x in lines)
    path = put(tmp_path / "x", data)
    with split_bytes(spark, 9000):
        got = reader.read_fastx(spark, path).sort("rec_index").select("rec_index", "seq").collect()
    assert [(r.rec_index, bytes(r.seq)) for r in got] == list(enumerate(lines))


@pytest.fixture
def store(spark, tmp_path):
    """A file system that only Hadoop opens, over a local folder; gs:// too."""
    conf, shop = spark.sparkContext._jsc.hadoopConfiguration(), f"shop{uuid.uuid4().hex}"  # file systems are cached by their names
    names = {f"fs.viewfs.mounttable.{shop}.link./in": f"file://{tmp_path}", "fs.gs.impl": "org.apache.hadoop.fs.viewfs.ViewFileSystemOverloadScheme", "fs.viewfs.mounttable.bucket.link./in": f"file://{tmp_path}", "fs.viewfs.overload.scheme.target.gs.impl": "org.apache.hadoop.fs.LocalFileSystem"}
    for k, v in names.items():
        conf.set(k, v)
    yield f"viewfs://{shop}/in"
    for k in names:
        conf.unset(k)


def test_files_in_a_store(spark, tmp_path, store):
    """Plain, compressed under names that Hadoop knows and under others, and BAM; a peek, a limit and a format found by content."""
    q, a = fastq(300), fasta(200)
    put(tmp_path / "q.fq", q), put(tmp_path / "a.fa", a)
    with split_bytes(spark, 1000):
        assert collected(reader.read_fastx(spark, f"{store}/q.fq")) == sorted(parsed(q, FASTQ), key=repr)
        assert collected(reader.read_fastx(spark, f"{store}/a.fa")) == sorted(parsed(a, FASTA), key=repr)
    for name, pack in (("x.gz", gzip.compress), ("x.data", gzip.compress), ("y.data", bz2.compress), ("y.bz2", bz2.compress), ("z.data", lzma.compress), ("z.xz", lzma.compress), ("s.data", zstandard.compress)):
        for data, kind in ((q, FASTQ), (a, FASTA), (q[:-1], FASTQ)):
            put(tmp_path / name, pack(data))
            assert collected(reader.read_fastx(spark, f"{store}/{name}")) == sorted(parsed(data, kind), key=repr), name
    put(tmp_path / "x.data", gzip.compress(q[:500]) + gzip.compress(q[500:]))
    both = reader.read_fastx(spark, [f"{store}/x.data", f"{store}/y.bz2", f"{store}/q.fq"], record_limit=7, bases_per_batch=100)
    assert both.count() == 21 and {r.rec_index for r in both.collect()} == set(range(7))
    rows = [(f"q{i}", 4, "ACGTN=ACMG"[: i % 11], [i % 90] * (i % 11) if i % 3 else None) for i in range(30)]
    put(tmp_path / "x.bam", bam(rows)), put(tmp_path / "x.sam", SAM.encode())
    got = sorted((r.rec_index, bytes(r.id).decode(), r.flag, bytes(r.seq).decode()) for r in reader.read_alignments(spark, f"{store}/x.bam").collect())
    assert got == [(i, n, f, s) for i, (n, f, s, _) in enumerate(rows)]
    assert reader.read_alignments(spark, [f"{store}/x.bam", f"{store}/x.sam"]).count() == 70
    put(tmp_path / "x.sam.gz", gzip.compress(SAM.encode())), put(tmp_path / "s.bin", zstandard.compress(SAM.encode()))
    want = sorted(map(tuple, reader.read_alignments(spark, str(tmp_path / "x.sam")).drop("file").collect()))
    for at in (str(tmp_path), store):
        for name in ("x.sam.gz", "s.bin", "x.sam"):
            assert sorted(map(tuple, reader.read_alignments(spark, f"{at}/{name}").drop("file").collect())) == want
    bad = put(tmp_path / "bad.data", gzip.compress(b"@a\nA\n-\nI\n"))
    for at in (bad, f"{store}/bad.data"):
        with pytest.raises(Exception, match="INVALID_SEPARATOR|InvalidSeparator"):
            reader.read_fastx(spark, at).count()
        assert reader.read_fastx(spark, at, mode=PERMISSIVE).first()["_error"] == "INVALID_SEPARATOR"


def test_buckets_through_hadoop(spark, tmp_path, store):
    """gs:// with a Hadoop file system for it is read like any other store; without one, or with options for gcloud, by the command."""
    put(tmp_path / "q.fq", fastq(40)), put(tmp_path / "q.gz", gzip.compress(fastq(40)))
    assert not reader.streams(spark, "gs://bucket/in/q.fq", None) and reader.streams(spark, "gs://bucket/in/q.fq", {"project": "p"}) and reader.streams(spark, "https://h/x", None)
    assert collected(reader.from_gcs(spark, "gs://bucket/in/q.fq")) == collected(reader.from_gcs(spark, "gs://bucket/in/q.gz")) == sorted(parsed(fastq(40), FASTQ), key=repr)
    spark.sparkContext._jsc.hadoopConfiguration().unset("fs.gs.impl")
    assert reader.streams(spark, "gs://bucket/in/q.fq", None)


def test_bytes_and_stdin(spark, tmp_path):
    data = fastq(5)
    want = sorted(parsed(data, FASTQ), key=repr)
    assert collected(reader.from_bytes(spark, data)) == want
    assert collected(reader.from_stdin(spark, io.BytesIO(gzip.compress(data)))) == want
    assert collected(reader.from_optional_path(spark, put(tmp_path / "x", data))) == want
    assert reader.batch_size(reader.from_bytes(spark, b"@a\nACGT\n+\nIIII\n"), 10) == 3


SAM = "@HD\tVN:1\n@CO\tx\n" + "".join(f"r{i // 2}\t{77 if i % 2 == 0 else 141}\t*\t0\t0\t*\t*\t0\t0\t{'ACGTN'[: i % 6] or '*'}\t{'IIIII'[: i % 6] or '*'}\n" for i in range(40))


def bam(rows):
    out = b"BAM\x01" + struct.pack("<i", 4) + b"@CO\t" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 99)
    for name, flag, seq, qual in rows:
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq]
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], [*codes[1::2], 0], strict=False))
        body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + (bytes(qual) if qual else b"\xff" * len(seq))
        out += struct.pack("<i", len(body)) + body
    return gzip.compress(out[:70]) + gzip.compress(out[70:])


def test_sam_and_bam(spark, tmp_path):
    sam = put(tmp_path / "x.sam", SAM.encode())
    with split_bytes(spark, 90):
        got = sorted((r.rec_index, bytes(r.id), r.flag, bytes(r.seq), r.qual and bytes(r.qual)) for r in reader.read_alignments(spark, sam).collect())
    assert got == [(i, b"r%d" % (i // 2), 77 if i % 2 == 0 else 141, b"ACGTN"[: i % 6], b"IIIII"[: i % 6] or None) for i in range(40)]
    rows = [(f"q{i}", 4, "ACGTN=ACMG"[: i % 11], [i % 90] * (i % 11) if i % 3 else None) for i in range(30)]
    b = put(tmp_path / "x.bam", bam(rows))
    got = sorted((r.rec_index, bytes(r.id).decode(), r.flag, bytes(r.seq).decode(), r.qual and [x - 33 for x in r.qual]) for r in reader.read_alignments(spark, b).collect())
    assert got == [(i, n, f, s, q or None) for i, (n, f, s, q) in enumerate(rows)]
    assert reader.read_alignments(spark, [sam, b]).count() == 70
    with pytest.raises(errors.FastxFormatError):
        reader.read_alignments(spark, put(tmp_path / "x.cram", b"CRAM\x03\x00"))
    with pytest.raises(Exception, match="not an alignment"):
        reader.read_alignments(spark, put(tmp_path / "y.sam", b"a\tb\n")).collect()


@pytest.mark.parametrize(("a", "b", "error"), [((77, "x"), (141, "x"), None), ((4, "x"), (141, "x"), "UNPAIRED_RECORD"), ((77, "x"), (141, "y"), "DIFFERENT_NAMES"), ((77, "x"), (77, "x"), "SAME_TEMPLATE_POSITION"), ((141, "x"), (141, "x"), None)])
def test_mates(spark, tmp_path, a, b, error):
    line = lambda f, n: f"{n}\t{f}\t*\t0\t0\t*\t*\t0\t0\tA\tI\n".encode()
    r1, r2 = (reader.read_alignments(spark, put(tmp_path / f"{i}.sam", line(*x))) for i, x in enumerate((a, b)))
    if error:
        with pytest.raises(Exception, match=error):
            combine.paired(r1, r2).collect()
    else:
        assert combine.paired(r1, r2).count() == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from seqloom.storage import shared_dir

    conf = Fake(get=lambda key, default=None: default)
    none = Fake(isDefined=lambda: False)
    session = lambda master: Fake(conf=conf, sparkContext=Fake(master=master, _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: none)), setCheckpointDir=lambda path: None))
    assert shared_dir(session("local[2]")).startswith("file:///")
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(errors.ConfigurationError):
            shared_dir(session(master))


SSH_URLS = [
    ("ssh://user@example.com:2222/path/to/file.fastq", ("example.com", "/path/to/file.fastq", "user", 2222)), ("ssh://example.com/a", ("example.com", "/a", None, None)),
    ("user@example.com:path/to/file.fastq", ("example.com", "path/to/file.fastq", "user", None)), ("host:/abs", ("host", "/abs", None, None)),
]


@pytest.mark.parametrize(("url", "want"), SSH_URLS)
def test_ssh_urls(url, want):
    u = SshUrl.parse(url)
    assert (u.host, u.path, u.user, u.port) == want


@pytest.mark.parametrize("url", ["ssh://", "ssh://host", "ssh://host/", "ssh://host:x/a", "plain/path", "host:", ":path", "http://a/b", "@host:x"])
def test_bad_ssh_urls(url):
    with pytest.raises(errors.UrlError):
        SshUrl.parse(url)


@pytest.mark.parametrize("url", ["gs://bucket", "gs://bucket/", "gs://", "s3://bucket/x", "gs:///x"])
def test_bad_gcs_urls(url):
    with pytest.raises(errors.UrlError):
        GcsUrl.parse(url)


def test_commands():
    assert SshUrl.parse("ssh://u@h:22/p").command("-i", "k")[-6:] == ["k", "-p", "22", "u@h", "cat", "/p"]
    assert GcsUrl.parse("gs://b/o/p").command("--x", project="P") == ["gcloud", "storage", "cat", "gs://b/o/p", "--quiet", "--x", "--project", "P"]


def test_http(spark, tmp_path):
    data = fastq(20)
    put(tmp_path / "reads", gzip.compress(data))
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    http.server.SimpleHTTPRequestHandler.log_message = lambda *a: None
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        assert collected(reader.from_url(spark, f"{at}/reads")) == sorted(parsed(data, FASTQ), key=repr)
        with pytest.raises(Exception, match="404"):
            reader.from_url(spark, f"{at}/missing").collect()
    finally:
        server.shutdown()


def test_a_failed_command_is_an_error(spark, tmp_path):
    """ssh and gcloud stand-ins: the whole output comes through, and an exit status isn't taken for the end of the file."""
    from seqloom.sources.remote import CommandStream

    path = put(tmp_path / "reads", fastq(9))
    assert CommandStream(["cat", path]).read(-1) == fastq(9)
    broken = CommandStream(["sh", "-c", "echo @a; exit 3"])
    assert broken.read(3) == b"@a\n"
    with pytest.raises(errors.RemoteError, match="3"):
        while broken.read(10):
            pass
    with pytest.raises(errors.RemoteError):
        CommandStream(["seqloom-no-such-command"])
    assert os.path.exists(path)


def test_bytes_pass_the_driver_in_pieces(spark, tmp_path):
    data, at = fastq(300), []

    def pieces():
        for i in range(0, len(data), 1000):
            at.append(i)
            yield data[i : i + 1000]

    found = reader.from_bytes(spark, pieces())
    assert len(at) == -(-len(data) // 1000) and collected(found) == collected(reader.from_bytes(spark, data))
    assert collected(found) == sorted(parsed(data, FASTQ), key=repr)


def test_pieces_are_asked_for_as_they_are_read():
    asked = []
    stream = Pieces(x for x in (b"ab", b"", b"cde") if not asked.append(x))
    assert stream.read(1) == b"a" and asked == [b"ab"] and stream.readall() == b"bcde" and stream.read(1) == b""


def test_file_of_another_store_is_read_and_written_in_pieces(spark, tmp_path):
    data = fastq(50)
    put(tmp_path / "x", data)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pieces.link./in", f"file://{tmp_path}")
    with storage.open_bytes(spark, "viewfs://pieces/in/x") as stream:
        storage.write_bytes(spark, "viewfs://pieces/in/y", stream)
    assert (tmp_path / "y").read_bytes() == data


def test_compressed_standard_input_is_split(spark):
    data = fastq(2000)
    with split_bytes(spark, 20_000):
        found = reader.from_stdin(spark, io.BytesIO(gzip.compress(data)))
    assert found.rdd.getNumPartitions() > 1 and collected(found) == sorted(parsed(data, FASTQ), key=repr)
    with pytest.raises(errors.FastxFormatError):
        reader.from_stdin(spark, io.BytesIO(gzip.compress(b"")))
    assert reader.from_stdin(spark, io.BytesIO(gzip.compress(b"")), format=FASTQ).count() == 0


def test_stored_fastq_is_dealt_by_its_bytes(spark, tmp_path, monkeypatch):
    data = fastq(3000)
    path = put(tmp_path / "x", data)
    monkeypatch.setattr(plain, "DEALT_BYTES", len(data) // 5)
    found = plain.read_fastq(spark, [path])
    assert found.rdd.getNumPartitions() in (5, 6)
    assert collected(found) == sorted(parsed(data, FASTQ), key=repr)
