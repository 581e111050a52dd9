"""Registered queries of codecs, transports, collections, edges of files and outcomes of errors, with the same answers in SQL."""

from __future__ import annotations

import bz2
import functools
import gzip
import http.server
import lzma
import threading
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import errors
from seqloom.functions import as_text, byte_sum, phred33
from seqloom.operators import aggregates, combine, process, ranges, sinks
from seqloom.operators.collection import Collection
from seqloom.plans import fixtures as fx
from seqloom.plans.queries import _BYTES, _COLLECTION, _SQL, S1, S2, S3, _collection, _duck, _orders, _sides, _text, query
from seqloom.schema import BAM, FASTA, FASTQ, ReadOptions
from seqloom.sources import plain, reader
from seqloom.sources.remote import GcsUrl, SshUrl, local_path
from seqloom.sources.stored import load_stored
from seqloom.storage import list_files, open_bytes, scratch


def _packs() -> dict[str, Callable[[bytes], bytes]]:
    import zstandard

    return {"bzip2": bz2.compress, "gzip": gzip.compress, "xz": lambda x: lzma.compress(x, preset=0), "zstd": zstandard.compress}


def _packed(spark: SparkSession, sf_dir: str, codec: str) -> str:
    return fx.made(spark, sf_dir, f"packed.{codec}-data", lambda p: fx.packed(spark, sf_dir, _packs()[codec], p))


# Codecs and transports


@query(" union all ".join(f"select '{c}' as codec, count(*) as n_records, cast(sum({_BYTES.format(S1)}) as bigint) as byte_sum from orders" for c in ("bzip2", "gzip", "xz", "zstd")))
def scan_codecs(spark, sf_dir):
    """Every codec, found by content, by the streaming source."""
    parts = [aggregates.seq_sum(reader.read_fastx(spark, _packed(spark, sf_dir, c))).withColumn("codec", F.lit(c)) for c in _packs()]
    return functools.reduce(DataFrame.unionByName, parts)


@query(_SQL["scan_codecs"])
def scan_stored_codecs(spark, sf_dir):
    """The same by the way of stores that only Spark opens: stored bytes come as lines of one partition."""
    parts = [aggregates.seq_sum(load_stored(spark, [_packed(spark, sf_dir, c)], FASTQ, ReadOptions(), 1024)).withColumn("codec", F.lit(c)) for c in _packs()]
    return functools.reduce(DataFrame.unionByName, parts)


@query(_SQL["sam_to_records"])
def bam_to_records(spark, sf_dir):
    r = reader.read_alignments(spark, fx.bam(spark, sf_dir))
    return r.select("rec_index", as_text("id").alias("id"), "flag", as_text("seq").alias("seq"), F.col("qual").cast("string").alias("qual"))


@query(_SQL["sam_to_records"])
def bam_in_store(spark, sf_dir):
    r = load_stored(spark, [fx.bam(spark, sf_dir)], BAM, ReadOptions(), 1024)
    return r.select("rec_index", as_text("id").alias("id"), "flag", as_text("seq").alias("seq"), F.col("qual").cast("string").alias("qual"))


@query(_SQL["sam_to_records"])
def sam_in_store(spark, sf_dir):
    """By Spark's line reader alone."""
    r = plain.read_sam(spark, [fx.sam(spark, sf_dir)])
    return r.select("rec_index", as_text("id").alias("id"), "flag", as_text("seq").alias("seq"), F.col("qual").cast("string").alias("qual"))


@query(_SQL["scan_fasta"])
def fasta_in_store(spark, sf_dir):
    return _text(plain.read_fasta(spark, [fx.fasta(spark, sf_dir)]), "id", "seq")


@functools.cache
def _server(folder: str) -> int:
    """A web server over a folder, for as long as the driver lives; its port."""

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=folder))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server.server_port


def _address(path: str) -> str:
    folder, _, name = local_path(path).rpartition("/")
    return f"http://127.0.0.1:{_server(folder)}/{quote(name)}"


@query(_SQL["scan_compressed"])
def scan_http(spark, sf_dir):
    """From a web server on this machine, compressed."""
    return _text(reader.from_url(spark, _address(fx.compressed(spark, sf_dir))), "seq")


@query(_SQL["scan_compressed"])
def scan_http_batches(spark, sf_dir):
    return _text(reader.from_url(spark, _address(fx.compressed(spark, sf_dir)), records_per_batch=37, columns=["seq"]), "seq")


@query(_SQL["scan_compressed"])
def from_stdin(spark, sf_dir):
    """A compressed stream in place of the driver's standard input."""
    with open_bytes(spark, fx.compressed(spark, sf_dir)) as stream:
        return _text(reader.from_stdin(spark, stream), "seq")


@query(_SQL["scan_compressed"])
def from_optional_path(spark, sf_dir):
    return _text(reader.from_optional_path(spark, fx.fastq(spark, sf_dir), records_per_batch=100), "seq")


@query(
    "select * from (values ('ssh', 'ssh -q -o BatchMode=yes -o StrictHostKeyChecking=accept-new -i key -p 2222 user@example.com cat /path/to/file.fastq'), "
    "('gcs', 'gcloud storage cat gs://bucket/a/b.fastq.gz --quiet --verbosity=error --project p --billing-project b --impersonate-service-account s')) t(transport, command)"
)
def transport_commands(spark, sf_dir):
    ssh = SshUrl.parse("ssh://user@example.com:2222/path/to/file.fastq").command("-i", "key")
    gcs = GcsUrl.parse("gs://bucket/a/b.fastq.gz").command("--verbosity=error", project="p", billing_project="b", impersonate="s")
    return spark.createDataFrame([("ssh", " ".join(ssh)), ("gcs", " ".join(gcs))], "transport string, command string")


# Edges of files


@query(_SQL["scan_fastq"])
def fastq_without_last_newline(spark, sf_dir):
    """The last record's fourth line has no end, and three lines of another follow in a second file, which are passed over."""
    whole = fx.made(spark, sf_dir, "unended.fastq", lambda p: sinks.join_files(spark, list_files(spark, [fx.fastq(spark, sf_dir)]), p, cut=1))
    short = fx.made(spark, sf_dir, "short.fastq", lambda p: fx.put(spark, p, b"@t\nAC\n+"))
    return _text(reader.read_fastq(spark, [whole, short]), "id", "seq", "qual", "sep")


@query(_SQL["scan_fasta"])
def fasta_behind_other_lines(spark, sf_dir):
    """What comes before the first record is passed over."""
    path = fx.made(spark, sf_dir, "behind.fasta", lambda p: sinks.join_files(spark, list_files(spark, [fx.fasta(spark, sf_dir)]), p, b"; a note\n\n"))
    return _text(reader.read_fasta(spark, path), "id", "seq")


@query(f"select o_orderkey as rec_index, {S1} as seq from orders where starts_with({S1}, 'A')")
def arbitrary_predicate(spark, sf_dir):
    return _text(_orders(spark, sf_dir), "seq").where("startswith(seq, 'A')")


@query(f"select o_orderkey as rec_index, {S1} as seq from orders where o_orderkey < 50")
def batch_options(spark, sf_dir):
    """Records and bases in a batch, with a limit, plain and compressed: the records don't depend on them."""
    parts = [_orders(spark, sf_dir, record_limit=50, records_per_batch=7), _orders(spark, sf_dir, record_limit=50, bases_per_batch=100), reader.read_fastx(spark, fx.compressed(spark, sf_dir), record_limit=50, bases_per_batch=64)]
    return _text(functools.reduce(DataFrame.unionByName, parts).dropDuplicates(["rec_index", "seq"]), "seq")


@query("select o_orderkey % 94 as score, chr(cast(33 + o_orderkey % 94 as int)) as quality, count(*) as n from orders group by 1, 2")
def phred_quality(spark, sf_dir):
    scores = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey % 94 as score", "unhex(lpad(hex(o_orderkey % 94), 2, '0')) as raw")
    return scores.groupBy("score", phred33("raw").cast("string").alias("quality")).agg(F.count(F.lit(1)).alias("n"))


_MATES = "case when o_orderkey % 3 = 0 then 4 when o_orderkey % 3 = 1 then 77 else 141 end", "case when o_orderkey % 5 = 0 then 4 when o_orderkey % 5 < 3 then 77 else 141 end", "case when o_orderkey % 7 = 0 then 'other' else 'same' end"


@query(
    f"select o_orderkey, case when {_MATES[0]} & 1 = 0 or {_MATES[1]} & 1 = 0 then 'UNPAIRED_RECORD' when {_MATES[2]} <> 'same' then 'DIFFERENT_NAMES' "
    f"when {_MATES[0]} & 64 > 0 and {_MATES[1]} & 64 > 0 then 'SAME_TEMPLATE_POSITION' end as error from orders"
)
def mate_errors(spark, sf_dir):
    a, b, name = _MATES
    pairs = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"named_struct('flag', {a}, 'id', binary('same')) as r1", f"named_struct('flag', {b}, 'id', binary({name})) as r2")
    return pairs.select("o_orderkey", combine.mate_error().alias("error"))


# Groups and collections


@query(_SQL["multi_interleaved"])
def groups_where_read(spark, sf_dir):
    """Groups of five framed by the source over many splits, without a shuffle."""
    fx.fastq(spark, sf_dir)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        g = reader.read_groups(spark, fx.fastq(spark, sf_dir), 5)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    return g.select("rec_index", F.size("members").cast("long").alias("n_members"), F.array_join(F.transform("members", lambda r: r.seq.cast("string")), "|").alias("seqs"))


_NAMES = ["customer", "supplier", "part"]


@query(" union all ".join(f"select {i} as file_ord, count(*) // 2 as n_groups, cast(sum({_BYTES.format(_duck(_COLLECTION[t]))}) as bigint) as byte_sum from {t}" for i, t in enumerate(_NAMES)))
def collection_interleaved(spark, sf_dir):
    c = _collection(spark, sf_dir, _NAMES, kind="interleaved").interleaved()
    return c.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(byte_sum("r1.seq") + byte_sum("r2.seq")).alias("byte_sum"))


@query(" union all ".join(f"select {i} as file_ord, count(*) // 5 as n_groups, cast(sum({_BYTES.format(_duck(_COLLECTION[t]))}) as bigint) as byte_sum from {t}" for i, t in enumerate(_NAMES)))
def collection_interleaved_multi(spark, sf_dir):
    c = _collection(spark, sf_dir, _NAMES, kind="interleaved_multi", arity=5).interleaved_multi()
    total = F.aggregate("members", F.lit(0).cast("long"), lambda a, r: a + byte_sum(r.seq))
    return c.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(total).alias("byte_sum"))


@query(f"select o_orderkey as rec_index, cast(0 as bigint) as group_id, {S1} as seq1, {S2} as seq2, {S3} as seq3 from orders where o_orderkey >= 20 and o_orderkey < 60")
def collection_multi(spark, sf_dir):
    m = Collection(spark, [fx.fastq(spark, sf_dir, s) for s in ("", "m", "n")], "multi", 3).multi(20, 60)
    return m.select("rec_index", "group_id", *(as_text(F.col(f"r{i}.seq")).alias(f"seq{i}") for i in (1, 2, 3)))


@query(" union all ".join(f"select {i} as file_ord, {_COLLECTION[t]} as rec_index from {t} where {_COLLECTION[t]} >= 3 and {_COLLECTION[t]} < 9" for i, t in enumerate(_NAMES)))
def collection_limited(spark, sf_dir):
    return _collection(spark, sf_dir, _NAMES).limited(9).single(3).select("file_ord", "rec_index")


class _GroupSum(process.Processor):
    def __init__(self):
        self.n = self.total = 0

    def process_record(self, row):
        self.n += 1
        self.total += sum(sum(row[r]["seq"]) for r in ("r1", "r2", "r3"))

    def on_complete(self):
        return [{"n": self.n, "total": self.total}]


@query(_SQL["multi_seq_sum"])
def processor_multi(spark, sf_dir):
    groups = combine.multi([s.select("rec_index", "seq") for s in _sides(spark, sf_dir, 3)])
    return process.process(groups, _GroupSum(), "n long, total long").agg(F.sum("n").alias("n_groups"), F.sum("total").alias("byte_sum"))


class _Worker(process.Processor):
    def __init__(self):
        self.n = 0

    def process_record(self, row):
        self.n += 1

    def on_complete(self):
        return [{"worker": self.worker_id, "n": self.n}]


@query("select count(*) as n_records, true as own_ids from orders")
def processor_workers(spark, sf_dir):
    """Each task's processor has its own number."""
    found = process.process(_orders(spark, sf_dir).select("rec_index").repartition(4), _Worker(), "worker int, n long")
    return found.agg(F.sum("n").alias("n_records"), (F.count_distinct("worker") == F.count(F.lit(1))).alias("own_ids"))


@query("select count(*) as n_records from orders")
def stream_batches(spark, sf_dir):
    """A stream's micro-batches, each handed to a function."""
    from seqloom.streaming import each_batch, read_stream

    folder = fx.made(spark, sf_dir, "streamed", lambda p: sinks.write_records(fx.records(spark, sf_dir), p))
    out = scratch(spark, "batches")
    each_batch(read_stream(spark, folder + "/part-*", max_files=2), lambda df, n: df.select("rec_index").write.mode("append").parquet(out), scratch(spark, "offsets")).awaitTermination()
    return spark.read.schema("rec_index long").parquet(out).agg(F.count(F.lit(1)).alias("n_records"))


# Outcomes of errors


def _outcome(make: Callable[[], object]) -> str:
    """The first of the known errors that comes out, or none."""
    known = ("INVALID_HEADER", "INVALID_SEPARATOR", "UNEQUAL_LENGTHS", "LENGTH_MISMATCH", "ARITY_MISMATCH", "DIFFERENT_NAMES", "UNPAIRED_RECORD", "expected fasta", "not an alignment", "stop here", "404")
    try:
        make()
    except (errors.FastxFormatError, errors.UrlError, errors.CollectionSizeMismatchError, ValueError) as e:
        return type(e).__name__
    except Exception as e:  # noqa: BLE001 - a job's error, whose cause is in its text
        return next((k for k in known if k in str(e)), type(e).__name__)
    return "none"


_ASKED = {"count": lambda df: df.count(), "column": lambda df: df.select(df.columns[-1]).collect(), "rows": lambda df: df.collect()}
_FAILING = {
    "paired, first longer": "LENGTH_MISMATCH", "paired, second longer": "LENGTH_MISMATCH", "multi": "LENGTH_MISMATCH", "interleaved": "ARITY_MISMATCH", "interleaved multi": "ARITY_MISMATCH", "groups where read": "ARITY_MISMATCH", "names": "DIFFERENT_NAMES",
    "mates": "UNPAIRED_RECORD", "format": "expected fasta", "header": "INVALID_HEADER", "header in store": "INVALID_HEADER", "separator": "INVALID_SEPARATOR", "lengths": "UNEQUAL_LENGTHS", "not an alignment": "not an alignment", "processor": "stop here", "missing address": "404",
}
_REFUSED = {"no format": "FastxFormatError", "empty": "FastxFormatError", "cram": "FastxFormatError", "address": "UrlError", "bucket": "UrlError", "batch": "ValueError", "collection": "CollectionSizeMismatchError", "no files": "CollectionSizeMismatchError", "range": "ValueError"}


@query("select * from (values " + ", ".join([*(f"('{c}', '{a}', '{e}')" for c, e in _FAILING.items() for a in _ASKED), *(f"('{c}', 'refused', '{e}')" for c, e in _REFUSED.items())]) + ") t(failing, asked, outcome)")
def error_outcomes(spark, sf_dir):
    """Files that don't fit, whatever is asked of them: a count, one column, or rows; and what is refused beforehand."""
    file = lambda name, data: fx.made(spark, sf_dir, name, lambda p: fx.put(spark, p, data))
    record = lambda k, s="": b"".join(b"@s%d%s\nA\n+\nI\n" % (i, s.encode()) for i in range(k))
    ten, seven, named = (reader.read_fastq(spark, file(n, d)) for n, d in (("ten.fq", record(10)), ("seven.fq", record(7)), ("named.fq", record(10, "x"))))
    bad = {k: file(f"{k}.fq", record(3) + d) for k, d in (("header", b"xx\nA\n+\nI\n"), ("separator", b"@x\nA\n-\nI\n"), ("lengths", b"@x\nAA\n+\nI\n"))}
    alone = reader.read_alignments(spark, file("alone.sam", b"r\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n"))

    def stop(rows):
        raise ValueError("stop here")

    failing = {
        "paired, first longer": combine.paired(ten, seven), "paired, second longer": combine.paired(seven, ten), "multi": combine.multi([ten, ten, seven]), "interleaved": combine.interleaved(seven), "interleaved multi": combine.interleaved_multi(ten, 3),
        "groups where read": reader.read_groups(spark, file("ten.fq", b""), 3), "names": combine.paired(ten, named, check_names=True), "mates": combine.paired(alone, alone), "format": reader.expect_format(ten, FASTA), "header": reader.read_fastq(spark, bad["header"]),
        "header in store": plain.read_fastq(spark, [bad["header"]]), "separator": reader.read_fastq(spark, bad["separator"]), "lengths": reader.read_fastq(spark, bad["lengths"]), "not an alignment": reader.read_alignments(spark, bad["header"]),
        "processor": process.process(ten, stop, "k long"), "missing address": reader.from_url(spark, _address(file("ten.fq", b"")) + ".missing", format=FASTQ),
    }
    refused = {
        "no format": lambda: reader.read_fastx(spark, file("text", b"plain\n")), "empty": lambda: reader.read_fastx(spark, file("empty", b"")), "cram": lambda: reader.read_alignments(spark, file("x.cram", b"CRAM\x03\x00")),
        "address": lambda: reader.from_ssh(spark, "ssh://host"), "bucket": lambda: reader.from_gcs(spark, "gs://bucket"), "batch": lambda: reader.read_fastq(spark, bad["header"], records_per_batch=0),
        "collection": lambda: Collection(spark, ["a", "b", "c"], "paired"), "no files": lambda: Collection(spark, []), "range": lambda: ranges.take_range(ten, -1, 5),
    }
    rows = [(c, a, _outcome(lambda ask=ask, df=df: ask(df))) for c, df in failing.items() for a, ask in _ASKED.items()]
    rows += [(c, "refused", _outcome(make)) for c, make in refused.items()]
    return spark.createDataFrame(rows, "failing string, asked string, outcome string")
