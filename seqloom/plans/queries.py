"""The registered queries: each makes its files from the tables, reads them with the engine and has the same answer in SQL from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import as_text, batch_records, byte_sum
from seqloom.operators import aggregates, combine, process, ranges, sinks
from seqloom.operators.collection import Collection
from seqloom.plans import fixtures as fx
from seqloom.schema import DROPMALFORMED, PERMISSIVE
from seqloom.sources import plain, reader
from seqloom.sources.remote import GcsUrl, SshUrl
from seqloom.storage import PIECE, open_bytes, scratch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _duck(key: str, salt: str = "") -> str:
    return f"substr(translate(md5('{salt}' || {key}), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 8 + {key} % 25)"


S1, S2, S3 = (_duck("o_orderkey", s) for s in ("", "m", "n"))
_BYTES = "cast(list_sum(list_transform(string_split({}, ''), lambda x: ascii(x))) as bigint)"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _text(records: DataFrame, *names: str) -> DataFrame:
    return records.select("rec_index", *(as_text(n).alias(n) for n in names))


def _orders(spark: SparkSession, sf_dir: str, salt: str = "", **options) -> DataFrame:
    return reader.read_fastq(spark, fx.fastq(spark, sf_dir, salt), **options)


def _in_step(spark, sf_dir, n: int, **options) -> DataFrame:
    return combine.read_in_step(spark, [[fx.fastq(spark, sf_dir, salt) for salt in ("", "m", "n")[:n]]], **options)


def _sides(spark, sf_dir, n: int) -> list[DataFrame]:
    return [_orders(spark, sf_dir, salt) for salt in ("", "m", "n")[:n]]


def _in(c: Column) -> Column:
    return as_text(c)


# Scans


@query(f"select o_orderkey as rec_index, 'seq.' || o_orderkey as id, {S1} as seq, repeat('@', length({S1})) as qual, '+' as sep from orders")
def scan_fastq(spark, sf_dir):
    return _text(_orders(spark, sf_dir), "id", "seq", "qual", "sep")


@query(_SQL["scan_fastq"])
def scan_fastq_shuffled(spark, sf_dir):
    """The reader for stores that only Spark opens."""
    return _text(plain.read_fastq(spark, [fx.fastq(spark, sf_dir)]), "id", "seq", "qual", "sep")


@query(f"select o_orderkey as rec_index, 'seq.' || o_orderkey as id, {S1} as seq from orders")
def scan_fasta(spark, sf_dir):
    return _text(reader.read_fasta(spark, fx.fasta(spark, sf_dir)), "id", "seq")


@query("select doc_id as rec_index, 'doc ' || doc_id as id, replace(coalesce(text, ''), chr(10), '') as seq from documents")
def scan_fasta_multiline(spark, sf_dir):
    return _text(reader.read_fasta(spark, fx.documents(spark, sf_dir)), "id", "seq")


@query("select doc_id as rec_index, coalesce(text, '') as seq_raw from documents")
def seq_raw(spark, sf_dir):
    return _text(reader.read_fasta(spark, fx.documents(spark, sf_dir)), "seq_raw")


@query("select 'fasta' as format, count(*) as n_records from orders union all select 'fastq', count(*) from orders")
def format_auto(spark, sf_dir):
    records = reader.read_fastx(spark, [fx.fastq(spark, sf_dir), fx.fasta(spark, sf_dir)])
    return records.groupBy("format").agg(F.count(F.lit(1)).alias("n_records"))


@query(f"select o_orderkey as rec_index, {S1} as seq from orders")
def scan_compressed(spark, sf_dir):
    """Gzip found by content, read by the streaming data source."""
    return _text(reader.read_fastx(spark, fx.compressed(spark, sf_dir)), "seq")


@query("select o_orderkey as rec_index from orders where o_orderkey >= 100 and o_orderkey < 250")
def scan_pushed_range(spark, sf_dir):
    """A range that reaches the data source as a filter."""
    return ranges.take_range(reader.read_fastx(spark, fx.compressed(spark, sf_dir)), 100, 250).select("rec_index")


@query("select o_orderkey as rec_index, length(" + S1 + ") as seq_length from orders")
def seq_lengths(spark, sf_dir):
    return aggregates.lengths(_orders(spark, sf_dir)).drop("file")


@query("select o_orderkey as rec_index from orders")
def index_stability(spark, sf_dir):
    """Indices from many small splits, which stay as they were made when the settings change before they are read."""
    fx.fastq(spark, sf_dir)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = _orders(spark, sf_dir)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    return _text(found, "id").where("id = concat('seq.', rec_index)").select("rec_index")


@query("select o_orderkey as rec_index, case o_orderkey % 7 when 0 then 'INVALID_HEADER' when 1 then 'INVALID_SEPARATOR' when 2 then 'UNEQUAL_LENGTHS' end as error from orders")
def validation_errors(spark, sf_dir):
    return reader.read_fastq(spark, fx.broken(spark, sf_dir), mode=PERMISSIVE).select("rec_index", F.col("_error").alias("error"))


@query("select o_orderkey as rec_index from orders where o_orderkey % 7 > 2")
def validation_dropped(spark, sf_dir):
    return reader.read_fastq(spark, fx.broken(spark, sf_dir), mode=DROPMALFORMED).select("rec_index")


@query(f"select o_orderkey as rec_index, 'seq.' || o_orderkey // 2 as id, case when o_orderkey % 2 = 0 then 77 else 141 end as flag, {S1} as seq, case when o_orderkey % 11 > 0 then repeat('I', length({S1})) end as qual from orders")
def sam_to_records(spark, sf_dir):
    r = reader.read_alignments(spark, fx.sam(spark, sf_dir))
    return r.select("rec_index", as_text("id").alias("id"), "flag", as_text("seq").alias("seq"), F.col("qual").cast("string").alias("qual"))


@query("select o_orderkey // 2 as rec_index, cast(null as varchar) as error from orders where o_orderkey % 2 = 0")
def sam_mate_check(spark, sf_dir):
    pairs = combine.interleaved(reader.read_alignments(spark, fx.sam(spark, sf_dir)))
    return pairs.select("rec_index", combine.mate_error().alias("error"))


# Ranges and limits


def _range(name: str, condition: str, doc: str, *args, **kinds) -> None:
    def f(spark, sf_dir):
        return ranges.take_range(_orders(spark, sf_dir, columns=[]), *args, **kinds).select("rec_index")

    f.__name__, f.__doc__ = name, doc
    query(f"select o_orderkey as rec_index from orders where {condition}")(f)


_range("range_records", "o_orderkey >= 10 and o_orderkey < 50", "[10, 50)", 10, 50)
_range("range_from", "o_orderkey >= 1000", "From 1000 on.", 1000)
_range("range_to", "o_orderkey < 77", "Up to 77.", None, 77)
_range("range_inclusive", "o_orderkey between 10 and 50", "[10, 50]", 10, 50, end_included=True)
_range("range_excluded_start", "o_orderkey > 10 and o_orderkey < 50", "(10, 50)", 10, 50, start_excluded=True)
_range("range_empty", "false", "It ends before it starts.", 50, 10)
_range("range_past_eof", "o_orderkey >= 1400", "It ends past the last record.", 1400, 1 << 40)


@query("select o_orderkey as rec_index from orders where o_orderkey < 123")
def record_limit(spark, sf_dir):
    return _orders(spark, sf_dir, record_limit=123).select("rec_index")


@query("select o_orderkey as rec_index, 'seq.' || o_orderkey as id from orders where o_orderkey < 10")
def peek(spark, sf_dir):
    return _text(ranges.peek(_orders(spark, sf_dir), 10), "id")


@query(f"select o_orderkey as rec_index from orders where o_orderkey >= 20 and o_orderkey < 60")
def range_pairs(spark, sf_dir):
    return ranges.take_range(_in_step(spark, sf_dir, 2), 20, 60).select("rec_index")


@query("select distinct o_orderkey // 2 as rec_index from orders where o_orderkey // 2 >= 20 and o_orderkey // 2 < 60")
def range_interleaved(spark, sf_dir):
    return ranges.take_range(combine.interleaved(_orders(spark, sf_dir)), 20, 60).select("rec_index")


@query("select o_orderkey as rec_index from orders where o_orderkey >= 20 and o_orderkey < 60")
def range_multi(spark, sf_dir):
    return ranges.take_range(combine.multi(_sides(spark, sf_dir, 3)), 20, 60).select("rec_index")


@query("select distinct o_orderkey // 3 as rec_index from orders where o_orderkey // 3 >= 20 and o_orderkey // 3 < 60")
def range_multi_interleaved(spark, sf_dir):
    return ranges.take_range(combine.interleaved_multi(_orders(spark, sf_dir), 3), 20, 60).select("rec_index")


# Combinations


@query(f"select o_orderkey as rec_index, {S1} as seq1, {S2} as seq2 from orders")
def paired_rows(spark, sf_dir):
    p = _in_step(spark, sf_dir, 2, check_names=True, columns=["id", "seq"])
    return p.select("rec_index", _in(F.col("r1.seq")).alias("seq1"), _in(F.col("r2.seq")).alias("seq2"))


@query(_SQL["paired_rows"])
def paired_joined(spark, sf_dir):
    """Tables of records, joined by their ordinal."""
    p = combine.paired(*_sides(spark, sf_dir, 2), check_names=True)
    return p.select("rec_index", _in(F.col("r1.seq")).alias("seq1"), _in(F.col("r2.seq")).alias("seq2"))


@query(f"select o_orderkey as rec_index, {S1} as seq1, {S2} as seq2, {S3} as seq3 from orders")
def multi_rows(spark, sf_dir):
    m = combine.multi(_sides(spark, sf_dir, 3))
    return m.select("rec_index", *(_in(F.col(f"r{i}.seq")).alias(f"seq{i}") for i in (1, 2, 3)))


@query(f"with s as (select o_orderkey as k, {S1} as seq from orders) select a.k // 2 as rec_index, a.k as index1, b.k as index2, a.seq as seq1, b.seq as seq2 from s a join s b on b.k = a.k + 1 where a.k % 2 = 0")
def interleaved_pairs(spark, sf_dir):
    p = combine.interleaved(_orders(spark, sf_dir))
    return p.select("rec_index", F.col("r1.rec_index").alias("index1"), F.col("r2.rec_index").alias("index2"), _in(F.col("r1.seq")).alias("seq1"), _in(F.col("r2.seq")).alias("seq2"))


@query(f"with s as (select o_orderkey as k, {S1} as seq from orders) select k // 5 as rec_index, count(*) as n_members, string_agg(seq, '|' order by k) as seqs from s group by 1")
def multi_interleaved(spark, sf_dir):
    g = combine.interleaved_multi(_orders(spark, sf_dir), 5)
    return g.select("rec_index", F.size("members").cast("long").alias("n_members"), F.array_join(F.transform("members", lambda r: r.seq.cast("string")), "|").alias("seqs"))


_COLLECTION = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def _collection(spark, sf_dir, names: list[str], **options) -> Collection:
    return Collection(spark, [fx.fastq(spark, sf_dir, "", n, _COLLECTION[n]) for n in names], **options)


@query(" union all ".join(f"select {i} as file_ord, count(*) as n_records, cast(sum({_BYTES.format(_duck(k))}) as bigint) as byte_sum from {t}" for i, (t, k) in enumerate([("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")])))
def collection_single(spark, sf_dir):
    r = _collection(spark, sf_dir, ["customer", "supplier", "part"], options={"columns": ["seq"]}).single()
    return r.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n_records"), F.sum(byte_sum("seq")).alias("byte_sum"))


@query(f"select cast(g as bigint) as group_id, o_orderkey as rec_index, {S1} as seq1, {S2} as seq2 from orders cross join (values (0), (1)) t(g)")
def collection_paired(spark, sf_dir):
    a, b = fx.fastq(spark, sf_dir), fx.fastq(spark, sf_dir, "m")
    c = fx.made(spark, sf_dir, "again.fastq", lambda p: sinks.write_file(fx.records(spark, sf_dir), p))
    d = fx.made(spark, sf_dir, "again2.fastq", lambda p: sinks.write_file(fx.records(spark, sf_dir, "m"), p))
    p = Collection(spark, [a, b, c, d], "paired").paired()
    return p.select("group_id", "rec_index", _in(F.col("r1.seq")).alias("seq1"), _in(F.col("r2.seq")).alias("seq2"))


@query("select 'one' as which, 'fastq' as format union all select 'mixed', null")
def unique_format(spark, sf_dir):
    one = Collection(spark, [fx.fastq(spark, sf_dir), fx.fastq(spark, sf_dir, "m")]).unique_format()
    mixed = Collection(spark, [fx.fastq(spark, sf_dir), fx.fasta(spark, sf_dir)]).unique_format()
    return spark.createDataFrame([("one", one), ("mixed", mixed)], "which string, format string")


# Aggregates and processors


@query(f"select count(*) as n_records, cast(sum({_BYTES.format(S1)}) as bigint) as byte_sum from orders")
def seq_sum_single(spark, sf_dir):
    return aggregates.seq_sum(_orders(spark, sf_dir, columns=["seq"]))


@query(f"select count(*) as n_groups, cast(sum({_BYTES.format(S1)} + {_BYTES.format(S2)}) as bigint) as byte_sum from orders")
def paired_seq_sum(spark, sf_dir):
    """The flagship: pairs of two files, read in step, counted and summed."""
    return aggregates.seq_sum_groups(_in_step(spark, sf_dir, 2, columns=["seq"]))


@query(_SQL["paired_seq_sum"])
def paired_joined_seq_sum(spark, sf_dir):
    return aggregates.seq_sum_groups(combine.paired(*_sides(spark, sf_dir, 2)))


@query(f"select count(*) as n_groups, cast(sum({_BYTES.format(S1)} + {_BYTES.format(S2)} + {_BYTES.format(S3)}) as bigint) as byte_sum from orders")
def multi_seq_sum(spark, sf_dir):
    return aggregates.seq_sum_groups(_in_step(spark, sf_dir, 3, columns=["seq"]))


@query(f"select count(*) // 3 as n_groups, cast(sum({_BYTES.format(S1)}) as bigint) as byte_sum from orders")
def multi_interleaved_seq_sum(spark, sf_dir):
    return aggregates.seq_sum_groups(reader.read_groups(spark, fx.fastq(spark, sf_dir), 3, format="fastq", columns=["seq"]))


@query("select count(*) as n_records from orders")
def count_only(spark, sf_dir):
    return aggregates.count_records(_orders(spark, sf_dir, columns=[]))


@query("select o_orderkey // 1024 as batch, string_agg(o_orderkey, ',' order by o_orderkey) as indices from orders group by 1")
def index_collection(spark, sf_dir):
    """The sorted indices of all records, by batches of 1024: a list of bounded length in each row."""
    r = _orders(spark, sf_dir).groupBy(F.expr("rec_index div 1024").alias("batch"))
    return r.agg(F.array_join(F.array_sort(F.collect_list("rec_index")), ",").alias("indices"))


class _Sum(process.Processor):
    def __init__(self):
        self.n = self.total = 0

    def process_record(self, row):
        self.n += 1
        self.total += sum(row["seq"])

    def on_complete(self):
        return [{"n": self.n, "total": self.total}]


@query(_SQL["seq_sum_single"])
def processor_map_reduce(spark, sf_dir):
    parts = process.process(_orders(spark, sf_dir, columns=["seq"]).select("seq"), _Sum(), "n long, total long")
    return parts.agg(F.sum("n").alias("n_records"), F.sum("total").alias("byte_sum"))


@query(_SQL["seq_sum_single"])
def processor_closure(spark, sf_dir):
    def total(rows):
        sums = [sum(r["seq"]) for r in rows]
        return [{"n": len(sums), "total": sum(sums)}]

    parts = process.process(_orders(spark, sf_dir, columns=["seq"]).select("seq"), total, "n long, total long")
    return parts.agg(F.sum("n").alias("n_records"), F.sum("total").alias("byte_sum"))


class _PairSum(process.Processor):
    def __init__(self):
        self.n = self.total = 0

    def process_record(self, row):
        self.n += 1
        self.total += sum(row["r1"]["seq"]) + sum(row["r2"]["seq"])

    def on_complete(self):
        return [{"n": self.n, "total": self.total}]


@query(_SQL["paired_seq_sum"])
def processor_paired(spark, sf_dir):
    pairs = combine.paired(*(s.select("rec_index", "seq") for s in _sides(spark, sf_dir, 2)))
    return process.process(pairs, _PairSum(), "n long, total long").agg(F.sum("n").alias("n_groups"), F.sum("total").alias("byte_sum"))


@query(f"select cast(ceil(10000 / length({S1})) as bigint) as batch from orders where o_orderkey = 0")
def batch_bp(spark, sf_dir):
    first = _orders(spark, sf_dir).where("rec_index = 0")
    return first.select(batch_records(10_000, F.octet_length("seq_raw")).alias("batch"))


# Sinks


@query(f"select o_orderkey as rec_index, '@seq.' || o_orderkey || chr(10) || {S1} || chr(10) || '+' || chr(10) || repeat('?', length({S1})) as value from orders")
def fasta_to_fastq(spark, sf_dir):
    return sinks.to_lines(reader.read_fasta(spark, fx.fasta(spark, sf_dir)), "fastq").drop("file")


@query(f"select o_orderkey as rec_index, '>seq.' || o_orderkey || chr(10) || {S1} as value from orders")
def fastq_to_fasta(spark, sf_dir):
    return sinks.to_lines(_orders(spark, sf_dir), "fasta").drop("file")


@query(f"select o_orderkey as position, {S1} as seq from orders")
def ordered_output(spark, sf_dir):
    """Written in order over several files, joined by name and read again: a record's place in the file is its place in the input."""
    path = fx.made(spark, sf_dir, "ordered.fastq", lambda p: sinks.write_file(_orders(spark, sf_dir), p))
    return reader.read_fastx(spark, path).select(F.col("rec_index").alias("position"), as_text("seq").alias("seq"))


@query(f"select 2 * o_orderkey as rec_index, {S1} as seq from orders union all select 2 * o_orderkey + 1, {S2} from orders")
def paired_to_interleaved(spark, sf_dir):
    """Pairs written first mate then second, and read as one file."""
    path = fx.made(spark, sf_dir, "inter.fastq", lambda p: sinks.write_file(combine.paired(*_sides(spark, sf_dir, 2)), p))
    return _text(reader.read_fastx(spark, path), "seq")


@query(f"select o_orderkey as rec_index, 'seq.' || o_orderkey // 2 as id, {S1} as seq, case when o_orderkey % 11 > 0 then repeat('I', length({S1})) else repeat('?', length({S1})) end as qual from orders")
def sam_to_fastq(spark, sf_dir):
    path = fx.made(spark, sf_dir, "fromsam.fastq", lambda p: sinks.write_file(reader.read_alignments(spark, fx.sam(spark, sf_dir)), p))
    return _text(reader.read_fastq(spark, path), "id", "seq", "qual")


@query(f"select o_orderkey as rec_index, {S1} as seq from orders")
def from_bytes(spark, sf_dir):
    """The file's bytes through the driver's memory, as a caller with bytes in hand would: a piece at a time."""
    with open_bytes(spark, fx.fasta(spark, sf_dir)) as file:
        return _text(reader.from_bytes(spark, iter(lambda: file.read(PIECE), b"")), "seq")


@query(f"select count(*) as n_records, cast(sum({_BYTES.format(S1)}) as bigint) as byte_sum from orders")
def stream_folder(spark, sf_dir):
    """A folder's files as a stream that ends when they are read."""
    from seqloom.streaming import read_stream

    folder = fx.made(spark, sf_dir, "stream", lambda p: sinks.write_records(fx.records(spark, sf_dir), p, compression="gzip"))
    out = scratch(spark, "streamed")
    sums = read_stream(spark, folder + "/part-*").select(F.lit(1).alias("n"), byte_sum("seq").alias("b"))
    sums.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("n int, b long").parquet(out).agg(F.count(F.lit(1)).alias("n_records"), F.sum("b").alias("byte_sum"))


_URLS = ["ssh://user@example.com:2222/path/to/file.fastq", "ssh://example.com/a", "user@example.com:path/to/file.fastq", "example.com:/abs"]
_BUCKETS = ["gs://bucket/a/b.fastq.gz"]


@query(
    "select * from (values ('ssh://user@example.com:2222/path/to/file.fastq', 'user@example.com', '2222', '/path/to/file.fastq'), ('ssh://example.com/a', 'example.com', '', '/a'), "
    "('user@example.com:path/to/file.fastq', 'user@example.com', '', 'path/to/file.fastq'), ('example.com:/abs', 'example.com', '', '/abs'), ('gs://bucket/a/b.fastq.gz', 'bucket', '', 'a/b.fastq.gz')) t(url, host, port, path)"
)
def url_parse(spark, sf_dir):
    rows = [(u, p.ssh_host, str(p.port or ""), p.path) for u, p in ((u, SshUrl.parse(u)) for u in _URLS)]
    rows += [(u, g.bucket, "", g.object) for u, g in ((u, GcsUrl.parse(u)) for u in _BUCKETS)]
    return spark.createDataFrame(rows, "url string, host string, port string, path string")


def _all() -> None:
    from seqloom.plans import edge_queries  # noqa: F401 - it registers more


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
