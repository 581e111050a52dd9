"""SimHash document fingerprints of 256 bits, and a search for all within a Hamming radius.

A document's terms are its three-word shingles; a term's hash votes on each bit with the number of times the term occurs, and a bit is set where
over half of the weight votes for it. In a search by radius r the fingerprints are cut into r + 1 blocks; each table is the fingerprints permuted
so that one block leads, and two fingerprints within r bits agree on the leading block of some table.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import majority_bits, map_arrow, materialize, text_or_empty

BITS, WORDS = 256, 4
TERM_WORDS = 3
#: Fingerprints that may share a leading block before the bits behind it are cut as well.
HOT_LEAD = 1024
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _term_hashes(text: bytes):
    tokens = text.lower().split()
    if not tokens:
        return
    terms = iter([b" ".join(tokens)]) if len(tokens) < TERM_WORDS else map(b" ".join, zip(*(tokens[i:] for i in range(TERM_WORDS)), strict=False))
    hashed = map(xxhash.xxh3_128_digest, terms)
    while piece := b"".join(islice(hashed, 1 << 17)):
        h = np.frombuffer(piece, dtype="<u8").reshape(-1, 2)
        with np.errstate(over="ignore"):
            other = (h ^ h >> np.uint64(31)) * _MIX
        yield np.hstack([h, other ^ other >> np.uint64(29)])


def fingerprint_texts(texts: list[bytes]) -> np.ndarray:
    """(n, 4) uint64: the texts' fingerprints; zeros for a text without words."""
    pieces, lengths = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        for piece in _term_hashes(text):
            pieces.append(piece)
            lengths[i] += len(piece)
    return majority_bits(np.concatenate(pieces), lengths) if pieces else np.zeros((len(texts), WORDS), dtype=np.uint64)


def to_hex(fps: np.ndarray) -> list[str]:
    data = fps.astype(">u8").tobytes().hex()
    return [data[i : i + 64] for i in range(0, len(data), 64)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=-1) / BITS


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): a hexadecimal fingerprint for each row of docs; a null text counts as empty."""

    def work(batches):
        for batch in batches:
            fps = fingerprint_texts(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(to_hex(fps))], ["doc_id", "fingerprint"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text")), work, "doc_id long, fingerprint string")


def search(queries: DataFrame, fingerprints: DataFrame, radius: int, hot: int = HOT_LEAD) -> DataFrame:
    """(query_id, fingerprint, distance): for each row of queries (doc_id, fingerprint) the distinct fingerprints of the other table within radius bits.

    The documents of a fingerprint are those of the table given, so copies aren't multiplied. Null fingerprints match nothing. Where over `hot`
    fingerprints share a leading block, the bits behind it, which differ in radius bits at most too, are cut into blocks again.
    """
    digits = BITS // 4
    if not 0 <= radius < digits:
        raise ValueError(f"radius {radius} isn't between 0 and {digits - 1}: each block needs a digit")
    cut = lambda n: [(n * i // (radius + 1), n * (i + 1) // (radius + 1)) for i in range(radius + 1)]  # noqa: E731 - in hexadecimal digits
    whole = cut(digits)
    behind = lambda c, a, b: F.concat(F.substring(c, 1, a), F.substring(c, b + 1, digits - b))
    tables = F.array(*(F.struct(F.lit(i).alias("tab"), F.substring("x", a + 1, b - a).alias("lead"), behind("x", a, b).alias("rest")) for i, (a, b) in enumerate(whole)))
    deal = lambda df: df.select(F.col("fingerprint").alias("x")).where("x is not null").distinct().select("x", F.explode(tables).alias("t")).select("x", "t.*")
    dealt = materialize(deal(fingerprints), "leads")
    crowded = materialize(dealt.groupBy("tab", "lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("tab", "lead", F.lit(True).alias("crowded")), "crowded")
    # Leading blocks differ by a digit in length, so what is behind them is cut by its own length.
    lengths = sorted({digits - (b - a) for a, b in whole})
    again = lambda n: F.array(*(F.struct(F.lit(i).alias("sub"), F.substring("rest", a + 1, b - a).alias("next")) for i, (a, b) in enumerate(cut(n))))
    cuts = reduce(lambda c, n: F.when(F.length("rest") == n, again(n)).otherwise(c), lengths[1:], again(lengths[0]))
    last = F.array(F.struct(F.lit(-1).alias("sub"), F.lit("").alias("next")))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.join(crowded, ["tab", "lead"], "left").select("tab", "lead", F.col("x").alias(name), F.explode(F.when(F.col("crowded"), cuts).otherwise(last)).alias("s")).select("tab", "lead", "s.*", name)

    part = lambda c, i: F.conv(F.substring(c, 16 * i + 1, 16), 16, -10).cast("long")
    distance = sum((F.bit_count(part("q", i).bitwiseXOR(part("f", i))) for i in range(WORDS)), F.lit(0))
    near = keyed(deal(queries), "q").join(keyed(dealt, "f"), ["tab", "lead", "sub", "next"]).select("q", "f", distance.alias("distance")).where(F.col("distance") <= radius).distinct()
    return near.join(queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("q")), "q").select("query_id", F.col("f").alias("fingerprint"), "distance")


def _cuts(ids: DataFrame, parts: int) -> list[int]:
    """Ascending doc_ids that cut the table into about `parts` even ranges; one number for each partition comes to the driver."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 10 * parts)).first()[0] or []))


def _bucket(doc_id: Column, cuts: list[int]) -> Column:
    """The range of a doc_id, descending: the largest are in 0, rows without one in the last. JVM only: a search among every k-th cut, then among k."""
    if not cuts:
        return F.lit(0)
    k = min(isqrt(len(cuts)) + 1, len(cuts))
    constant = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # noqa: E731 - folded to a literal
    below = lambda values: F.size(F.filter(values, lambda c: c < doc_id))
    group = below(constant(cuts[k - 1 :: k]))
    at = group * k + below(F.slice(constant(cuts), group * k + 1, k))
    return F.when(doc_id.isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - at).cast("int")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    A document's edited text has its last third replaced by the beginning of the next document's, by descending doc_id (ties by text, a null
    doc_id last, the first after the last). A null text counts as empty. Each text is shuffled once: ranges of doc_ids go to a partition each, with a
    copy of the row that follows the range.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    ids = narrow.select("doc_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(ids, parts)
    bucket = _bucket(F.col("doc_id"), cuts)
    firsts = ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("first")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # Where the first row of each range is needed too: in the range before it.
    to = {firsts[i].first: firsts[i - 1].bucket for i in range(len(firsts))}
    targets = spark.createDataFrame(list(to.items()), "first long, bucket int")
    guests = narrow.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("first"))).select("bucket", F.lit(True).alias("guest"), "doc_id", "text")
    rows = narrow.select(bucket.alias("bucket"), F.lit(False).alias("guest"), "doc_id", "text").union(guests)
    dealt = rows.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), "text")

    def result(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        edited = []
        for _, text, after in pairs:
            k = len(text) // 3
            edited.append((text[: len(text) - k] + after[:k]).encode())
        own = fingerprint_texts([p[1].encode() for p in pairs] + [pairs[-1][2].encode()])
        changed = fingerprint_texts(edited)
        own, following = own[:-1], own[1:]
        columns = {
            "doc_id": pa.array([p[0] for p in pairs], pa.int64()), "n_chars": pa.array([len(p[1]) for p in pairs], pa.int64()), "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            "fingerprint": pa.array(to_hex(own)), "edited_fingerprint": pa.array(to_hex(changed)), "near_edited": pa.array(likeness(own, changed)), "near_next": pa.array(likeness(own, following)),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def work(batches):
        held, guest = [], None
        for batch in batches:
            for is_guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("guest", "doc_id", "text")), strict=True):
                if is_guest:
                    guest = text if guest is None else guest
                else:
                    held.append((doc_id, text))
            if len(held) > 1:
                yield result([(d, t, following) for (d, t), (_, following) in zip(held, held[1:], strict=False)])
                held = held[-1:]
        if held:
            yield result([(*held[0], guest)])

    return map_arrow(dealt, work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
