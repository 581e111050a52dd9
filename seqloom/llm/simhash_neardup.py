"""SimHash near-duplicate groups by pigeonhole blocks.

A document's fingerprint has a bit for each position of the 64-bit hashes of its word shingles, set where over half of the hashes have it. Two
fingerprints link at `radius` or fewer differing bits. Cut into m blocks, such a pair agrees on m - radius blocks at least, so each choice of
m - radius blocks is a table keyed by their bits: linked pairs share a bucket of some table, and only bucket mates are compared.

Copies never multiply: equal fingerprints are one node from the start, a bucket yields a spanning forest instead of pairs, and a bucket of over
HOT_BUCKET fingerprints is linked through shared points: two fingerprints differ in 4 bits or fewer exactly if some point is within 2 bits of
both, so each member lists its points and meets its neighbours there, which is linear in the bucket. No link is lost either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice, repeat
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import BROADCAST_BYTES, SLICE_BYTES, discard, held_small, majority_bits, map_arrow, materialize, text_or_empty

SEED = 42
#: A bucket's members are compared with each other up to this number; for more, listing the points around each is less work.
HOT_BUCKET = 16384


def shingle_hashes(text: bytes, words: int = 4) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, repeats included, in pieces."""
    tokens = text.lower().split()  # of bytes: only A-Z change, and only 0x20 and 0x09 to 0x0D split
    if not tokens:
        return
    shingles = iter([b" ".join(tokens)]) if len(tokens) < words else map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    hashed = map(xxhash.xxh64_digest, shingles, repeat(SEED))
    while piece := b"".join(islice(hashed, 1 << 18)):
        yield np.frombuffer(piece, dtype=">u8").astype(np.uint64)


def fingerprint_texts(texts: list[bytes], words: int = 4) -> np.ndarray:
    """The 64-bit fingerprints of the texts; zero for a text without words."""
    pieces, lengths = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        for piece in shingle_hashes(text, words):
            pieces.append(piece)
            lengths[i] += len(piece)
    hashes = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.uint64)
    return majority_bits(hashes.reshape(-1, 1), lengths)[:, 0]


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp long) for each row of docs; a null text counts as empty."""

    def work(batches):
        for batch in batches:
            fps = fingerprint_texts(batch.column("text").cast(pa.binary()).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    return map_arrow(narrow, work, "doc_id long, fp long")


def block_masks(count: int, radius: int) -> list[int]:
    """The tables' masks over 64 bits: as many blocks that `count` random fingerprints fill a bucket with a quarter of a row at most, up to 10 more."""
    for m in range(radius + 1, radius + 7):
        kept = m - radius
        if 64 * kept // m >= np.log2(max(count, 1)) + 2 or comb(m, kept) > 200:
            break
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    return [sum(chosen) for chosen in combinations(blocks, kept)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a bucket: a search that drops a member once it is reached."""
    left, right = [], []
    rest = members
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at))
                right.append(found)
                frontier.extend(found)
                rest = rest[~near]
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _link_buckets(radius: int, hot: int):
    """Over rows sorted by (tab, bucket): edges (a, b) of each bucket's forest; (a, null) for every member of a bucket of over `hot`."""

    def emit(a: np.ndarray, b: np.ndarray | None):
        a = pa.array(a.view(np.int64))
        return pa.RecordBatch.from_arrays([a, pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], ["a", "b"])

    def work(batches):
        key, held, count, over = None, [], 0, False
        for batch in batches:
            tab, bucket, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tab", "bucket", "fp"))
            fp = np.ascontiguousarray(fp).view(np.uint64)
            cuts = np.flatnonzero((np.diff(tab) != 0) | (np.diff(bucket) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [len(fp)]])
            sizes = np.diff(bounds)
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                start, end = bounds[g], bounds[g + 1]
                now = (tab[start], bucket[start])
                if now != key:
                    if count > 1 and not over:
                        a, b = _forest(np.concatenate(held), radius)
                        if len(a):
                            yield emit(a, b)
                    key, held, count, over = now, [], 0, False
                held.append(fp[start:end].copy())
                count += end - start
                if count > hot:
                    over = True
                    yield emit(np.concatenate(held), None)
                    held = []
        if count > 1 and not over:
            a, b = _forest(np.concatenate(held), radius)
            if len(a):
                yield emit(a, b)

    return work


def _points(half: int):
    """All points within `half` bits of a fingerprint."""
    masks = [0] + [sum(1 << b for b in bits) for k in range(1, half + 1) for bits in combinations(range(64), k)]
    masks = np.array(masks, dtype=np.uint64)

    def work(batches):
        for batch in batches:
            fp = np.ascontiguousarray(batch.column("a").to_numpy()).view(np.uint64)
            for i in range(0, len(fp), 256):
                part = fp[i : i + 256]
                points = (part[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], ["point", "fp"])

    return work


def links(distinct: DataFrame, count: int, radius: int = 4, hot: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) between the fingerprints of `distinct` (column fp, unique) that connect exactly what pairs at `radius` bits or fewer connect."""
    masks = block_masks(count, radius)
    tables = F.array(*(F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for i, m in enumerate(masks)))
    rows = distinct.select("fp", F.explode(tables).alias("t")).select("t.tab", "t.bucket", "fp")
    rows = rows.repartition("tab", "bucket").sortWithinPartitions("tab", "bucket")
    found = materialize(rows.mapInArrow(_link_buckets(radius, hot), "a long, b long").distinct(), "links")
    near = found.where("b is not null")
    crowded = found.where("b is null").select("a")
    if crowded.isEmpty():
        return near
    # radius 4: points within 2 bits of both. For an odd radius the half is rounded up and each meeting is verified below.
    half = (radius + 1) // 2
    meet = map_arrow(crowded, _points(half), "point long, fp long")
    if radius % 2 == 0:
        # At most as many fingerprints meet in a point as there are points around one, so the set is bounded.
        meet = meet.groupBy("point").agg(F.array_sort(F.collect_set("fp")).alias("m")).where(F.size("m") > 1)
        met = meet.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, 1 << 30)).alias("b"))
    else:
        meet = meet.groupBy("point").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1)
        pairs = meet.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).where("a < b")
        met = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return near.union(met.distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the smallest node of its component, by alternating large and small stars.

    Each round is written to the shared folder; the end is reached when a round changes no edge.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    sign = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = tuple(e.agg(*sign).first())
    while before[0]:
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        discard(e)
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = materialize(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        discard(large)
        now = tuple(e.agg(*sign).first())
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4, hot: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    component_id is the smallest doc_id among the documents that links reach. Null and empty texts have fingerprint zero and are linked like
    any other; repeated rows give repeated results; a null doc_id is reported with its group's smallest id (null if it has none). Columns other
    than doc_id and text are not read.
    """
    fps = materialize(fingerprints(docs, words), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    nodes = connected(links(distinct.select("fp"), distinct.count(), radius, hot))
    rooted = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by similarity: wide fingerprints, whose radius follows from the similarity asked for.

#: Word shingles and their similarity (shared of all distinct ones) from which on documents are near copies.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: The share of pairs at exactly that similarity that may share no bucket.
NEAR_MISSES = 0.05
BLOCKS = 8
#: A table's keys have so many bits that a bucket has this many random fingerprints at most.
NEAR_BUCKET_BITS = 8
#: Up to this size buckets are compared together, row by row; in larger ones reached members are dropped from the search.
SMALL_BUCKET = 256
#: Buckets beyond are cut into parts, and each two parts are searched in a task of their own.
SPLIT_BUCKET = 32768


@dataclass(frozen=True)
class NearPlan:
    """Fingerprints of so many words of 64 bits; a table for each choice of `chosen` of the 8 blocks of a word; links at `radius` bits or fewer."""

    words: int
    chosen: int
    radius: int

    @property
    def masks(self) -> list[int]:
        """Of one word; table t is mask t % len(masks) of word t // len(masks)."""
        width = 64 // BLOCKS
        return [sum(((1 << width) - 1) << width * b for b in blocks) for blocks in combinations(range(BLOCKS), self.chosen)]


def near_plan(count: int, similarity: float = NEAR_SIMILARITY) -> NearPlan:
    """The plan for `count` documents. Bits of such a pair differ with the probability angle / pi, so the radius is the expected number and a
    standard deviation. Longer keys, which a larger table needs, are met less often; more words make up for it, whatever the count."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    chosen = min(BLOCKS, max(2, ceil((log2(max(count, 1)) - NEAR_BUCKET_BITS) / (64 // BLOCKS))))
    agree = (1 - share) ** (64 // BLOCKS)
    meets = sum(comb(BLOCKS, i) * agree**i * (1 - agree) ** (BLOCKS - i) for i in range(chosen, BLOCKS + 1))
    words = max(3, ceil(log(NEAR_MISSES) / log(1 - meets)))
    return NearPlan(words, chosen, int(64 * words * share + sqrt(64 * words * share * (1 - share))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit of the input reaches all of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def wide_fingerprints(texts: list[bytes], width: int, words: int = NEAR_WORDS) -> np.ndarray:
    """(n, width) uint64: SimHash over the distinct shingles of each text; zeros for a text without words."""
    found = []
    for text in texts:
        pieces = list(shingle_hashes(text, words))
        found.append(np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, dtype=np.uint64))
    hashes = np.concatenate(found)
    steps = np.uint64(0x9E3779B97F4A7C15) * np.arange(width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        many = _mixed(hashes[:, None] + steps[None, :])
    return majority_bits(many, np.array([len(f) for f in found])) if len(hashes) else np.zeros((len(texts), width), dtype=np.uint64)


def _nodes(fps: np.ndarray) -> np.ndarray:
    """A 64-bit name of each wide fingerprint."""
    name = fps[:, 0]
    for k in range(1, fps.shape[1]):
        name = _mixed(name) ^ fps[:, k]
    return name.view(np.int64)


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= radius


def _small_links(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of spanning forests of all buckets at once; rows of a bucket stand together."""
    left, right, d = [], [], 1
    rows = np.flatnonzero(bucket[1:] == bucket[:-1])
    while len(rows):
        near = rows[_close(fps[rows], fps[rows + d], radius)]
        left.append(near)
        right.append(near + d)
        d += 1
        rows = rows[rows + d < len(bucket)]
        rows = rows[bucket[rows] == bucket[rows + d]]
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))
    root, before = np.arange(len(fps)), None
    while before is None or (root != before).any():
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return moved, root[moved]


def _large_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of one large bucket: a search that drops a member once it is reached."""
    left, right, rest = [], [], np.arange(len(fps))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = _close(fps[rest], fps[at], radius)
            if near.any():
                left.append(np.full(near.sum(), at))
                right.append(rest[near])
                frontier.extend(rest[near].tolist())
                rest = rest[~near]
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _link_near(plan: NearPlan, most: int | None):
    """Over rows sorted by key: edges (a, b) between names; of a bucket of over `most` rows its members instead, as (key, a, null, words)."""
    columns = [f"w{k}" for k in range(plan.words)]

    def edges(fps: np.ndarray, left: np.ndarray, right: np.ndarray):
        names = _nodes(fps)
        none = pa.nulls(len(left), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(names[left]), pa.array(names[right]), *[none] * plan.words], ["key", "a", "b", *columns])

    def crowd(key: np.ndarray, fps: np.ndarray):
        words = [pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(plan.words)]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(_nodes(fps)), pa.nulls(len(key), pa.int64()), *words], ["key", "a", "b", *columns])

    def whole(key: np.ndarray, fps: np.ndarray):
        """Edges of buckets that are there whole."""
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(key))
        large = np.flatnonzero(ends - starts > SMALL_BUCKET)
        for g in large:
            part = fps[starts[g] : ends[g]]
            left, right = _large_links(part, plan.radius)
            if len(left):
                yield edges(part, left, right)
        small = np.repeat(ends - starts, ends - starts) <= SMALL_BUCKET
        if small.any():
            part = fps[small]
            left, right = _small_links(part, key[small], plan.radius)
            if len(left):
                yield edges(part, left, right)

    def work(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last key
        size, over = 0, None
        for batch in batches:
            key = batch.column("key").to_numpy()
            fps = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in columns], axis=1)
            if over is not None:
                n = int(np.searchsorted(key != over, True))
                if n:
                    yield crowd(key[:n], fps[:n])
                key, fps = key[n:], fps[n:]
                if not len(key):
                    continue
                over = None
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if last or (held and held[0][0][0] != key[-1]):
                parts = [*held, (key[:last], fps[:last])]
                yield from whole(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                held, size = [], 0
            held.append((key[last:].copy(), fps[last:].copy()))
            size += len(key) - last
            if most is not None and size > most:
                yield crowd(*(np.concatenate(x) for x in zip(*held, strict=True)))
                over, held, size = key[-1], [], 0
        if held:
            yield from whole(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return work


def near_links(distinct: DataFrame, plan: NearPlan, most: int = SPLIT_BUCKET) -> DataFrame:
    """Edges (a, b) between the names of wide fingerprints, whose words are w0, w1, … of `distinct`: in each bucket they connect what pairs at
    `radius` bits or fewer connect there."""
    columns = [f"w{k}" for k in range(plan.words)]
    masks = plan.masks
    tables = distinct.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(plan.words * len(masks) - 1))).alias("t"))
    word = F.get(F.array(*columns), F.floor(F.col("t") / len(masks)).cast("int"))
    mask = F.get(F.array(*(F.lit(_signed(m)) for m in masks)), F.col("t") % len(masks))
    rows = tables.select(F.xxhash64("t", word.bitwiseAND(mask)).alias("key"), *columns)
    schema = ", ".join(f"{c} long" for c in ("key", "a", "b", *columns))
    linked = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_link_near(plan, most), schema)
    # A pair is found in many tables: each task's own repeats go before the shuffle.
    linked = materialize(linked, "near")
    edges = linked.where("b is not null").select("a", "b")
    crowded = linked.where("b is null").select("key", *columns)
    if crowded.isEmpty():
        return edges.distinct()
    parts = crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (most // 2)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64(*columns, F.lit(1)), F.col("n")).cast("int")
    each = crowded.join(parts, "key").select("key", *columns, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    each = each.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *columns)
    more = each.repartition("key").sortWithinPartitions("key").mapInArrow(_link_near(plan, None), schema)
    return edges.union(more.select("a", "b")).distinct()


def near_dedup(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without all but one document of each group of near copies; the columns stay as they are.

    Documents are near copies if their wide fingerprints over shingles of `words` words differ in the plan's radius at most; groups are what such
    pairs connect. Of a group the row with the smallest doc_id stays, of texts with one doc_id that whose xxhash64 is smallest, of rows that
    repeat both the first by the hash of their other columns. Null and empty texts are one group. Rows without a doc_id stay and take no part.

    The keys of what goes are broadcast, and no text is shuffled, while they measure broadcast_bytes at most; beyond they are joined.
    """
    plan = near_plan(docs.count(), similarity)
    columns = [f"w{k}" for k in range(plan.words)]

    def work(batches):
        for batch in batches:
            fps = wide_fingerprints(batch.column("text").cast(pa.binary()).to_pylist(), plan.words, words)
            each = [pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(plan.words)]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("h"), pa.array(_nodes(fps)), *each], ["d", "h", "node", *columns])

    text = text_or_empty(F.col("text"))
    narrow = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    fps = materialize(map_arrow(narrow, work, ", ".join(f"{c} long" for c in ("d", "h", "node", *columns)), SLICE_BYTES // 4), "wide")
    distinct = materialize(fps.groupBy("node").agg(F.min(F.struct("d", "h")).alias("least"), *(F.first(c).alias(c) for c in columns)), "distinct")
    roots = connected(near_links(distinct, plan)).withColumnRenamed("node", "n")
    rooted = distinct.join(roots, distinct.node == roots.n, "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("least").alias("stays"))
    goes = fps.join(rooted.join(stays, "root").select("node", "stays"), "node").where(F.struct("d", "h") != F.col("stays"))
    goes = materialize(goes.select("d", "h").distinct(), "goes")
    keys = [docs.doc_id.cast("long"), F.xxhash64(text_or_empty(docs.text))]
    meets = lambda other: (keys[0] == other.d) & (keys[1] == other.h)
    small = held_small(goes, broadcast_bytes)
    out = docs.join(F.broadcast(goes) if small else goes.hint("merge"), meets(goes), "left_anti")
    twice = materialize(fps.groupBy("d", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "h"), "twice")
    discard(fps, distinct)
    if twice.isEmpty():
        return out
    held = F.broadcast(twice) if held_small(twice, broadcast_bytes) else twice.hint("merge")
    others = [F.col(f"`{c}`") for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t]
    order = Window.partitionBy(F.col("doc_id"), F.xxhash64(text_or_empty(F.col("text")))).orderBy(F.xxhash64(*others) if others else F.lit(0))
    free = next(f"n{i}" for i in range(len(docs.columns) + 1) if f"n{i}" not in docs.columns)
    first = out.join(held, meets(twice), "left_semi").withColumn(free, F.row_number().over(order)).where(f"{free} = 1").drop(free)
    return out.join(held, meets(twice), "left_anti").unionByName(first)
