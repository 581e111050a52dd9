r"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order:

    block*  filter  index  footer        each followed by one newline

    block   zstd of entries: shared key bytes, other key bytes, value bytes (varints), the key's other bytes, the value; then its crc32
    value   the document's ids as unsigned 16-bit (or 32-bit) little-endian integers
    filter  Bloom filter over the keys
    index   for each block: its first key, offset, length, documents, ids
    footer  offsets and lengths of filter and index, documents, ids, id width, magic

Keys sort as bytes: 00 for a missing doc_id, else 01 and the doc_id as a big-endian integer with its sign bit flipped. Spark's text writer
writes the pieces (it copies a string's bytes as they are and ends each with a newline), so shards go to any file system that Spark knows,
through its commit protocol: a lost executor's shard is written again and never seen half. A shard holds SHARD_BLOCKS blocks at most, and a
block ends with the document that fills it, so a file's size is bounded by that of its largest documents, whatever the table's.
"""

from __future__ import annotations

import binascii
import json
import os
import re
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import map_arrow, materialize, one_a_worker, scratch, text_or_empty
from seqloom.storage import list_files, read_bytes

MAGIC = b"SLT1"
FOOTER = struct.Struct("<QQQQQQB4s")
BLOCK_BYTES = 256 << 10
#: Blocks of a shard: some 64 MB. Three more pieces end it.
SHARD_BLOCKS = 253
#: Cached encodings of a worker; beyond that it begins anew.
CACHE_CHUNKS = 400_000
CACHE_WORDS = 1_000_000
#: Task and file within the task, in a part file's name: their order is that of the keys.
FILE_ORDER = r"part-(\d+)-[^/]*-c(\d+)[^/]*$"
BLOOM_BITS, BLOOM_HASHES = 10, 7


def to_key(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def from_key(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_bits(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % (1 << 64) % size for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Pieces of a shard from entries in key order; holds one block and the keys."""

    def __init__(self, width: int):
        self.width, self.offset, self.docs, self.ids = width, 0, 0, 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self._new()

    def _new(self) -> None:
        self.entries, self.size, self.first, self.last, self.block_docs, self.block_ids = [], 0, b"", b"", 0, 0

    def _piece(self, data: bytes) -> bytes:
        self.offset += len(data) + 1
        return data

    def _flush(self) -> Iterator[bytes]:
        if self.block_docs:
            packed = zstandard.ZstdCompressor(level=1).compress(b"".join(self.entries))
            packed += struct.pack("<I", binascii.crc32(packed))
            self.index.append((self.first, self.offset, len(packed), self.block_docs, self.block_ids))
            yield self._piece(packed)
            self._new()

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        shared = len(os.path.commonprefix([self.last, key])) if self.block_docs else 0
        self.first = self.first or key
        self.entries += [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self.size, self.last = self.size + len(value) + 16, key
        self.block_docs, self.block_ids = self.block_docs + 1, self.block_ids + len(value) // self.width
        self.docs, self.ids = self.docs + 1, self.ids + len(value) // self.width
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            yield from self._flush()

    def close(self) -> Iterator[bytes]:
        yield from self._flush()
        size = max(64, len(self.keys) * BLOOM_BITS)
        bits = bytearray((size + 7) // 8)
        for key in self.keys:
            for b in _bloom_bits(key, size):
                bits[b >> 3] |= 1 << (b & 7)
        bloom = struct.pack("<Q", size) + bytes(bits)
        index = b"".join(_varint(len(k)) + k + b"".join(map(_varint, rest)) for k, *rest in self.index)
        at = self.offset
        yield self._piece(bloom)
        yield self._piece(index)
        yield FOOTER.pack(at, len(bloom), at + len(bloom) + 1, len(index), self.docs, self.ids, self.width, MAGIC)


class Shard:
    """Reads a shard: in key order, or by key through filter, index and one block. read(at, n) gives its bytes: only what is asked for is read."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        bloom_at, bloom_len, index_at, index_len, self.docs, self.ids, self.width, magic = FOOTER.unpack(read(size - 1 - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self._bloom_place = (bloom_at, bloom_len)
        data, at = read(index_at, index_len), 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            rest = []
            for _ in range(4):
                v, at = _read_varint(data, at)
                rest.append(v)
            self.index.append((key, *rest))
        self.first_keys = [entry[0] for entry in self.index]

    @classmethod
    def of_bytes(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n], len(data))

    @cached_property
    def bloom(self) -> tuple[int, bytes]:
        data = self.read(*self._bloom_place)
        return struct.unpack_from("<Q", data)[0], data[8:]

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.width}").astype("<u4")

    def block(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, length, _, _ = self.index[n]
        packed = self.read(at, length)
        if binascii.crc32(packed[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError(f"block {n} is damaged")
        data = zstandard.ZstdDecompressor().decompress(packed[:-4])
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + other], at + other
            yield key, self._ids(data[at : at + length])
            at += length

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for n in range(len(self.index)):
            yield from self.block(n)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document with that doc_id."""
        key = to_key(doc_id)
        size, bits = self.bloom
        if not all(bits[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, size)):
            return None
        # Blocks that begin with the key itself may follow the one in which it begins.
        n = max(0, bisect_left(self.first_keys, key) - 1)
        while n < len(self.index) and self.first_keys[n] <= key:
            for k, ids in self.block(n):
                if k == key:
                    return ids
            n += 1
        return None


class Shards:
    """Look-ups in a folder of shards from the driver: a search among the files, then footer, index, filter and block of one, each read by its range."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        order = lambda found: tuple(map(int, re.search(FILE_ORDER, found[0]).groups()))
        self.files = sorted(((f, n) for f, n in list_files(spark, [path]) if n), key=order)
        self._opened: dict[int, Shard] = {}

    def _shard(self, i: int) -> Shard:
        if i not in self._opened:
            file, size = self.files[i]
            self._opened[i] = Shard(lambda at, n: read_bytes(self.spark, file, at, n), size)
        return self._opened[i]

    def get(self, doc_id: int | None) -> np.ndarray | None:
        key = to_key(doc_id)
        i = max(0, bisect_left(range(len(self.files)), key, key=lambda i: self._shard(i).first_keys[0]) - 1)
        while i < len(self.files) and self._shard(i).first_keys[0] <= key:
            if (ids := self._shard(i).get(doc_id)) is not None:
                return ids
            i += 1
        return None


def drops_white_space(settings: dict) -> bool:
    """Whether a tokenizer file, whose parts are named so, splits texts at white space and words from signs before anything else, so that chunks between
    white space can be encoded alone: it makes white space one space, lower-cases, and takes only runs of letters, digits and other signs."""
    normalizer, pre = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    steps = [n.get("type") for n in normalizer.get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    split = parts[0] if parts else {}
    runs = split.get("pattern", {}).get("Regex", "") if split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" else ""
    return (
        steps == ["NFC", "Replace", "Lowercase"] and normalizer["normalizers"][1].get("pattern") == {"Regex": r"\s+"} and normalizer["normalizers"][1].get("content") == " "
        and runs.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") for p in parts[1:])
        and not any(a.get("normalized") or a.get("lstrip") or a.get("rstrip") for a in settings.get("added_tokens", []))
    )


class ChunkEncoder:
    """Encodes texts chunk by chunk between white space, each distinct chunk once, and each distinct word of Latin letters once.

    For tokenizers that drop white space before they split words: there no token, merge or normalisation crosses it. If the vocabulary marks word
    ends and the text is lower-cased first, a plain word's ids are the same alone and before punctuation, so words are looked up without their
    case and punctuation, and unknown words are encoded together and parted at the marks. Texts for other tokenizers are encoded whole.
    """

    #: str.split() also splits here, where the tokenizer sees no white space.
    CONTROLS = "\x1c\x1d\x1e\x1f"
    PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?|*#%&$]*)").fullmatch

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # a word comes but once here
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        suffix = found["model"].get("end_of_word_suffix")
        self.by_chunks = drops_white_space(found)
        self.words: dict[str, bytes] | None = {} if suffix and self.by_chunks else None
        vocabulary = found["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.cache: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn_words(self, words: list[str]) -> None:
        for k in range(0, len(words), 200):
            part = words[k : k + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(stops) != len(part):
                self.words.update(zip(part, self._encode(part), strict=True))
                continue
            data = ids.tobytes()
            self.words.update(zip(part, map(data.__getitem__, map(slice, [0, *stops], stops)), strict=False))

    def _learn(self, chunks: set[str]) -> None:
        cache, words = self.cache, self.words
        if len(cache) + len(chunks) > CACHE_CHUNKS:
            cache.clear()
        if words is not None:
            if len(words) > CACHE_WORDS:
                words.clear()
            plain = {c: (m[1].lower(), m[2]) for c in chunks if (m := self.PLAIN(c))}
            self._learn_words(list({w for w, _ in plain.values() if w not in words}))
            signs = {p for _, p in plain.values() if p and p not in words}
            words.update(zip(signs, self._encode(list(signs)), strict=True))
            for c, (w, p) in plain.items():
                cache[c] = words[w] + words[p] if p else words[w]
            chunks = chunks - plain.keys()
        cache.update(zip(chunks, self._encode(list(chunks)), strict=True))

    def __call__(self, text: str) -> bytes:
        if not self.by_chunks or any(c in text for c in self.CONTROLS):
            return self._encode([text])[0]
        chunks = text.split()
        get = self.cache.__getitem__
        try:
            return b"".join(map(get, chunks))
        except KeyError:
            distinct = set(chunks)
            if len(distinct) > CACHE_CHUNKS // 2:  # a text that the cache can't hold
                return b"".join(self(" ".join(chunks[i : i + CACHE_CHUNKS // 4])) for i in range(0, len(chunks), CACHE_CHUNKS // 4))
            self._learn(distinct.difference(self.cache))
            try:
                return b"".join(map(get, chunks))
            except KeyError:  # the cache was emptied meanwhile
                self._learn(distinct.difference(self.cache))
                return b"".join(map(get, chunks))


def _encoder(path: str, width: int) -> ChunkEncoder:
    """One to a worker: its caches serve the worker's later tasks too."""
    return one_a_worker(("tokens", path, width), lambda: ChunkEncoder(path, width))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_blocks: int = SHARD_BLOCKS) -> None:
    """Writes docs (doc_id, text) as shards under path: a range of doc_ids each, in order, of shard_blocks blocks at most.

    A null text has no ids but the end id; rows that repeat a doc_id follow each other by text; rows without a doc_id come first. An empty table
    gives no shard. Columns other than doc_id and text are not read.
    """

    def work(batches):
        with open(tokenizer, encoding="utf-8") as f:
            width = 2 if len(json.load(f)["model"]["vocab"]) <= 1 << 16 and end_id < 1 << 16 else 4
        encode, end = _encoder(tokenizer, width), np.array([end_id], dtype=f"<u{width}").tobytes()
        shard = ShardWriter(width)
        rows = lambda pieces: pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary())], ["piece"])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for piece in shard.add(to_key(doc_id), encode(text) + end):
                    yield rows([piece])
                if len(shard.index) == shard_blocks:  # the writer begins a new file after as many pieces
                    for piece in shard.close():
                        yield rows([piece])
                    shard = ShardWriter(width)
        if shard.docs:
            for piece in shard.close():
                yield rows([piece])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    dealt = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    map_arrow(dealt, work, "piece binary", keeps="tokens").select(F.col("piece").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", shard_blocks + 3).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards: ids before it, its ids, their crc32 as little-endian 32-bit integers."""

    def work(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard, at = Shard.of_bytes(content.as_py()), 0
                columns: tuple[list, ...] = ([], [], [], [])
                for key, ids in shard:
                    for column, v in zip(columns, (from_key(key), at, len(ids), binascii.crc32(ids.tobytes())), strict=True):
                        column.append(v)
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0])), *(pa.array(c, pa.int64()) for c in columns)], ["shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", "content")
    rows = materialize(map_arrow(files, work, "shard string, doc_id long, within long, n_tokens long, ids_crc32 long"), "shards")
    # One row for each shard: their running total is the only thing in a single task.
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    order = [F.regexp_extract("shard", FILE_ORDER, k).cast("long") for k in (1, 2)]
    before = F.sum("ids").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def shards_digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs as shards in the shared folder and reads them back."""
    path = scratch(docs.sparkSession, "tokens")
    write_shards(docs, path, tokenizer, end_id)
    return read_shards(docs.sparkSession, path)
