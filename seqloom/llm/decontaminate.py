"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet in seeds of MIN_MATCH shared tokens. For each such pair the longest match of tokens that aren't marked yet is
found by Karp-Rabin hashes and marked in both, again and again, until no match of MIN_MATCH tokens is left. An item counts as leaked into a
document if the tiles cover a threshold of its tokens, in whatever order they stand. An item of fewer tokens than a seed is a seed of its own
length: it leaked where all its tokens stand together.

Tokens are runs of letters, digits and underscores: text without breaks between words, as in Chinese, is one token up to the next sign, and
meets only the same run.
"""

from __future__ import annotations

import re
from collections import Counter
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import map_arrow, materialize, one_a_worker, small_rows, text_or_empty

MIN_MATCH = 5
THRESHOLD = 0.5
#: A benchmark of so many bytes is held by every worker, whose index takes some ten times that.
HELD_BYTES = 16 << 20
#: Beyond it, so many items are tiled with a document at once.
ITEMS_AT_ONCE = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=out[1:])
    return out


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of a length."""
    if len(ids) < length:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(ids) - length + 1, dtype=np.uint64)
    for k in range(length):
        out = out * _BASE + ids[k : k + len(out)]
    return out


def _open_windows(blocked: np.ndarray, length: int) -> np.ndarray:
    """Where windows of a length without a blocked token start."""
    if len(blocked) < length:
        return np.zeros(0, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(blocked)])
    return np.flatnonzero(total[length:] == total[:-length])


def tiled(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> int:
    """How many of the item's tokens the tiles cover. Token 0 of doc matches nothing."""
    item_marked, doc_marked = np.zeros(len(item), dtype=bool), doc == 0
    power = _powers(max(len(item), len(doc)))
    prefix = []
    for ids in (item, doc):
        h, whole = 0, [0]
        for x in ids.tolist():
            h = (h * int(_BASE) + x) & ((1 << 64) - 1)
            whole.append(h)
        prefix.append(np.array(whole, dtype=np.uint64))

    def hashes(which: int, starts: np.ndarray, length: int) -> np.ndarray:
        return prefix[which][starts + length] - prefix[which][starts] * power[length]

    longest = len(item)
    with np.errstate(over="ignore"):
        while longest >= least:
            # The longest common length of windows that are open in both: what a window has, its parts have.
            low, high, mid, found = least, longest, longest, None
            while low <= high:
                a, b = _open_windows(item_marked, mid), _open_windows(doc_marked, mid)
                ha, hb = hashes(0, a, mid), hashes(1, b, mid)
                shared = np.isin(hb, ha)
                if shared.any():
                    found, low = (mid, a, ha, b[shared], hb[shared]), mid + 1
                else:
                    high = mid - 1
                mid = (low + high) // 2
            if found is None:
                break
            longest, a, ha, b, hb = found
            marked = False
            for at, h in zip(b, hb, strict=True):
                if doc_marked[at : at + longest].any():
                    continue
                for i in a[ha == h]:
                    if not item_marked[i : i + longest].any() and (item[i : i + longest] == doc[at : at + longest]).all():
                        item_marked[i : i + longest] = doc_marked[at : at + longest] = marked = True
                        break
            if not marked:  # hashes that met by chance
                longest -= 1
    return int(item_marked.sum())


class Items:
    """Benchmark items by seed. Items of fewer tokens are held by their length and hash. An item without tokens is never reported."""

    def __init__(self, rows: list[tuple[int, str]], least: int = MIN_MATCH):
        self.least, self.vocabulary = least, {}
        self.items, seeds, owners, places = [], [], [], []
        self.short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for item_id, text in rows:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text or "")], dtype=np.uint64)
            if len(ids) < least:
                if len(ids):
                    with np.errstate(over="ignore"):
                        self.short.setdefault(len(ids), {}).setdefault(int(rolling(ids, len(ids))[0]), []).append((item_id, ids))
                continue
            with np.errstate(over="ignore"):
                h = rolling(ids, least)
            seeds.append(h)
            owners.append(np.full(len(h), len(self.items)))
            places.append(np.arange(len(h)))
            self.items.append((item_id, ids))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        seeds, owners, places = join(seeds, np.uint64), join(owners, np.int64), join(places, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners, self.places = seeds[order], owners[order], places[order]
        self.distinct = np.unique(self.seeds)

    def match(self, text: str, threshold: float) -> list[tuple[int, float]]:
        """(item_id, coverage) of the items that tiles cover to the threshold."""
        words = tokens(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        return [*self._match_short(ids), *self._match_seeds(ids, threshold)]

    def _match_short(self, ids: np.ndarray) -> list[tuple[int, float]]:
        found = []
        for length, held in self.short.items():
            with np.errstate(over="ignore"):
                h = rolling(ids, length)
            for at in np.flatnonzero(np.isin(h, np.fromiter(held, dtype=np.uint64, count=len(held)))):
                found += [(item_id, 1.0) for item_id, item in held[int(h[at])] if (item == ids[at : at + length]).all()]
        return list(dict.fromkeys(found))

    def _match_seeds(self, ids: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        if len(ids) < self.least or not len(self.distinct):
            return []
        starts = _open_windows(ids == 0, self.least)
        if not len(starts):
            return []
        with np.errstate(over="ignore"):
            h = rolling(ids, self.least)[starts]
        at = np.minimum(np.searchsorted(self.distinct, h), len(self.distinct) - 1)
        hit = self.distinct[at] == h
        starts, h = starts[hit], h[hit]
        if not len(starts):
            return []
        low, high = np.searchsorted(self.seeds, h), np.searchsorted(self.seeds, h, side="right")
        entries = np.unique(np.concatenate([np.arange(a, b) for a, b in set(zip(low.tolist(), high.tolist(), strict=True))]))
        found = []
        for owner in np.unique(self.owners[entries]):
            item_id, item = self.items[owner]
            mine = entries[self.owners[entries] == owner]
            cover = np.zeros(len(item), dtype=bool)
            for p in self.places[mine]:
                cover[p : p + self.least] = True
            if cover.sum() < threshold * len(item):
                continue  # tiles can't cover more than seeds do
            inside = np.zeros(len(ids), dtype=bool)
            own = np.isin(h, self.seeds[mine])
            for p in starts[own]:
                inside[p : p + self.least] = True
            part = np.where(inside, ids, 0)
            keep = inside | np.concatenate([[False], inside[:-1]])  # one separator after each run
            share = tiled(item, part[keep], self.least) / len(item)
            if share >= threshold:
                found.append((item_id, share))
        return found


def _columns(batch, found: list[list[tuple[int, float]]], keys: list[str]) -> pa.RecordBatch:
    best = [min(f, key=lambda x: (-x[1], x[0])) if f else (None, None) for f in found]
    arrays = [batch.column(k) for k in keys] + [pa.array([len(f) for f in found], pa.int64()), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, [*keys, "n_items", "item_id", "coverage"])


def _by_join(docs: DataFrame, items: DataFrame, least: int, threshold: float) -> DataFrame:
    """For a benchmark that is too large for every worker: seeds meet in a join, then the pairs that can reach the threshold are tiled.

    Tiles that cover a share of an item take so many of its seeds; leaving out one less, the most frequent in the benchmark, a document that
    reaches the threshold still has one of the rest. So a seed that many items share doesn't join them all with every document.
    """

    def seeds(key: str, lengths: list[int]):
        """Each seed of a text: its hash, its number of places there, the text's tokens. With lengths all seeds of these, else the text's own."""

        def work(batches):
            for batch in batches:
                for k, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), strict=True):
                    w = tokens(text)
                    found = Counter(xxhash.xxh64_intdigest(" ".join(w[i : i + n])) - (1 << 63) for n in lengths or [min(least, len(w))] if n for i in range(len(w) - n + 1))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64()), pa.array([len(w)] * len(found), pa.int64())], [key, "seed", "places", "size"])

        return work

    def tile(batches):
        for batch in batches:
            found = [Items([(i["item"], i["item_text"]) for i in chosen], least).match(t, threshold) for chosen, t in zip(batch.column("chosen").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield _columns(batch, found, ["h", "n"])

    keyed = docs.select(F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n"), "text")
    named = items.select(F.col("item_id").alias("item"), F.col("text").alias("item_text"))
    right = materialize(map_arrow(items.select(F.col("item_id").alias("item"), "text"), seeds("item", []), "item long, seed long, places long, size long"), "item-seeds")
    lengths = [r.n for r in right.select(F.least(F.lit(least), "size").alias("n")).distinct().collect()]  # `least` different ones at most
    if not lengths:
        return docs.select("doc_id", F.xxhash64("text").alias("h"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("double").alias("coverage"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("size") * threshold / least))
    often = right.groupBy("seed").agg(F.count(F.lit(1)).alias("n_owners"))
    spared = F.sum("places").over(Window.partitionBy("item").orderBy(F.desc("n_owners"), "seed").rowsBetween(Window.unboundedPreceding, 0))
    rare = right.join(often, "seed").withColumn("spared", spared).where(F.col("spared") > needed - 1).select("item", "seed")
    left = map_arrow(keyed.select(F.col("h").alias("k"), "text"), seeds("k", lengths), "k long, seed long, places long, size long").select("k", "seed")
    pairs = left.join(rare, "seed").select(F.col("k").alias("h"), "item").distinct().join(named, "item")
    # A document's items in parts of some, so that no row grows with the benchmark; its text comes once for each.
    part = (F.sum(F.lit(1)).over(Window.partitionBy("h").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)) / ITEMS_AT_ONCE).cast("long")
    chosen = pairs.withColumn("part", part).groupBy("h", "part").agg(F.collect_list(F.struct("item", "item_text")).alias("chosen"))
    chosen = materialize(chosen, "candidates")
    texts = keyed.join(chosen.select("h").distinct(), "h", "left_semi").dropDuplicates(["h", "n"])
    tiles = map_arrow(texts.join(chosen, "h").select("h", "n", "text", "chosen"), tile, "h long, n long, n_items long, item_id long, coverage double").where("n_items > 0")
    best = F.min(F.struct((-F.col("coverage")).alias("c"), "item_id")).alias("best")
    summed = tiles.groupBy("h", "n").agg(F.sum("n_items").alias("n_items"), best)
    out = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n")).join(summed, ["h", "n"], "left")
    return out.select("doc_id", "h", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best.item_id").alias("item_id"), (-F.col("best.c")).alias("coverage"))


def _held_items(items: DataFrame, held_bytes: int):
    """A broadcast of the benchmark's rows if their measured size is within held_bytes, else None."""
    rows = small_rows(items, held_bytes)
    return None if rows is None else items.sparkSession.sparkContext.broadcast(sorted((r.item_id, r.text) for r in rows))


def _usable(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty(F.col("text")).alias("text"))
    return items.where("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc_id, h, n_items, item_id, coverage): one row per row of docs.

    n_items: benchmark items whose tokens are covered to the threshold. item_id and coverage: of the most covered one (ties: the smallest id), null
    if there is none. h is xxhash64 of the text. Null and empty texts match nothing; items without an id or without tokens are not used; of rows
    that repeat an item_id the greatest text counts; repeated rows give repeated results. The benchmark is held by every worker if its measured size is within held_bytes, else joined.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    items = _usable(benchmark)
    held = _held_items(items, held_bytes)
    if held is None:
        return _by_join(narrow, items, least, threshold)

    run = uuid4().hex

    def work(batches):
        index = one_a_worker(("benchmark", run), lambda: Items(held.value, least))
        for batch in batches:
            yield _columns(batch, [index.match(t, threshold) for t in batch.column("text").to_pylist()], ["doc_id", "h"])

    return map_arrow(narrow.select("doc_id", F.xxhash64("text").alias("h"), "text"), work, "doc_id long, h long, n_items long, item_id long, coverage double", keeps="benchmark")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD, held_bytes: int = HELD_BYTES) -> DataFrame:
    """docs without those that a benchmark item leaked into; their columns stay as they are.

    Rows are judged where they are read, and no text is shuffled, if the benchmark can be held.
    """
    held = _held_items(_usable(benchmark), held_bytes)
    if held is None:
        found = contamination(docs, benchmark, least, threshold, held_bytes).where("n_items > 0").select("doc_id", "h").distinct()
        found = materialize(found, "leaks")
        return docs.join(found, docs.doc_id.cast("long").eqNullSafe(found.doc_id) & (F.xxhash64(text_or_empty(docs.text)) == found.h), "left_anti")

    run = uuid4().hex

    def work(batches):
        index = one_a_worker(("benchmark", run), lambda: Items(held.value, least))
        for batch in batches:
            yield batch.filter(pa.array([not index.match(t or "", threshold) for t in batch.column("text").to_pylist()], pa.bool_()))

    return map_arrow(docs, work, docs.schema, keeps="benchmark")
