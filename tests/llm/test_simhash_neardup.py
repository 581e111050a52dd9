"""SimHash groups against a brute-force version."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from seqloom.llm import simhash_neardup as op


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=4):
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    vocab = ["the", "of", "É", "Über", "a", "b|c", "Zu", "und", "xy", "ß"]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split(" ")
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            text = rng.choice([" ", "\n", "\t"]).join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 30, 300, 900])))
        texts.append(text)
        rows.append((i * 3, text))
    return rows


@pytest.mark.parametrize("hot", [op.HOT_BUCKET, 2])
def test_groups_equal_brute_force(spark, hot):
    rows = corpus() + [(500, None), (501, ""), (7, "same id"), (7, "same id"), (None, "no id here at all")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, fp string, component_id string")
    got = sorted((tuple(r) for r in op.near_groups(docs, hot=hot).collect()), key=str)
    assert got == brute_groups(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.near_groups(docs).collect() == []
    assert op.near_dedup(docs).collect() == []


def brute_wide(text, width, words=5):
    """A wide fingerprint from its definition, in plain integers."""
    w, full = (text or "").encode().lower().split(), (1 << 64) - 1

    def mixed(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & full
        return x ^ x >> 32

    hashes = {xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), seed=42) for i in range(max(1, len(w) - words + 1))} if w else set()
    out = 0
    for k in range(width):
        many = [mixed(h + k * 0x9E3779B97F4A7C15 & full) for h in hashes]
        out |= sum(1 << 64 * k + b for b in range(64) if 2 * sum(h >> b & 1 for h in many) > len(many))
    return out


def brute_near(rows):
    """The (doc_id, text) that stay: all pairs are compared, and linked if they are within the radius and agree on enough blocks of a word."""
    plan = op.near_plan(len(rows))
    keyed = sorted({(d, t or "") for d, t in rows if d is not None}, key=lambda r: (r[0], xxhash.xxh64_intdigest(r[1].encode(), seed=42) - (xxhash.xxh64_intdigest(r[1].encode(), seed=42) >> 63 << 64)))
    fps = [brute_wide(t, plan.words) for _, t in keyed]
    root = list(range(len(keyed)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(keyed)), 2):
        differing = fps[i] ^ fps[j]
        equal = [sum(not differing >> 64 * k + 8 * b & 255 for b in range(8)) for k in range(plan.words)]
        if differing.bit_count() <= plan.radius and max(equal) >= plan.chosen:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [keyed[i] for i in range(len(keyed)) if find(i) == i] + [(d, t or "") for d, t in rows if d is None]


def near_corpus(n=40, copies=30, seed=4):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bcdfgklmnprst" for b in "aeiou"]
    rows = [(i * 2, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 6, 80, 300])))) for i in range(n)]
    for i in range(copies):
        words = rng.choice(rows)[1].split()
        for _ in range(len(words) // 100 * (i % 2)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((1 + i * 2, " ".join(words) + " " * (i % 3)))
    return rows


@pytest.mark.parametrize("limit", [op.BROADCAST_BYTES, 0])
def test_near_copies_equal_brute_force(spark, limit):
    """With texts that share a doc_id in one group and in two, and rows that repeat both."""
    long_text = " ".join(f"w{i}" for i in range(400))
    rows = near_corpus() + [(200, long_text), (201, long_text), (201, "quite another text of few words"), (202, "a third text of other words"), (203, long_text), (203, long_text + " more"), (204, "unique in all"), (204, "unique in all"), (None, long_text), (205, None), (206, "")]
    docs = spark.createDataFrame([(d, t, i, {"k": i}) for i, (d, t) in enumerate(rows)], "doc_id long, text string, h int, m map<string,int>")
    got = op.near_dedup(docs, broadcast_bytes=limit)
    assert got.columns == docs.columns
    want = brute_near(rows)
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(want, key=str)
    assert {(200, long_text), (201, "quite another text of few words"), (202, "a third text of other words"), (None, long_text)} <= set(want) and (201, long_text) not in want


@pytest.mark.parametrize("most", [8, 32768])
def test_a_large_group_of_near_copies(spark, most):
    """Buckets that hold the whole group, searched at once and in parts; every edge is within the radius and the group is connected."""
    rng = random.Random(3)
    plan = op.near_plan(600)
    base = [rng.getrandbits(64) for _ in range(plan.words)]
    rows = []
    for _ in range(600):
        bits = rng.sample(range(64 * plan.words), 9)
        rows.append([w ^ sum(1 << b % 64 for b in bits if b // 64 == k) for k, w in enumerate(base)])
    rows += [[rng.getrandbits(64) for _ in range(plan.words)] for _ in range(50)]
    fps = np.array(rows, dtype=np.uint64)
    table = spark.createDataFrame([[int(x) for x in r] for r in fps.view(np.int64)], ", ".join(f"w{k} long" for k in range(plan.words)))
    edges = [(r.a, r.b) for r in op.near_links(table, plan, most).collect()]
    at = {n: i for i, n in enumerate(op._nodes(fps).tolist())}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        assert np.bitwise_count(fps[at[a]] ^ fps[at[b]]).sum() <= plan.radius
        root[find(at[a])] = find(at[b])
    assert len({find(i) for i in range(600)}) == 1 and len({find(i) for i in range(len(rows))}) == 51


def test_near_plan_finds_what_it_says():
    """Pairs with each bit different at the rate of the similarity share a bucket, whatever the count and so the length of the keys."""
    rng = np.random.default_rng(1)
    for count in (10, 10**6, 10**8, 5 * 10**10):
        plan = op.near_plan(count)
        share = np.arccos(1.6 / 1.8) / np.pi
        same = rng.random((4000, plan.words, 8, 8)) >= share
        assert ((same.all(3).sum(2) >= plan.chosen).any(1)).mean() > 1 - op.NEAR_MISSES - 0.02
        assert ((~same).sum((1, 2, 3)) <= plan.radius).mean() > 0.8


def test_copies_of_the_similarity_are_found(spark):
    """Held against the shares of common shingles, which the fingerprints only approximate."""
    rng = random.Random(12)
    vocab = [f"{a}{b}{c}" for a in "bdgkmpt" for b in "aeiou" for c in "lnrs"]
    pairs = []
    for i in range(150):
        words = [rng.choice(vocab) for _ in range(rng.choice([120, 300, 900]))]
        other = list(words)
        for _ in range(max(1, len(words) // 60)):
            other[rng.randrange(len(other))] = rng.choice(vocab)
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other))
        pairs.append((len(a & b) / len(a | b), " ".join(words), " ".join(other)))
    rows = [(2 * i + k, p[1 + k]) for i, p in enumerate(pairs) for k in (0, 1)]
    stays = {r.doc_id for r in op.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [i for i, p in enumerate(pairs) if p[0] >= op.NEAR_SIMILARITY]
    assert stays >= {2 * i for i in range(len(pairs))} and len(near) > 100
    assert sum(2 * i + 1 not in stays for i in near) >= 0.9 * len(near)


def test_majority_is_exact_over_many_hashes():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 2, 255, 256, 5000, 0, 3])
    hashes = rng.integers(0, 1 << 63, size=(lengths.sum(), 2), dtype=np.uint64)
    got = op.majority_bits(hashes, lengths)
    at = 0
    for n, row in zip(lengths, got, strict=True):
        part = hashes[at : at + n]
        at += n
        bits = ((part[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0) * 2 > n
        want = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1) if n else np.zeros(2)
        assert (row == want).all()


@pytest.mark.parametrize("count", [0, 10, 10**5, 10**7, 10**9])
def test_blocks_meet_every_close_pair(count):
    masks = op.block_masks(count, 4)
    rng = random.Random(2)
    for _ in range(300):
        differing = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(differing & m == 0 for m in masks)
