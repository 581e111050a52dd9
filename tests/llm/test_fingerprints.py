"""Document fingerprints against a brute-force version."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from seqloom.llm import fingerprints as op


def brute_print(text):
    """The 256 bits from their definition, in plain integers: weighted term hashes vote."""
    words, full, weights = text.encode().lower().split(), (1 << 64) - 1, Counter()
    for i in range(max(1, len(words) - 2)) if words else ():
        weights[b" ".join(words[i : i + 3])] += 1
    votes = [0] * 256
    for term, weight in weights.items():
        digest, lanes = xxhash.xxh3_128_digest(term), []
        halves = [int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")]
        for h, m in zip(halves, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True):
            x = (h ^ h >> 31) * m & full
            lanes.append(x ^ x >> 29)
        for k, lane in enumerate([*halves, *lanes]):
            for b in range(64):
                votes[64 * k + b] += weight if lane >> b & 1 else -weight
    return [sum(1 << b for b in range(64) if votes[64 * k + b] > 0) for k in range(4)]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        a, b, c = map(brute_print, (t, edited, after))
        like = lambda x, y: 1 - sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) / 256
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), *("".join(f"{p:016x}" for p in x) for x in (a, b)), like(a, b), like(a, c)))
    return sorted(out, key=str)


def corpus(n):
    rng = random.Random(n)
    return [(i * 7 % 1000 - 300, " ".join(rng.choice(["é", "the", "of", "xyz", "ß🙂", "word\n"]) for _ in range(rng.choice([0, 1, 2, 5, 60, 400])))) for i in range(n)]


def test_equals_brute_force(spark):
    for rows in (corpus(90) + [(5000, None), (5001, ""), (None, "no id"), (5002, "same"), (5002, "same"), (5002, "other")], [(1, "alone here")], [(2, "a b c"), (1, "d e f")]):
        docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, bucket int, fingerprint string")
        assert sorted(map(tuple, op.edited_fingerprints(docs).collect()), key=str) == brute(rows)


def test_large_ids_and_a_null(spark):
    """Ids that a double can't hold, with and without a null among them, over few and many ranges."""
    rows = [((1 << 62) + i, f"text of number {i}") for i in range(400)] + [(None, "no id"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    docs, before = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "3", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert sorted(map(tuple, op.edited_fingerprints(docs).collect()), key=str) == brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_very_long_text(spark):
    rng = random.Random(1)
    rows = [(1, "short"), (2, " ".join(rng.choice(["a", "bé", "cc", "dd🙂"]) for _ in range(150_000))), (3, "another")]
    assert sorted(map(tuple, op.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert op.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_texts_and_likeness(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(rng.choice(words) for _ in range(600))
    b = " ".join(rng.choice(words) for _ in range(600))
    x, y, z, e = op.fingerprint_texts([a.encode(), a.encode(), b.encode(), (a[: len(a) * 2 // 3] + b[: len(a) // 3]).encode()])
    assert (x == y).all() and op.likeness(x, e) > 0.65 > 0.6 > op.likeness(x, z)


@pytest.mark.parametrize(("radius", "hot"), [(7, op.HOT_LEAD), (7, 3), (0, 1), (12, 5)])
def test_search_finds_all_within_the_radius(spark, radius, hot):
    """Most rows share their leading blocks; copies give one row."""
    rng = random.Random(6)
    base = [rng.getrandbits(256) for _ in range(3)]
    rows = []
    for i in range(150):
        f = rng.choice(base)
        for b in rng.sample(range(256), rng.randrange(0, 12)):
            f ^= 1 << b
        rows.append((i, f"{f:064x}"))
    rows += [(200, rows[0][1]), (201, None), *((300 + i, rows[1][1]) for i in range(40))]
    table = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = sorted(tuple(r) for r in op.search(table.where("doc_id % 20 = 0"), table, radius, hot).collect())
    known = {int(f, 16) for _, f in rows if f}
    want = sorted((q, f"{y:064x}", (int(x, 16) ^ y).bit_count()) for q, x in rows if q % 20 == 0 and x for y in known if (int(x, 16) ^ y).bit_count() <= radius)
    assert got == want


@pytest.mark.parametrize("radius", [-1, 64])
def test_a_radius_without_blocks_is_refused(spark, radius):
    table = spark.createDataFrame([(1, "0" * 64)], "doc_id long, fingerprint string")
    with pytest.raises(ValueError):
        op.search(table, table, radius)
