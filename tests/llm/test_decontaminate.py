"""Greedy string tiling against a brute-force version."""

import random

import numpy as np
import pytest

from seqloom.llm import decontaminate as op


def brute_cover(item, doc, least):
    """Tokens of item that tiles cover: all windows of every length, longest first, by position in doc, then in item."""
    taken_item, taken_doc = [False] * len(item), [False] * len(doc)
    for n in range(len(item), least - 1, -1):
        for j in range(len(doc) - n + 1):
            for i in range(len(item) - n + 1):
                if item[i : i + n] == doc[j : j + n] and not any(taken_item[i : i + n]) and not any(taken_doc[j : j + n]):
                    taken_item[i : i + n] = taken_doc[j : j + n] = [True] * n
    return sum(taken_item)


def brute(docs, items, least=op.MIN_MATCH, threshold=op.THRESHOLD):
    out = []
    for d, t in docs:
        words, found = op.tokens(t or ""), []
        for i, text in items:
            w = op.tokens(text or "")
            if i is not None and w and (share := brute_cover(w, words, min(least, len(w))) / len(w)) >= threshold:
                found.append((-share, i))
        share, i = min(found, default=(None, None))
        out.append((d, len(found), i, share and -share))
    return sorted(out, key=str)


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [(i, " ".join(words(rng.choice([3, 5, 12, 30])))) for i in range(12)] + [(None, " ".join(words(9))), (50, None), (51, "")]
    items.append((60, items[3][1]))  # two items of one text
    docs = []
    for d in range(n):
        text, item = words(rng.randrange(0, 60)), (rng.choice(items)[1] or "").split()
        kind = rng.randrange(5)
        if kind == 1:  # whole
            text += [*item, *words(8)]
        elif kind == 2 and len(item) > 10:  # reordered parts
            k = rng.randrange(5, len(item) - 4)
            text = [*words(4), *item[k:], *text, *item[:k]]
        elif kind == 3 and item:  # a word changed
            item[rng.randrange(len(item))] = "other"
            text += item
        elif kind == 4:  # a beginning
            text += item[: len(item) // 2]
        docs.append((d, " ".join(text).title() if d % 3 else ", ".join(text)))
    return docs + [(100, None), (101, ""), (7, "same id"), (7, "same id"), (None, items[3][1])], items


@pytest.mark.parametrize("held_bytes", [op.HELD_BYTES, 0])
def test_equals_brute_force(spark, held_bytes):
    docs, items = corpus()
    got = op.contamination(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, n_items int"), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, h int"), held_bytes=held_bytes)
    assert sorted(map(tuple, got.select("doc_id", "n_items", "item_id", "coverage").collect()), key=str) == brute(docs, items)


@pytest.mark.parametrize("held_bytes", [op.HELD_BYTES, 0])
def test_short_items_and_a_seed_that_all_share(spark, held_bytes):
    """Items of one to four tokens are found where they stand whole; a passage of every item and document joins none that don't leak."""
    rng = random.Random(5)
    words = lambda k: " ".join(f"x{rng.randrange(10**6)}" for _ in range(k))
    common = "every item has these words"
    items = [(i, f"{common} {words(25)}") for i in range(30)] + [(100, "lone"), (101, "two words"), (102, "A, b; c d"), (103, "...")]
    docs = [(i, f"{words(20)} {common} {words(20)}") for i in range(40)]
    docs += [(50, f"{items[3][1]} {words(5)}"), (51, "quite lone here"), (52, "words two words"), (53, "two other words"), (54, "a b c e a b c d"), (55, items[4][1] + " two words")]
    got = op.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), held_bytes=held_bytes)
    assert sorted(map(tuple, got.select("doc_id", "n_items", "item_id", "coverage").collect()), key=str) == brute(docs, items)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9, 1.0])
def test_join_by_rare_seeds_equals_brute_force(spark, threshold):
    docs, items = corpus(50, seed=8)
    items += [(70, "r s " * 12), (71, "q " * 20 + "end of it all here")]
    docs += [(200, "r s " * 9), (201, "q " * 11), (202, "end of it all here")]
    got = op.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), threshold=threshold, held_bytes=0)
    assert sorted(map(tuple, got.select("doc_id", "n_items", "item_id", "coverage").collect()), key=str) == brute(docs, items, threshold=threshold)


def test_tiles_equal_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        item, doc = ([rng.randrange(1, 4) for _ in range(rng.randrange(3, 25))] for _ in range(2))
        assert op.tiled(np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64), 3) == brute_cover(item, doc, 3)


@pytest.mark.parametrize("held_bytes", [op.HELD_BYTES, 0])
def test_leaks_go_and_columns_stay(spark, held_bytes):
    item = " ".join(f"t{i}" for i in range(30))
    docs = [(1, "a b c d e f", "q"), (2, f"before {item} after", "q"), (3, None, "q"), (None, item, "q"), (4, " ".join(item.split()[15:] + ["x"] + item.split()[:15]), "q"), (5, " ".join(item.split()[:10]), "q")]
    got = op.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, h string"), spark.createDataFrame([(9, item)], "item_id long, text string"), held_bytes=held_bytes)
    assert got.columns == ["doc_id", "text", "h"] and sorted(r.doc_id for r in got.collect()) == [1, 3, 5]


def test_very_long_text(spark):
    item = " ".join(f"t{i}" for i in range(40))
    text = "t1 t2 t3 t4 t5 t6 " * 30_000 + item
    got = op.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (got.n_items, got.coverage) == (1, 1.0)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert op.contamination(docs, items).collect() == []
    assert [r.n_items for r in op.contamination(spark.createDataFrame([(1, "x")], docs.schema), items).collect()] == [0]
