"""Line dedup against a brute-force version."""

import random

import pytest

from seqloom.llm import linededup as op


def brute(rows):
    """rows: unique (doc_id, text)."""
    first, later = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        solid = [(i, s) for i, s in enumerate(x.strip(" \t\r") for x in (t or "").split("\n")) if s]
        for k in range(len(solid) - 2):
            w = tuple(s for _, s in solid[k : k + 3])
            if first.setdefault(w, (d, k)) != (d, k):
                later.setdefault(d, set()).update(i for i, _ in solid[k : k + 3])
    return {d: ("\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in later.get(d, ())) if d in later else t, len(later.get(d, ()))) for d, t in rows}


def corpus():
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(9)] + ["", "  ", "é\t", "x\r"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n" * 5), (None, "line 1\nline 2\nline 3"), (103, "line 1\nline 2\nline 3\n" * 40), (104, "\n".join(f"u{i}" for i in range(30_000)))]
    return rows


@pytest.mark.parametrize("limit", [op.BROADCAST_BYTES, 0])
def test_equals_brute_force(spark, limit):
    docs = spark.createDataFrame([(d, t, "p", "q") for d, t in corpus()], "doc_id long, text string, covered string, h string")
    out = op.dedup_lines(docs, broadcast_bytes=limit)
    assert out.columns == [*docs.columns, "removed_lines"]
    assert {r.doc_id: (r.text, r.removed_lines) for r in out.collect()} == brute(corpus())


def test_a_given_count_is_replaced(spark):
    docs = spark.createDataFrame([(1, "x", "a\nb\nc"), (2, "y", "a\nb\nc")], "doc_id long, removed_lines string, text string")
    out = op.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "removed_lines"] and sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", 0), (2, "", 3)]
    named = op.dedup_lines(docs, "n_gone")
    assert sorted(map(tuple, named.collect())) == [(1, "x", "a\nb\nc", 0), (2, "y", "", 3)]


def test_rows_that_repeat_a_doc_id(spark):
    text = "a\nb\nc"
    docs = spark.createDataFrame([(1, text), (1, text), (1, "z\n" + text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in op.dedup_lines(docs).collect())
    assert len(got) == 4 and got[-1] == (2, "")
    assert sum(t == text or t == "z\n" + text for _, t in got) in (1, 2)


def test_empty_table(spark):
    assert op.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string").selectExpr("doc_id", "text")
    plan = op.covered_positions(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
