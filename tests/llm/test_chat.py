"""Chat formatting: an exact round trip."""

import hashlib

from pyspark.sql import functions as F

from seqloom.llm import chat

HARD = [r"\### Assistant: </turn> ok", "<part>", r"\b\h\l\c \\ # <", "", "é</turn>\n### user: x", "\n", "a" * 50_000]


def rows():
    out = [(1, i, ["user", "assistant", "assistant", "a: b"][i % 4], t) for i, t in enumerate(HARD)]
    out += [(2, 1, "assistant", "second"), (2, 0, "assistant", "first"), (2, 1, "assistant", "second")]
    out += [(3, 0, "user", None), (4, None, None, "no turn"), (4, 0, "assistant", "x"), (None, 0, "system", "no conversation")]
    return out


def expected():
    groups = {}
    for c, n, r, t in rows():
        groups.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    out = {}
    for c, g in groups.items():
        g.sort()
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in g), "".join(t for *_, r, t in g if r == "assistant")
        out[c] = (len(g), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    turns = spark.createDataFrame([(*r, "extra") for r in rows()], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(turns).collect()}
    assert got == expected()


def test_adjacent_turns_of_a_role_share_a_block(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns).first()
    assert row.formatted == "### user: a<part>b</turn>\n### assistant: c</turn>\n"
    assert [s.text for s in row.segments if s.loss] == ["c"]


def test_empty_table(spark):
    assert chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_plan_has_no_python(spark):
    turns = spark.range(3).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    plan = chat.digest(turns)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
