"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role share a block and are its parts:

    ### role: first text<part>second text</turn>
    ### other role: text</turn>

Texts and roles have the characters of control strings replaced (backslash, #, < and, in roles, the colon), so no control string can occur in
them and the reader gets every turn back. The loss mask is kept by segment: the segments' texts, joined, are the formatted conversation, and
`loss` says which of them are learned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import text_or_empty

ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
PART, END = "<part>", "</turn>\n"


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:  # the backslash first: every later one begins an escape
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):  # the backslash last
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted string, segments array<struct<text, loss boolean>>), one row per conv_id.

    turns: conv_id, turn, role, text; other columns are not read. Turns go by turn, ties by role, then text; repeated rows are repeated turns.
    A null role or text counts as empty, a null turn comes first, and rows without a conv_id form a conversation of their own.
    """
    row = F.struct(F.col("turn"), text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t")).withColumn("n", F.size("t"))
    # Neighbours side by side, so that each turn knows whether it begins or ends its block: linear in the turns.
    roles = F.transform("t", lambda x: x.role)
    edge = F.array(F.lit(None).cast("string"))
    before, after = F.concat(edge, F.slice(roles, 1, F.col("n") - 1)), F.concat(F.slice(roles, 2, F.col("n")), edge)
    zipped = sorted_turns.select("conv_id", F.arrays_zip(F.col("t").alias("t"), before.alias("before"), after.alias("after")).alias("z"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit("### "), escape(x.t.role, ROLE_ESCAPES), F.lit(": "))
        head = F.when(x.before.eqNullSafe(x.t.role), F.lit(PART)).otherwise(head)
        tail = F.when(x.after.eqNullSafe(x.t.role), F.lit("")).otherwise(F.lit(END))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(head, F.lit(False)), piece(escape(x.t.text), x.t.role == learned_role), piece(tail, F.lit(False)))

    out = zipped.select("conv_id", F.flatten(F.transform("z", segments)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns back from the formatted text alone."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")

    def turns(block: Column) -> Column:
        rest = F.substring(block, F.lit(5), F.length(block))
        role = F.substring_index(rest, ": ", 1)
        body = F.substring(rest, F.length(role) + 3, F.length(rest))
        return F.transform(F.split(body, PART), lambda p: F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")


def digest(turns: DataFrame) -> DataFrame:
    """The formatted conversations read back: counts and hashes of turns and learned text."""
    out = format_conversations(turns)
    out = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), read_loss_text(F.col("segments")).alias("loss"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(written.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: The same from the table, without formatting: only the lengths of the template are known here.
DIGEST_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t as (
  select *, lag(role) over w as before, lead(role) over w as after, row_number() over w as k from rows
  window w as (partition by conv_id order by turn nulls first, role, text)
), parts as (
  select *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) as text_chars,
    length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) as role_chars
  from t
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(text_chars + case when before is not distinct from role then 6 else 6 + role_chars end + case when after is not distinct from role then 0 else 8 end)::bigint as formatted_chars
from parts group by conv_id
"""
