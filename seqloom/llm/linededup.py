"""Line dedup over overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines that aren't blank form a window, hashed to 128 bits. A window found more than once is kept where it occurs first
(smallest doc_id, then position); the positions that its later occurrences cover are merged and their lines removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import BROADCAST_BYTES, materialize, text_or_empty

WINDOW = 3
#: Two seeds: equal windows are taken to be equal where both 64-bit hashes are.
SEEDS = (0, 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and the text's hash tell rows apart, even where a doc_id repeats; rows that agree in both are the same document."""
    text = text_or_empty(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("h"), F.split(text, "\n").alias("lines"))


def windows(docs: DataFrame) -> DataFrame:
    """(a, b, d, h, p array<int>): each window's hashes, its document's key and the three positions of its lines."""
    rows = _keyed(docs)
    strip = lambda x: F.trim(x, F.lit(" \t\r"))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("p"), strip(x).alias("s")))
    hashed = F.transform(F.filter(numbered, lambda x: x.s != ""), lambda x: F.struct(x.p.alias("p"), *(F.xxhash64(F.lit(seed), x.s).alias(f"h{seed}") for seed in SEEDS)))
    rows = rows.select("d", "h", hashed.alias("l")).where(F.size("l") >= WINDOW)
    shifted = [F.slice("l", k + 1, F.size("l") - (WINDOW - 1)).alias(f"l{k}") for k in range(WINDOW)]
    rows = rows.select("d", "h", F.explode(F.arrays_zip(*shifted)).alias("w"))
    over = lambda name: F.xxhash64(*(F.col(f"w.l{k}.{name}") for k in range(WINDOW)))
    return rows.select(over("h0").alias("a"), over("h1").alias("b"), "d", "h", F.array(*(F.col(f"w.l{k}.p") for k in range(WINDOW))).alias("p"))


def covered_positions(docs: DataFrame) -> DataFrame:
    """(d, h, covered array<int>): the lines of each document that later occurrences of a window cover."""
    found = windows(docs)
    # Counted before the shuffle; the join has one row on this side for each repeated window, so a frequent one can be split on the other.
    place = F.struct("d", "h", F.col("p")[0].alias("p"))
    first = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("a", "b", "first")
    later = found.join(first, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("d", "h", F.explode("p").alias("p")).groupBy("d", "h").agg(F.collect_set("p").alias("covered"))


def dedup_lines(docs: DataFrame, counted: str = "removed_lines", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with text reduced to the lines that stay and a column `counted` of how many went; every row and other column is kept.

    Documents of fewer than three lines with content have no window and stay whole; so do the blank lines between. A document whose lines are
    all covered keeps its row with an empty text; a null text stays null. Rows that repeat a doc_id and text count as one document. A column of
    docs that has the name of `counted` is replaced.

    The covered positions are broadcast, and no text is shuffled, while they measure broadcast_bytes at most; beyond they are joined by a merge.
    """
    covered = materialize(covered_positions(docs), "covered")
    measured = covered.agg(F.sum(F.lit(64) + 4 * F.size("covered"))).first()[0] or 0
    covered = F.broadcast(covered) if measured <= broadcast_bytes else covered.hint("merge")
    text = text_or_empty(docs.text)
    joined = docs.join(covered, docs.doc_id.cast("long").eqNullSafe(covered.d) & (F.xxhash64(text) == covered.h), "left")
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered.covered)
    reduced = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    columns = [F.when(covered.covered.isNull(), docs.text).otherwise(reduced).alias("text") if c == "text" else docs[c] for c in docs.columns if c != counted]
    return joined.select(*columns, F.coalesce(F.size(covered.covered), F.lit(0)).cast("long").alias(counted))


#: The lines that stay, from a relation {docs}(doc_id, text): used for the query and for the pipeline's stage.
DEDUP_SQL = r"""
numbered as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as p from {docs}
), solid as (
  select doc_id, p, trim(line, ' ' || chr(9) || chr(13)) as s, row_number() over (partition by doc_id order by p) as k
  from numbered where trim(line, ' ' || chr(9) || chr(13)) <> ''
), windows as (
  select x.doc_id, x.k, x.s || chr(10) || y.s || chr(10) || z.s as w
  from solid x join solid y on x.doc_id = y.doc_id and y.k = x.k + 1 join solid z on x.doc_id = z.doc_id and z.k = x.k + 2
), marked as (
  select doc_id, k, row_number() over (partition by w order by doc_id, k) > 1 as later from windows
), covered as (
  select distinct m.doc_id, m.k + o.o as k from marked m cross join (values (0), (1), (2)) o(o) where m.later
), gone as (
  select s.doc_id, s.p from solid s join covered c on s.doc_id = c.doc_id and s.k = c.k
), reduced as (
  select n.doc_id, coalesce(string_agg(n.line, chr(10) order by n.p) filter (g.p is null), '') as text, count(g.p)::bigint as removed_lines
  from numbered n left join gone g on n.doc_id = g.doc_id and n.p = g.p group by n.doc_id
)
"""
OP_SQL = "with " + DEDUP_SQL.replace("{docs}", "(select doc_id, coalesce(text, '') as text from documents)") + "select doc_id, text, length(text)::bigint as n_chars, removed_lines from reduced"
