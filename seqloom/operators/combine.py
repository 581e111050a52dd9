"""Reading in step: pairs and groups of records by their ordinal.

Records of several files meet by rec_index; records of one interleaved file by rec_index div k. A length that doesn't fit is an error of the job,
found where the records meet, with no counting pass before. The checks are filters, so they hold whatever columns or aggregates are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import FIRST, PAIRED, has_flag
from seqloom.sources import reader


def _unless(bad: Column, message: Column) -> Column:
    """A filter's condition that is an error where `bad` holds."""
    return F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def _side(records: DataFrame, name: str) -> DataFrame:
    keys = [c for c in ("group_id",) if c in records.columns]
    kept = [c for c in records.columns if c not in keys]
    # The mark says that a record is there without a need for the record itself, so that unused fields aren't moved.
    return records.select(*keys, F.col("rec_index").alias("ordinal"), F.struct(*kept).alias(name), F.lit(True).alias(f"has_{name}"))


def multi(sides: list[DataFrame], check: Column | None = None) -> DataFrame:
    """(rec_index, r1, r2, …): record i of each with record i of the others; with a group_id where the records have one.

    check: an error message for a row of r1, r2, … or null.
    """
    if not sides:
        raise ValueError("nothing to combine")
    names = [f"r{i + 1}" for i in range(len(sides))]
    keys = [*(["group_id"] if "group_id" in sides[0].columns else []), "ordinal"]
    joined = reduce(lambda a, b: a.join(b, keys, "full_outer"), [_side(s, n) for s, n in zip(sides, names, strict=True)])
    lacks = [F.col(f"has_{n}").isNull() for n in names]
    short = F.concat(F.lit("LENGTH_MISMATCH: fewer records in "), F.array_join(F.array_compact(F.array(*(F.when(x, F.lit(n)) for x, n in zip(lacks, names, strict=True)))), ", "), F.lit(" at record "), F.col("ordinal").cast("string"))
    joined = joined.where(_unless(reduce(lambda a, b: a | b, lacks), short))
    if check is not None:
        joined = joined.where(_unless(check.isNotNull(), check))
    return joined.select(*keys[:-1], F.col("ordinal").alias("rec_index"), *names)


def mate_error(r1: str = "r1", r2: str = "r2") -> Column:
    """Why two alignments aren't mates, or null: both flagged as paired, of one name, not both first in their template."""
    a, b = F.col(r1), F.col(r2)
    return (
        F.when(~(has_flag(a.flag, PAIRED) & has_flag(b.flag, PAIRED)), "UNPAIRED_RECORD").when(a.id != b.id, "DIFFERENT_NAMES")
        .when(has_flag(a.flag, FIRST) & has_flag(b.flag, FIRST), "SAME_TEMPLATE_POSITION")
    )


def paired(r1: DataFrame, r2: DataFrame, check_names: bool = False) -> DataFrame:
    """(rec_index, r1, r2). Alignments (with a flag) must be mates; names of others are compared only if asked for."""
    check = mate_error() if "flag" in r1.columns else F.when(F.col("r1.id") != F.col("r2.id"), "DIFFERENT_NAMES") if check_names else None
    return multi([r1, r2], check)


def read_in_step(spark: SparkSession, groups: list[list[str]], grouped: bool = False, check_names: bool = False, **options) -> DataFrame:
    """Files in step, as multi and paired give of their records: read in step where that can be done, else joined. grouped: with the group's place as group_id.

    Options are those of the readers.
    """
    if check_names and options.get("columns") is not None:
        options["columns"] = list(dict.fromkeys([*options["columns"], "id"]))
    out = reader.read_zipped(spark, groups, grouped, **options)
    if out is None:
        sides = []
        for k in range(len(groups[0])):
            read = [reader.read_fastx(spark, g[k], **options).withColumn("group_id", F.lit(i).cast("long")) for i, g in enumerate(groups)]
            sides.append(reduce(DataFrame.unionByName, read))
        out = multi(sides)
        out = out if grouped else out.drop("group_id")
    if check_names:
        names = [c for c in out.columns if c[0] == "r" and c[1:].isdigit()]
        out = out.where(_unless(reduce(lambda a, b: a | b, [F.col("r1.id") != F.col(f"{n}.id") for n in names[1:]], F.lit(False)), F.concat(F.lit("DIFFERENT_NAMES at record "), F.col("rec_index").cast("string"))))
    return out


def interleaved_multi(records: DataFrame, arity: int) -> DataFrame:
    """(file, rec_index, members array<record>): records k*i … k*i+k-1 of each file are group i."""
    if arity < 1:
        raise ValueError("a group has at least one record")
    kept = [c for c in records.columns if c != "file"]
    # A group has `arity` records however large the file is, so the list is bounded.
    members = F.array_sort(F.collect_list(F.struct("rec_index", *(c for c in kept if c != "rec_index")))).alias("members")
    grouped = records.groupBy("file", F.expr(f"rec_index div {arity}").alias("ordinal")).agg(members, F.count(F.lit(1)).alias("n"))
    short = F.concat(F.lit(f"ARITY_MISMATCH: records aren't a multiple of {arity} in "), F.col("file"))
    return grouped.where(_unless(F.col("n") != arity, short)).select("file", F.col("ordinal").alias("rec_index"), "members")


def interleaved(records: DataFrame) -> DataFrame:
    """(file, rec_index, r1, r2): records 2i and 2i+1 of each file are pair i."""
    return interleaved_multi(records, 2).select("file", "rec_index", F.col("members")[0].alias("r1"), F.col("members")[1].alias("r2"))


def members(combined: DataFrame) -> DataFrame:
    """Pairs or groups with their records as one array."""
    names = [c for c in combined.columns if c[0] == "r" and c[1:].isdigit()]
    if not names:
        return combined
    return combined.select(*(c for c in combined.columns if c not in names), F.array(*names).alias("members"))
