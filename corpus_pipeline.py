"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import discard, materialize, table
from seqloom.llm.decontaminate import decontaminate
from seqloom.llm.linededup import dedup_lines
from seqloom.llm.queries import _vocabulary
from seqloom.llm.sentencepiece_codec import encode_documents
from seqloom.llm.simhash_neardup import near_dedup
from seqloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; every document stays, if only as an empty text."""
    counted = next(name for i in range(len(docs.columns) + 1) if (name := f"removed{i}") not in docs.columns)
    out = dedup_lines(docs, counted)
    n_chars = F.when(F.col(counted) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item leaked into go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what is left, and the hash of what they decode to."""
    return encode_documents(docs, _vocabulary("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: SQL expresses neither the learned scores nor fingerprints, tiles and pieces; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*done)  # nothing reads the stage's input again
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
