"""The corpus pipeline: documents in, packed token rows out.

The stages in order: the quality classifier drops documents that it rejects, near-dedup keeps the one of each group with
the smallest id, decontamination drops documents that overlap with a benchmark item, mixing repeats or leaves out
documents until each source has its share, and packing turns the rest into rows of token ids. Every stage reads what the
one before wrote, as a table in the shared folder. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import decontaminate, mixing, neardup, packing, quality
from driftlens.llm.common import Scratch, read


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose score reaches the threshold. The labels teach; they are no input of a score."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: five-word shingles, similarity 0.8; the smallest id of each group stays."""
    return neardup.deduplicate(docs, neardup.Similarity(words=5, least=80))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that overlap with no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as the mix takes it."""
    return mixing.emit(docs)


def pack_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows of token ids with segment lengths and positions."""
    return packing.pack(docs)


STAGES = [
    ("quality", accept_quality),
    ("neardup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("pack", pack_rows),
]
#: Compression scores, signatures and token merges have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = scratch.cut(docs, name)
    return docs
