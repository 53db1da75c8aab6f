"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before it kept. It takes (spark, docs, sf_dir) and
gives a DataFrame, which is written as Parquet and read again as the next stage's docs; all
but the last give the columns of `documents`. `n_chars` follows the text where a stage
changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import neardup, packing, quality, secrets, suffixes
from sieveline.llm.common import drop_stored, own_columns, stored, table
from sieveline.llm.queries import tokenizer

NEAR = 80  # op7's contract has 85 for itself


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)).select(own_columns(like))


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of a similarity of NEAR percent and
    more, stays, the one with the least id; of rows that repeat, one."""
    return neardup.deduplicated(docs, NEAR, repeats=False)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 and more that are met again anywhere are cut out."""
    return _counted(suffixes.without_repeats(docs), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret gives way to a mark."""
    return _counted(secrets.redact(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", accept_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs, last = stored(stage(spark, docs, sf_dir), name.replace(" ", "-")), before
        if last is not None:
            drop_stored(last)
        before = docs
    return docs
