"""A corpus from raw documents to training sequences, as stages over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulselake.llm import langid, minhash_dedup, mixing, packing
from pulselake.llm.work import discard, staged

#: Near copies share so many hundredths of their word shingles.
NEAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: those without text or a letter, and those below
    the least score.  Repeated rows fare alike; without labelled documents all go; an empty table
    stays empty."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id.  Rows without
    a doc_id, text or word stay; rows of one doc_id fare alike; an empty table stays empty."""
    return minhash_dedup.distinct_documents(docs, NEAR)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in target weights; a document of a repeated source comes more than once.  A null
    source is a source; a null text has size 0 and never comes; the last document of a budget comes
    if half of it or more does; rows of one doc_id come alike; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences.  A null or empty text is the end id alone; repeated rows
    are packed each; an empty table needs no sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL expresses neither the network nor the join; tests hold the near copies, the ids and the
#: sequences against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if kept is not None:  # what the stage has read is not needed any more
            discard(kept)
        kept = docs
    return docs
