"""Corpus pipeline: stages from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crawlscope.llm.common import Scratch
from crawlscope.llm.exact_dedup import drop_copies
from crawlscope.llm.langid import drop_unidentified
from crawlscope.llm.minhash import drop_near_duplicates
from crawlscope.llm.mixing import sample_to_targets
from crawlscope.llm.packing import pack_texts


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; the others go."""
    return drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics are expected at their targets."""
    return sample_to_targets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences with their pieces' ids."""
    return pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), memo=150_000)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: Three of the stages can't be put as SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's rows go when the next one's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        out = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = out
    return docs
