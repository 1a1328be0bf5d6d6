"""Corpus pipeline: toxicity, exact dedup, near dedup, mixing, BPE; each stage reads what the last one wrote.

* Null texts count as empty everywhere: never toxic, equal to each other and to empty texts, of no words
  and so not taken by the mix. Texts are read whole, whatever their length.
* Of repeated rows one is left by the exact stage; documents the mix takes several times are repeated rows.
* Null ids are smaller than any other; a null source is a source of its own.
* All columns of documents, extra ones too, are kept until the last stage, whatever their names.
* An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import bpe, exact_dedup, mixing, simhash, toxicity
from larder.llm.common import table
from larder.session import materialise, ship_package


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    ship_package(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship_package(spark)
    return exact_dedup.keep_one(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    ship_package(spark)
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship_package(spark)
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document of the mix, with digests of tokens and decoded text."""
    ship_package(spark)
    return bpe.digests(docs)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("simhash_near_dedup", dissimilar),
    ("mixing", mixed),
    ("bpe", encoded),
]

# Neither the fitted model nor BPE can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
