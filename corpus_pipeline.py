"""Corpus cleaning in stages; each stage's documents are written and reread by the next.

All stages take empty tables, nulls in any column, very long texts and extra columns of any
name, and keep the columns of documents; what a null, a tie or a repeated row gives is said
at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import byte_bpe, decontaminate, quality_rules, simhash, suffix_dedup
from emberlog.llm.queries import bpe_of
from emberlog.llm.ship import ship
from emberlog.llm.store import stored

#: SQL cannot express the stages: exact binomial tests, XXH64 fingerprints, suffix arrays,
#: edit-distance search and byte-pair merges. tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have too few words and go;
    equal rows share their verdict."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id. Null and empty
    texts are copies of each other, equal rows become one, rows without an id all stay."""
    ship(spark)
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that stand anywhere else; every copy of
    one is cut, so equal texts of over 50 words lose all of these. Null texts stay null."""
    ship(spark)
    return suffix_dedup.without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or edited. Null and empty texts stay, and
    equal rows share their fate."""
    items = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_contaminated(docs, items)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, with digests of the ids and of the bytes decoded from them. Null
    and empty texts have none; each row is encoded by itself."""
    return byte_bpe.tokenized(docs, bpe_of(ship(spark)))


STAGES = [
    ("quality_rules", quality),
    ("simhash", near_duplicates),
    ("suffix_dedup", repeats),
    ("decontaminate", benchmark),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents: one row per document that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
