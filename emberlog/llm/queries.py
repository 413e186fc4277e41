"""The subpackage's registered queries: thin calls of the operators on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import (
    archives,
    backoff_lm,
    byte_bpe,
    cotraining,
    cross_tokenizer,
    decontaminate,
    hard_negatives,
    html_text,
    licences,
    quality_rules,
    simhash,
    source_mix,
    suffix_dedup,
)
from emberlog.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(ship(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_backoff_lm")
def op1_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_lm.score_documents(table(spark, folder, "documents"))


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contaminated(docs, items)


@query("op3_licence_scan")
def op3_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(table(spark, folder, "documents"))


@query("op4_quality_cotraining")
def op4_quality_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return cotraining.score_documents(docs, labels)


@query(
    "op5_warc",
    """
    with p as (
      select page_id, coalesce(encode(html), ''::blob) as payload from pages
    ), d as (
      select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest
      from p
    ), f as (
      select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1
    )
    select page_id, payload_bytes, payload_digest,
           case when first is null or first = page_id then 'response' else 'revisit' end
             as record_type,
           case when first <> page_id then first end as refers_to
    from d left join f using (payload_digest)
    """,
)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archive_pages(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality_rules.quality_verdicts(docs, labels).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.col("stratum").alias("lang"),
        *quality_rules.RULES,
    )


@query("op7_simhash")
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.repeated_bytes(table(spark, folder, "documents"))
    return found.drop("starts", "ends")


def bpe_of(spark: SparkSession) -> byte_bpe.ByteBpe:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.ByteBpe(spark, path, public_tokenizers.PATTERN)


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, folder, "documents"), bpe_of(spark))


@query("op10_html_text")
def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query("op11_cross_tokenizer")
def op11_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    a, b = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    pair = cross_tokenizer.Pair(spark, a, b)
    return cross_tokenizer.align_documents(table(spark, folder, "documents"), pair)


@query("op12_source_mix")
def op12_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.mix_documents(table(spark, folder, "documents"))


@query("op13_hard_negatives")
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))
