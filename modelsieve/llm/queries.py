"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.llm import (
    conversation_repair,
    decontaminate,
    exact_dedup,
    language_id,
    license_scan,
    line_dedup,
    merkle_manifest,
    order_minhash,
    packing,
    secret_scan,
    token_count,
    url_filter,
    warc_fixity,
)
from modelsieve.llm.rules import LISTED_SITES, URL_RULES

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licences(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_groups(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with known damage."""
    records = warc_fixity.page_records(table(spark, sf_dir, "pages"))
    return warc_fixity.audit(records, warc_fixity.damaged_replica(records))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_count.token_counts(table(spark, sf_dir, "documents"), path)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed_documents(table(spark, sf_dir, "documents"), path)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with known damage, and what repairs them."""
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversations, conversation_repair.damaged(conversations))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; listed are the URLs of all pages on junk sites."""
    pages = table(spark, sf_dir, "pages")
    junk = url_filter.host_of(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_SITES)})\.")
    listed = [F.struct(*(F.lit(v).alias(c) for c, v in zip(("host", "path", "action"), rule))) for rule in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*listed)))
    return url_filter.verdicts(pages, rules, pages.where(junk))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_warc_fixity": op6_warc_fixity,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_decontaminate": op9_decontaminate,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_url_filter": op12_url_filter,
    "op13_merkle_manifest": op13_merkle_manifest,
}
