"""A pipeline over ``documents``. Each stage is one of the operators in modelsieve.llm.

Every stage takes the whole table that its predecessor kept and returns the columns of documents; the
last one returns packed pieces. Stages are written as Parquet in the folder of
``spark.checkpoint.dir`` and read again, so a lost executor costs part of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from modelsieve.llm import decontaminate, language_id, line_dedup, order_minhash, packing
from modelsieve.llm.common import written
from modelsieve.llm.queries import table

#: Documents whose best language has a lower score are rejected. Chance for four languages is 0.25.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; texts without letters and unclear ones go."""
    return language_id.accepted(docs, language_id.fit(docs), LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeats of lines that occur on many sites."""
    return line_dedup.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return order_minhash.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in training sequences."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", sequences),
]

#: SQL cannot express the stages; tests compare each with a plain evaluation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
