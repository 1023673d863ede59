"""Raw documents to packed training sequences: five stages, each one operator of ``tillwright.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents. Rows with null ids or texts, repeated rows and further
columns pass through the filters like any other; each operator's docstring says how it treats them. Without documents
the result is empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillwright.llm import decontaminate, language, packing, quality, simhash_trie
from tillwright.llm.common import stage_compressed, table

VOCABULARY = "byte_bpe_50k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents graded toxic or poor by the ordinal classifier."""
    return quality.select_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose language stays ambiguous."""
    return language.keep_known(docs, language.train(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return simhash_trie.keep_one_per_group(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the rest into sequences of 2048 tokens; one row per piece."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality classifier", keep_good),
    ("language identification", keep_known_languages),
    ("near-duplicate removal", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

# The classifiers and the tokenizer can't be said in SQL; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_compressed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
