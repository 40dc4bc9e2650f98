"""A corpus from documents: classified, filtered by rules, near duplicates removed, mixed, packed.

Each stage reads what its predecessor wrote.  Stages need the labels beside the documents, which
they read from the same folder.

Defined cases: null, empty and blank texts go in the first two stages; null ids are documents of
their own; of repeated rows and near copies one stays; a null language or source is one of its
own; without labels all texts pass the classifier but empty ones, and only the base rules reject;
other columns stay until packing, clashing names included; empty tables give no rows.
Stages that use Python limit the session's Arrow batches to 4 MB.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import mixing, packing, perplexity, rules, setjoin
from textloom.llm.storage import small_batches, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    small_batches(spark)
    return perplexity.kept_by_perplexity(docs, _labels(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list rejects."""
    return rules.kept_by_rules(docs, rules.learn_rules(docs, _labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest id, of each group of near copies."""
    small_batches(spark)
    return setjoin.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, max_epochs=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("source mix", source_mix),
    ("packing", packed),
]

#: Perplexities, learned rules and token ids are beyond SQL; tests/llm holds the Jaccard stage and the
#: base rules against plain versions, and the other stages against their operators and totals.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
