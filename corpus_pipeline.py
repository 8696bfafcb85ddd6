"""A corpus made ready for training: quality, rules, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import neardup, packing, pii, quality, rules
from tessella.llm.common import cut, documents


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts; it learns from the table ``labels``."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_documents(docs, model)


def keep_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the table of quality rules."""
    return rules.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id: five words, 0.8."""
    return neardup.filter_documents(docs, words=5, threshold=(80, 100))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found personal data replaced and ``n_chars`` counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048."""
    import public_tokenizers

    got = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("quality_rules", keep_rules),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: SQL can't express the classifier's training and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is cut off from its history for the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
