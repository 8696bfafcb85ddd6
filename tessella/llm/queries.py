"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neardup, rules, topk
from .common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents, train

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = score_documents(docs, train(docs, labels))
    return got.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    got = encode_decode(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))
    return got.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0", k=5)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import classes

    return classes(documents(spark, sf_dir), words=4)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import apply_rules

    return apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = documents(spark, sf_dir)
    return identify(docs, train(docs))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan

    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    got = pack_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    return got.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scoring import score_documents

    return score_documents(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents, train

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, train(docs, labels))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_language": op6_language,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality": op10_quality,
}

ORACLE: dict[str, str] = {"op1_topk": topk.ORACLE, "op2_near_duplicates": neardup.ORACLE, "op3_quality_rules": rules.ORACLE}
