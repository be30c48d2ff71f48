"""One query per text operator over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, contamination, conversation_repair, license_scan, line_dedup, mixing, ngram_join, oracle_sql, personal_data, quality_classifier, quality_rules, substring_dedup, toxicity, whitening
from ledgerloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(configure(spark), _table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(configure(spark), _table(spark, sf_dir, "documents"),
                                       _table(spark, sf_dir, "benchmark")).drop("copy")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(configure(spark), _table(spark, sf_dir, "documents")).drop("copy")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(configure(spark), _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(configure(spark), _table(spark, sf_dir, "documents"))
    return cleaned.select("doc.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(configure(spark), _table(spark, sf_dir, "documents")).drop("removed")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.group(configure(spark), _table(spark, sf_dir, "documents")).drop("links_found", "copy", "root")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(configure(spark), _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(configure(spark), _table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(configure(spark), sf_dir, "documents")).drop("notices")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(configure(spark), _table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(_table(configure(spark), sf_dir, "conversations"))
    return conversation_repair.repair(damaged, present=F.col("present")).select(
        "conv_id", *conversation_repair.COUNTS, "audit", F.sha2(conversation_repair.as_text("turns"), 256).alias("repaired_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(configure(spark), _table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(spark, encoded, ranks).select(
        "doc_id", byte_bpe.count_tokens("tokens").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_mix_to_weights": op1_mix_to_weights,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_personal_data": op8_personal_data,
    "op10_license_scan": op10_license_scan,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE: dict[str, str] = oracle_sql.ORACLE
