"""The queries of this package's operators, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html_text, neardup, pii, quality, sharding, toxicity, winnowing
from .common import table
from .labelled import fold


#: The key of the surrogates in these queries. In production it is a secret of whoever runs them.
PII_KEY = b"queries over synthetic tables"


def quality_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold("doc_id", 3) != 1)
    return quality.score(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8)


def chat_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from the formatted strings and masks."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{probe}'), (-1L, 1L, 'assistant', '{probe}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    told = chat.format_conversations(turns).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.masked_text(F.col("parts")).alias("loss"))
    return told.select(
        "conv_id",
        F.size("back").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pages_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pseudonymized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.describe_pii(table(spark, sf_dir, "documents"), PII_KEY)


def winnowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_neighbours(table(spark, sf_dir, "documents"))


def toxicity_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    return toxicity.score(docs, network).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_quality_fm": quality_scored,
    "op2_jump_sharding": sharded,
    "op3_chat_format": chat_formatted,
    "op4_decontamination": contaminated,
    "op5_html_main_text": pages_main_text,
    "op6_minhash_neardup": near_duplicates,
    "op7_byte_bpe": bpe_digests,
    "op8_pii_surrogates": pseudonymized,
    "op9_winnowing": winnowed,
    "op10_toxicity_gru": toxicity_scored,
}
