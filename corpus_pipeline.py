"""Documents to training tokens: quality, near-duplicates, decontamination, personal data, token ids.

Each stage is a function of (spark, docs, sf_dir) and works on whatever its predecessor kept. All but the last return
the columns of ``documents``. Between stages, rows are written as Parquet and read again, so a lost executor costs a
stage at most; a stage's table is emptied once the next one is written.

What each stage does with odd rows: a null text counts as empty, and no stage but the first, which judges the text, drops
a row without words. Rows without an id are judged by their text and otherwise stay. Rows that repeat an id are judged
by the text of each; of rows that repeat id and text, near_dedup keeps one. Extra columns pass through, whatever their
names. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sardabir.llm import bpe, decontaminate, neardup, pii, quality
from sardabir.llm.common import shared_dir, table
from sardabir.llm.labelled import fold
from sardabir.llm.queries import PII_KEY

#: Least similarity of near-duplicates in this pipeline, in percent of five-word shingles; op6 alone takes 85.
NEAR_PERCENT = 80


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.drop_copies(docs, NEAR_PERCENT)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.replace_pii(docs, PII_KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good), ("near_dedup", distinct), ("decontamination", uncontaminated), ("pii", pseudonymous), ("bpe", tokens)]

#: SQL cannot express a trained model, surrogates or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over ``documents``."""
    place, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        written = f"{place}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        if before:
            spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(before)
        docs, before = spark.read.parquet(written), written
    return docs
