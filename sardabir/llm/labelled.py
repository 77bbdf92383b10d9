"""Labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Longer texts (in UTF-8 bytes) are not trained on, so that the sample's size is bounded, not only its rows.
MOST_BYTES = 1_000_000


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``per_class`` documents of each label, of at most MOST_BYTES bytes each: the document's columns and ``__label`` (0 or 1).

    The sample is bounded, so it is broadcast to the scan of the documents. It is drawn by a hash of the id and hence
    the same on every run. Null ids and labels are left out.
    """
    drawn = None
    for value in (0, 1):
        one = labels.where(usable & (F.col(label) == value) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("__id"), F.lit(value).alias("__label")).distinct()
        one = one.orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        drawn = one if drawn is None else drawn.unionByName(one)
    short = docs.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= MOST_BYTES)
    return short.join(F.broadcast(drawn), short[id_col].cast("bigint") == drawn["__id"]).drop("__id")
