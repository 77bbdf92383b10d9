"""Operator 2: shards by jump consistent hashing.

A key's shard depends on the key and the number of shards only; there is no ring or table to keep. When a shard is
appended, a key either stays or moves into the new shard, which takes 1/(n+1) of all keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import TIES, range_of, range_splits

MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys into ``shards`` buckets (Lamping and Veach, 2014), all keys at once."""
    state = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    ahead = np.zeros(len(state), dtype=np.int64)
    while len(live):
        bucket[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((bucket[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket.astype(np.int32)


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, gapless slot and size of every row.

    Returns ``id_col``, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and grown_shard (with one more shard).

    Slots of a shard follow the ids, and the texts' checksums among equal ones. They are counted in two steps: rows are
    dealt into ranges of ids, the counts of (range, shard) are summed up to offsets, and only a range is numbered by a
    window. An id that fills whole ranges, or none at all, is dealt further by checksums. So no task sees a whole shard.

    Null text: as an empty one. Null id: hashed as key 0, numbered before the others. Repeated rows: the same shard,
    slots of their own. Empty table: no rows. Other columns of the input are not read and so cannot clash.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    splits, hot = range_splits(rows, "id")

    @F.pandas_udf(StructType([StructField("shard", IntegerType()), StructField("grown_shard", IntegerType()), StructField("stretch", IntegerType())]))
    def place(key: pd.Series, tie: pd.Series) -> pd.DataFrame:
        ids = key.to_numpy()
        return pd.DataFrame({"shard": jump_hash(ids, shards), "grown_shard": jump_hash(ids, shards + 1), "stretch": range_of(ids, tie.to_numpy(), splits, hot).astype(np.int32)})

    without = (F.shiftright("text_crc32", 28) - TIES).cast("int")
    placed = rows.withColumn("at", place(F.coalesce("id", F.lit(0)), "text_crc32")).select(
        "id", "size", "text_crc32", "at.shard", "at.grown_shard", F.when(F.col("id").isNull(), without).otherwise(F.col("at.stretch")).alias("stretch"))
    # by the bound of range_splits, at most shards * (16,384 ranges + TIES parts of half as many): this may be broadcast and numbered by a window
    counts = placed.groupBy("shard", "stretch").count()
    offsets = counts.select("shard", "stretch", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "stretch").orderBy("id", "text_crc32", "size")
    return placed.withColumn("nth", F.row_number().over(order)).join(F.broadcast(offsets), ["shard", "stretch"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("nth") - 1).cast("bigint").alias("slot"), "grown_shard")
