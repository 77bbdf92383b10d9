"""Helpers that several operators of this package share."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch are handed to Python functions in slices of at most so many code points (or one row).
SLICE_CHARS = 250_000
#: Bytes of strings that a Python function is given at once, or one row.
SLICE_BYTES = 4_000_000
#: Rows of two numbers that may be broadcast (some 60 bytes each in a hash table); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set in ``sf_dir``, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``df`` mapped batch by batch: ``fn`` turns a record batch into columns (name to list or array).

    Batches are cut to SLICE_BYTES, so what a worker holds follows from that and the longest text. No shuffle and no
    state between batches, so a lost task is simply run again.
    """
    names = [part.split()[0] for part in schema.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<long>": pa.list_(pa.int64())}
    types = [kinds[part.split()[1]] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            got = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(got[n], type=t) for n, t in zip(names, types)], names=names)

    return df.mapInArrow(run, schema)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of at most SLICE_BYTES of strings and binaries each, or of one row; empty ones are left out."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if column.type in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, ends = 0, np.cumsum(sizes)
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``most`` code points together, or one row."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where none is named, as in tests on one machine, a folder in the warehouse; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return named or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")


def settled(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint of ``df`` and its number of rows.

    A plain checkpoint keeps the optimizer's guess of its size, which for joins is the product of both sides; in loops of
    joins its digits double round by round. Taken from a kept table, which is measured, it is right.
    """
    kept = df.persist()
    try:
        rows = kept.count()
        return kept.select("*").checkpoint(), rows
    finally:
        kept.unpersist()


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has so many rows, to be broadcast if these are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


#: Rows of an id that fills whole ranges are dealt further, by the leading bits of a hash of theirs, into so many parts.
TIES = 16


def range_splits(df: DataFrame, col: str, rows_per_range: int = 20_000, most: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """Split points of a bigint column by approximate quantiles, so that ranges hold about equally many rows; and hot values.

    A value that several quantiles fall on is hot, and has a range of its own.
    """
    total = df.count()
    n = int(min(most, max(1, total // rows_per_range)))
    if n < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    points = df.select(F.percentile_approx(col, [i / n for i in range(1, n)], 10 * n).alias("p")).first()["p"] or []
    hot = {a for a, b in zip(points, points[1:]) if a == b}
    return np.array(sorted({*points, *(x + 1 for x in hot if x < (1 << 63) - 1)}), dtype=np.int64), np.array(sorted(hot), dtype=np.int64)


def range_of(keys: np.ndarray, ties: np.ndarray, splits: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The range of each key, in order of (key, tie); ``ties`` are unsigned 32-bit hashes, which tell only where a key is hot."""
    return np.searchsorted(splits, keys, side="right") * TIES + np.where(np.isin(keys, hot), ties >> 28, 0)
