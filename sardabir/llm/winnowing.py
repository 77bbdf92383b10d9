"""Operator 9: document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TIES, range_of, range_splits, slices

#: Code points of a gram, grams of a window: any passage of GRAM + WINDOW - 1 = 39 code points that two texts share
#: gives both a print of the same hash.
GRAM, WINDOW = 16, 24
#: Long texts are worked through in blocks of so many code points, which overlap by GRAM + WINDOW - 2.
BLOCK = 1 << 18
#: Documents of one range of ids, and code points of the texts that are turned into rows at once.
RANGE_ROWS, SLICE = 2000, 250_000
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit rolling hashes of all grams: polynomials over 64-bit words, doubled in length while that fits, then mixed."""
    with np.errstate(over="ignore"):
        hashes, length, power = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, np.uint64(_BASE)
        hashes ^= hashes >> np.uint64(32)
        single, single_power = hashes, power
        while length < gram:
            if 2 * length <= gram:
                hashes = hashes[:-length] * power + hashes[length:]
                power, length = power * power, 2 * length
            else:
                hashes = hashes[:-1] * single_power + single[length:]
                power, length = power * single_power, length + 1
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes >> np.uint64(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the prints: of each window's grams the least hash, the rightmost of equals.

    A text shorter than a gram is one gram; one with fewer grams than a window is one window; an empty one has none.
    """
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    gram = min(gram, len(codes))
    window = min(window, len(codes) - gram + 1)
    found: list[np.ndarray] = []
    hashes_of: list[np.ndarray] = []
    step = BLOCK - gram - window + 2
    for start in range(0, len(codes) - gram - window + 2, step):
        hashes = gram_hashes(codes[start:start + BLOCK], gram)
        # the least key is the least hash, and of equal ones the last
        keys = (hashes << np.uint64(32)) | np.arange(len(hashes), 0, -1, dtype=np.uint64)
        least, width = keys, 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(keys) - window + 1], least[window - width:])
        least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        at = len(hashes) - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        found.append(at + start)
        hashes_of.append((least >> np.uint64(32)).astype(np.uint32))
    if len(found) == 1:
        return hashes_of[0], found[0]
    at, first = np.unique(np.concatenate(found), return_index=True)
    return np.concatenate(hashes_of)[first], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``id_col``, hashes and positions (arrays of long) of every row's prints, in order of position.

    Null or empty text: none. Null id: stays null. Equal texts: equal prints. Texts of any length are read whole. Empty table:
    no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [winnow(text or "", gram, window) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int64()))], names=[id_col, "hashes", "positions"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(run, f"{id_col} long, hashes array<long>, positions array<long>")


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as many first code points of ``following``, or all."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The next document is that of the next id, after the last the first. Rows are dealt into ranges of ids and sorted
    there (the one shuffle of texts); each range also gets a copy of the row that follows its last, found from the
    least id of every range, so ranges are independent tasks.

    A fingerprint is written as the hex digits of its distinct hashes in order, eight for each. Likeness: Jaccard of
    distinct hashes. Null text: empty. Null ids come last; equal ids follow the texts' checksums, then the texts. An id
    that fills whole ranges, or none at all, is dealt further by checksums. A single row follows itself. Empty table: no
    rows. Texts of any length are read whole.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    splits, hot = range_splits(rows, "id", RANGE_ROWS)
    n = len(splits) + 1
    parts = min(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @F.pandas_udf("int")
    def stretch(key: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(range_of(key.to_numpy(), tie.to_numpy(), splits, hot).astype(np.int32))

    late = F.col("id").isNull()
    tied = rows.withColumn("tie", F.crc32(F.col("text").cast("binary")))
    at = F.when(late, (F.lit(n * TIES) + F.shiftright("tie", 28)).cast("int")).otherwise(stretch(F.coalesce("id", F.lit(0)), F.col("tie")))
    placed = tied.withColumn("stretch", at)
    # one row for each range, by the bound of range_splits 16,384 and at most TIES parts of half as many
    heads = {r["stretch"]: r["head"] for r in tied.withColumn("stretch", at).groupBy("stretch").agg(F.min(F.struct(F.coalesce("id", F.lit(0)).alias("id"), "tie")).alias("head")).collect()}
    order = sorted(heads)
    before = {k: order[i - 1] for i, k in enumerate(order)}
    spark = docs.sparkSession
    links = spark.createDataFrame([(heads[k]["id"], heads[k]["tie"], k, before[k]) for k in order], "head_id long, head_tie long, at int, before int")
    # the copies: of each range's first row, for the range before; sorted behind all of that
    starts = (placed["stretch"] == links["at"]) & (F.coalesce(placed["id"], F.lit(0)) == links["head_id"]) & (placed["tie"] == links["head_tie"])
    first = placed.join(F.broadcast(links), starts).groupBy("before").agg(F.min("text").alias("text"))
    ghosts = first.select(F.lit(None).cast("bigint").alias("id"), "text", F.lit(0).cast("bigint").alias("tie"), F.col("before").alias("stretch"), F.lit(True).alias("ghost"))
    dealt = placed.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition(parts, "stretch").sortWithinPartitions("stretch", "ghost", F.col("id").isNull(), "id", "tie", "text")

    def hexed(hashes: np.ndarray) -> str:
        return hashes.astype(">u4").tobytes().hex()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for batch in batches:
            ids, ghosts = batch.column("id").to_pylist(), batch.column("ghost").to_pylist()
            texts = batch.column("text").to_pylist()
            for first, last in slices(texts, SLICE):
                out: list[tuple] = []
                for key, text, is_ghost in zip(ids[first:last], texts[first:last], ghosts[first:last]):
                    prints = np.unique(winnow(text)[0])
                    if held is not None:
                        changed = edited(held[1], text)
                        own, others = held[2], np.unique(winnow(changed)[0])
                        out.append((held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), hexed(own), hexed(others), likeness(own, others), likeness(own, prints)))
                    held = None if is_ghost else (key, text, prints)
                columns = list(zip(*out)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
