"""Persian test text from the synthetic documents, the same in Spark and in DuckDB.

The documents hold no Arabic script, so frequent words and all letters of theirs are replaced: a book is a source, a
file a document, and a block a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

REPLACED = [
    (" for ", ' "abc" '), (" the ", " می "), (" of ", " از از "), (" to ", " ها "), (" in ", " تر "),
    (" on ", " ؟"), (" be ", " ؛ "), (" with ", " ; "), (" or ", "? "), (". ", "."),
]
_PAIRS = {
    "a": "ا", "b": "ب", "c": "چ", "d": "د", "e": "ه", "f": "ف", "g": "گ", "h": "ح", "i": "ی", "j": "ژ", "k": "ک", "l": "ل", "m": "م",
    "n": "ن", "o": "و", "p": "پ", "q": "ق", "r": "ر", "s": "س", "t": "ت", "u": "و", "v": "ش", "w": "و", "x": "خ", "y": "ي", "z": "ز",
    "é": "‌", "ó": "‌", "è": "ي", "ñ": "ك", "ç": "ـ", "ü": "َ", "ê": "ﻻ", "ä": "ە", "ö": "ة", "ß": "٣", "í": "‌",
}


def persian(text: Column, key: Column) -> Column:
    out = F.lower(text)
    for old, new in REPLACED:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.translate(out, "".join(_PAIRS), "".join(_PAIRS.values()))
    return F.when(key % 2 == 0, F.concat(F.lit("﻿"), out)).otherwise(out)


def spread(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` over all cores where their file comes in fewer pieces than that, as a file of one row group does."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, by) if rows.rdd.getNumPartitions() < cores else rows


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (book, file, file_pos, lower-cased text) as lines in Persian letters: the same columns, i and t."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[[ord(c) for c in _PAIRS]] = [ord(c) for c in _PAIRS.values()]
    for batch in batches:
        of, places, lines = [], [], []
        for row, key in enumerate(batch.column(2).to_pylist()):
            if (text := batch.column(3)[row].as_py()) is None:
                continue
            for old, new in REPLACED:
                text = text.replace(old, new)
            text = table[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tobytes().decode("utf-32-le")
            if key is not None and key % 2 == 0:
                text = "\ufeff" + text
            for i, line in enumerate(text.split("\n")):
                # what split() takes for white space is C.WHITE
                if t := " ".join(line.split()):
                    of.append(row)
                    places.append(i)
                    lines.append(t)
                    if len(lines) == LINES:
                        yield _told(batch, of, places, lines)
                        of, places, lines = [], [], []
        yield _told(batch, of, places, lines)


#: Lines that are handed on at once.
LINES = 10_000


def _told(batch: pa.RecordBatch, of: list[int], places: list[int], lines: list[str]) -> pa.RecordBatch:
    kept = batch.select(range(3)).take(pa.array(of, pa.int64())).columns
    return pa.RecordBatch.from_arrays([*kept, pa.array(places, pa.int32()), pa.array(lines, pa.string())], names=["book", "file", "file_pos", "i", "t"])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, file, file_pos, i, t: lines with white space collapsed, empty ones left out but counted.

    The same as ``persian``, line by line, but a text's letters are looked up all at once.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), "doc_id")
    told = docs.select(F.col("source").alias("book"), F.col("doc_id").cast("string").alias("file"), F.col("doc_id").alias("file_pos"), F.lower("text").alias("text"))
    return told.mapInArrow(_lines, StructType([*told.schema.fields[:3], StructField("i", IntegerType()), StructField("t", StringType())]))


def _sql_text() -> str:
    out = "lower(text)"
    for old, new in REPLACED:
        out = f"replace({out}, '{old}', '{new}')"
    return f"translate({out}, '{''.join(_PAIRS)}', '{''.join(_PAIRS.values())}')"


def blocks_sql() -> str:
    """The same as common table expressions: ``blocks`` with book, file, file_pos, i, t."""
    from ..functions import chars as C

    return f"""told AS (
            SELECT source AS book, doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(65279) || x ELSE x END AS x
            FROM (SELECT source, doc_id, {_sql_text()} AS x FROM documents)),
        lines AS (SELECT book, doc_id, string_split(x, chr(10)) AS ls FROM told),
        placed AS (SELECT book, doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM lines),
        blocks AS MATERIALIZED (
            SELECT book, CAST(doc_id AS VARCHAR) AS file, doc_id AS file_pos, CAST(i AS INTEGER) AS i, t
            FROM (SELECT *, trim(regexp_replace(line, '{C.WHITE_RUN}', ' ', 'g')) AS t FROM placed) WHERE t <> '')"""
