"""Word lists, registers and listings of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def words_of_lines(lines: DataFrame, *, compose: bool = True) -> DataFrame:
    """Distinct ``word`` of a list given as (line_no from 0, line).

    Blank lines and those that begin with ``#`` are no words, nor is a first line that is a number (a dictionary's
    count). An entry ends at a slash (its flags) or a tab.
    """
    told = lines.select("line_no", F.trim("line").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    entries = told.where(~((F.col("line_no") == 0) & F.col("line").rlike("^[0-9]+$")))
    entry = F.trim(F.substring_index(F.substring_index("line", "/", 1), "\t", 1))
    return entries.select(T.norm_word(entry, compose=compose).alias("word")).where("word <> ''").distinct()


def load_wordlist(spark: SparkSession, *paths: str) -> DataFrame:
    """The distinct normalised words of plain lists and ``.dic`` files."""
    files = spark.read.text(list(paths), wholetext=True)
    lines = files.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return words_of_lines(lines)


def registers_of_rows(rows: DataFrame) -> DataFrame:
    """file and register, given (line, file, book, register): keyed by file, or book where that is empty; later rows win."""
    key = F.trim(F.when(F.coalesce("file", F.lit("")) != "", F.col("file")).otherwise(F.coalesce("book", F.lit(""))))
    keyed = rows.select("line", key.alias("file"), F.trim(F.coalesce("register", F.lit(""))).alias("register")).where("file <> ''")
    return keyed.groupBy("file").agg(F.max_by("register", "line").alias("register"))


def load_registers(spark: SparkSession, path: str) -> DataFrame:
    """A small CSV with a header; it may begin with a byte-order mark."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^\\x{FEFF}", ""), "\r?\n")).alias("line", "row"))
    header = raw.where("line = 0").first()["row"].split(",")
    fields = F.from_csv("row", F.lit(", ".join(f"`{h.strip()}` string" for h in header)))
    rows = raw.where("line > 0 AND row <> ''").select("line", fields.alias("r")).select("line", "r.*")
    for name in ("file", "book", "register"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return registers_of_rows(rows)


def book_id(rel: Column) -> Column:
    return F.substring(F.sha1(rel.cast("binary")), 1, 12)


def stem(rel: Column) -> Column:
    """A file's name without its last extension."""
    return F.regexp_replace(F.substring_index(rel, "/", -1), r"(?<=.)\.[^.]*$", "")


def title_or_stem(title: Column, rel: Column) -> Column:
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.trim(title)).otherwise(stem(rel))


def plan_scan(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """rel, size, mtime, and whether the file is unchanged since the previous scan and was readable then (``cached``)."""
    before = previous.select("rel", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), F.col("error").alias("__error"))
    same = F.coalesce((F.col("size") == F.col("__size")) & (F.col("mtime") == F.col("__mtime")) & F.col("__error").isNull(), F.lit(False))
    return listing.join(before, "rel", "left").select("rel", "size", "mtime", same.alias("cached"))


def select_books(books: DataFrame, only: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Readable books; of these, those that ``only`` names by id, path or file name; of these, the first by path."""
    out = books.where(F.col("error").isNull())
    if only:
        out = out.where(F.col("id").isin(only) | F.col("rel").isin(only) | F.substring_index("rel", "/", -1).isin(only))
    return out.orderBy("rel").limit(limit) if limit else out
