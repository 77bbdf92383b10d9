"""Findings of all sources in one table: union, deduplication, filters, order, counts and density.

An issue row has book, source, f (file), i (block), off, len, orig, sugg, rule, severity, category and conf. ``seq`` is
its place within its source's output, which decides which of two equal spans came first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Sources in order of precedence, and the categories of the reports.
SOURCES = ("rules", "spelling", "grammar")
CATEGORIES = ("grammar", "spelling", "typography", "style")
SAFE_EXAMPLES, SHOWN_EXAMPLES = 15, 8


def source_rank(source: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SOURCES]), source)


def union_sources(*sources: DataFrame) -> DataFrame:
    """One table; a column that a source lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def dedup(issues: DataFrame) -> DataFrame:
    """One row for a span that several sources found, with ``source`` naming them in order, joined by ``+``.

    Within a span (book, f, i, off, len), in order of source and seq: a safe row always stays, and whatever follows it
    is added to it; another row stays only if it is the span's first. So rows group by how many safe rows have come
    before: the group's first row stays and takes the names of the others.
    """
    span = ["book", "f", "i", "off", "len"]
    order = [source_rank(F.col("source")), F.col("seq")]
    so_far = Window.partitionBy(*span).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = issues.withColumn("__run", F.count_if(F.col("severity") == "safe").over(so_far))
    run = Window.partitionBy(*span, "__run").orderBy(*order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return grouped.withColumn("__names", F.array_join(F.collect_list("source").over(whole), "+")).withColumn("__nth", F.row_number().over(run)).where("__nth = 1").withColumn(
        "source", F.col("__names")).drop("__run", "__names", "__nth")


def at_least(issues: DataFrame, min_conf: float) -> DataFrame:
    """Issues of at least this confidence; one without counts as sure. To be applied after ``dedup``."""
    return issues.where(F.coalesce("conf", F.lit(1.0)) >= min_conf)


def for_review(issues: DataFrame) -> DataFrame:
    return issues.where("severity <> 'safe'")


def safe_counts(hits: DataFrame) -> DataFrame:
    """book, rule, n of the safe hits, all of them."""
    return hits.where("severity = 'safe'").groupBy("book", "rule").agg(F.count("*").alias("n"))


def safe_examples(hits: DataFrame, most: int = SAFE_EXAMPLES) -> DataFrame:
    """The first ``most`` safe hits of each book and rule, in order of file_pos, i and off."""
    order = Window.partitionBy("book", "rule").orderBy("file_pos", "i", "off")
    return hits.where("severity = 'safe'").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def category_counts(review: DataFrame) -> DataFrame:
    """book and the number of issues of each category."""
    return review.groupBy("book").agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])


def book_density(books: DataFrame, counts: DataFrame) -> DataFrame:
    """Every book with its counts and its issues for each thousand words; style doesn't count, and a book without words counts as one word."""
    told = books.select("book", "words").join(counts, "book", "left").na.fill(0, list(CATEGORIES))
    return told.withColumn("density", (F.col("grammar") + F.col("spelling") + F.col("typography")) / F.when(F.col("words") == 0, 1).otherwise(F.col("words")) * 1000)


def top_books(density: DataFrame, n: int | None = None) -> DataFrame:
    ordered = density.orderBy(F.desc("density"), "book")
    return ordered if n is None else ordered.limit(n)


def totals(density: DataFrame, safe: DataFrame) -> DataFrame:
    """One row: books, words, safe fixes and issues of each category."""
    per_book = safe.groupBy("book").agg(F.sum("n").alias("safe"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return density.join(per_book, "book", "left").agg(F.count("*").alias("books"), zero("words"), zero("safe"), *[zero(c) for c in CATEGORIES])


def with_context(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """Issues with the text around them; of a block that is missing, empty text."""
    texts = blocks.select("book", F.col("file").alias("f"), "i", F.col("t").alias("__t"))
    return issues.join(texts, ["book", "f", "i"], "left").withColumn("context", T.plain_context(F.coalesce("__t", F.lit("")), F.col("off"), F.col("len"))).drop("__t")


def review_order(issues: DataFrame, spines: DataFrame) -> DataFrame:
    """Issues numbered within their book (``nth``): by the file's place in the spine, unknown files last, then i and off."""
    places = spines.select("book", F.posexplode("spine").alias("__place", "f")).groupBy("book", "f").agg(F.min("__place").alias("__place"))
    order = Window.partitionBy("book").orderBy(F.col("__place").isNull(), "__place", "i", "off", source_rank(F.substring_index("source", "+", 1)), "seq")
    return issues.join(places, ["book", "f"], "left").withColumn("nth", F.row_number().over(order)).drop("__place")
