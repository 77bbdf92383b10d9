"""Command line: scan, report and fix a folder of books, and have them reviewed."""

from __future__ import annotations

import argparse
import importlib
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import issues, markup, report, review, reviewers, spelling, typography, words
from .operators.spelling import Thresholds
from .sources import epub, lists, store

# Fixed value: what a fresh whitelist says.
WHITELIST = "# One word per line. Words in this list are never flagged.\n"


def scan(spark: SparkSession, folder: str, out: str, at: Thresholds = Thresholds(), dictionaries: list[str] = (), limit: int | None = None) -> None:
    """Blocks, rule and spelling issues, statistics and the table of books, below ``out``.

    Books whose size and time are those of the last scan, and which could be read then, are not opened again: their
    blocks stay in the version that has them. Rules run over all books' blocks.
    """
    files = epub.find_files(spark, folder)
    listing = files.select("rel", "size", "mtime")
    listing = listing.orderBy("rel").limit(limit) if limit else listing
    previous, last = store.newest(spark, f"{out}/books", store.BOOKS)
    version = last + 1
    planned = lists.plan_scan(listing, previous.select("rel", "size", "mtime", "error")).persist()
    if planned.isEmpty():
        raise FileNotFoundError(f"no .epub files below {folder}")
    # opened once: blocks and what is told of the books come from the same reading
    opened = epub.open_books(files.join(planned.where("NOT cached").select("rel"), "rel", "left_semi")).persist()
    store.write_version(epub.book_blocks(opened).select("book", "file", F.col("file_pos").cast("bigint").alias("file_pos"), "i", "t"), f"{out}/blocks", version)
    stay = previous.join(planned.where("cached").select("rel"), "rel", "left_semi").drop("words")
    books = stay.unionByName(epub.books_table(opened).withColumn("blocks_version", F.lit(version)).select(stay.columns))
    place = store.scratch(spark, "books")
    books.write.parquet(place)
    opened.unpersist()
    planned.unpersist()
    books = spark.read.parquet(place)
    blocks = store.blocks_of(spark, f"{out}/blocks", books)

    found = typography.messages(typography.find_issues(blocks.select("book", F.col("file").alias("f"), "file_pos", "i", "t"))).withColumn("seq", typography.priority(F.col("rule")))
    found.write.mode("overwrite").parquet(f"{out}/hits")  # the rules run once; three tables come from their hits
    hits = spark.read.parquet(f"{out}/hits")
    issues.safe_counts(hits).write.mode("overwrite").parquet(f"{out}/safe_counts")
    kept = issues.for_review(hits).unionByName(issues.safe_examples(hits).drop("nth"))
    store.write_issues(kept.withColumn("source", F.lit("rules")), f"{out}/issues")

    counts = words.word_stats(words.book_word_counts(blocks))
    counts.write.mode("overwrite").parquet(f"{out}/word_stats")
    stats = spark.read.parquet(f"{out}/word_stats")
    whitelist = f"{out}/whitelist.txt"
    store.write_text(WHITELIST, whitelist, replace=False)
    known = reduce(DataFrame.unionByName, [lists.load_wordlist(spark, p) for p in [*dictionaries, whitelist]]).distinct()
    spelling.flagged_words(stats, known, at).write.mode("overwrite").parquet(f"{out}/flagged")
    flagged = spark.read.parquet(f"{out}/flagged")
    ranked = spelling.rank_candidates(flagged).orderBy("rank")
    store.write_csv(ranked.select("word", F.col("sugg").alias("suggestion"), "kind", F.col("tf").alias("count"), F.col("sugg_tf").alias("suggestion_count"), F.col("conf").alias("confidence")), f"{out}/spelling_candidates.csv")
    spelt = spelling.spelling_issues(blocks.select("book", F.col("file").alias("f"), "i", "t"), flagged)
    store.write_issues(spelt.withColumn("source", F.lit("spelling")).withColumn("seq", F.lit(0)), f"{out}/issues")

    counted = books.join(words.book_words(blocks).withColumnRenamed("book", "id"), "id", "left").na.fill(0, ["words"])
    store.write_version(counted, f"{out}/books", version)
    limits = F.struct(*[F.lit(v).alias(k) for k, v in asdict(at).items() if not k.startswith("dominant")])
    store.write_json(corpus_stats(books, stats, known).withColumn("thresholds", limits), f"{out}/corpus_stats.json")


def corpus_stats(books: DataFrame, stats: DataFrame, known: DataFrame) -> DataFrame:
    """One row: books that can be read, tokens, types and known_words."""
    one = stats.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"), F.count("*").alias("types"))
    return books.where("error IS NULL").agg(F.count("*").alias("books")).crossJoin(one).crossJoin(known.agg(F.count("*").alias("known_words")))


def books_of(spark: SparkSession, out: str) -> DataFrame:
    books, last = store.newest(spark, f"{out}/books", store.BOOKS)
    if last < 0:
        raise FileNotFoundError(f"no scan in {out}")
    return books


def make_report(spark: SparkSession, out: str, min_conf: float = 0.0) -> str:
    """CSV files and pages below ``out``/report; returns the index."""
    books, safe = books_of(spark, out), spark.read.parquet(f"{out}/safe_counts")
    blocks = store.blocks_of(spark, f"{out}/blocks", books)
    place = store.scratch(spark, "merged")
    issues.at_least(issues.dedup(store.read_issues(spark, f"{out}/issues")), min_conf).write.parquet(place)
    merged = spark.read.parquet(place)
    fine = books.where("error IS NULL").withColumnRenamed("id", "book")
    review_rows = issues.review_order(issues.for_review(merged), fine.select("book", "spine"))
    counted = safe.groupBy("book").agg(F.sum("n").alias("auto_fixed"))
    density = issues.book_density(fine, issues.category_counts(issues.for_review(merged)))
    told = density.join(fine.select("book", "title", "rel"), "book").join(counted, "book", "left").na.fill(0, ["auto_fixed"])
    store.write_csv(report.all_issues(review_rows, blocks, fine), f"{out}/report/all_issues.csv")
    store.write_csv(report.summary(books, density, safe), f"{out}/report/summary.csv")
    # the examples of a rule in the order of reading
    order = Window.partitionBy("book", "rule").orderBy("nth")
    shown = issues.review_order(merged.where("severity = 'safe'"), fine.select("book", "spine")).withColumn("nth", F.row_number().over(order))
    log = store.read(spark, f"{out}/fix_log", "book string, rule string, n bigint")
    fixes = log if not log.isEmpty() else None
    pages = report.book_pages(told.drop("auto_fixed"), review_rows, shown, safe, blocks, fixes).select(F.concat("book", F.lit(".html")).alias("name"), "html")
    store.write_files(pages, f"{out}/report/books", "name", "html")
    totals = issues.totals(density, safe).first().asDict()
    types = store.read(spark, f"{out}/word_stats", "word string").count()
    index = report.index_page(told, books.where("error IS NOT NULL"), totals | {"types": types})
    store.write_text(index, f"{out}/report/index.html")
    return index


def fix(spark: SparkSession, folder: str, out: str, dest: str | None = None) -> DataFrame:
    """Corrected copies below ``dest`` (``out``/fixed); returns what was changed by book and rule."""
    books = books_of(spark, out).where("error IS NULL")
    fixed = markup.fix_books(epub.find_files(spark, folder), books.select("rel", "spine")).persist()
    store.write_files(fixed, dest or f"{out}/fixed", "rel", "content")
    counts = markup.fix_counts(fixed, "rel").join(books.select("rel", F.col("id").alias("book")), "rel")
    counts.select("book", "rel", "rule", "n").write.mode("overwrite").parquet(f"{out}/fix_log")
    fixed.unpersist()
    counts = spark.read.parquet(f"{out}/fix_log")
    store.write_json(counts.groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("counts")), f"{out}/fix_log.json")
    return counts.select("rel", "rule", "n")


def wanted_requests(spark: SparkSession, out: str, model: str, registers: str | None = None, only: list[str] | None = None, limit: int | None = None, max_chars: int = review.MAX_CHARS) -> tuple[DataFrame, int]:
    """Requests for the selected books, and the number of the first."""
    books = lists.select_books(books_of(spark, out), only, limit)
    blocks = store.blocks_of(spark, f"{out}/blocks", books)
    known = lists.load_registers(spark, registers) if registers else spark.createDataFrame([], "file string, register string")
    first = reviewers.next_number(spark, f"{out}/grammar")
    return review.requests(review.chunks(blocks, max_chars), review.registers_of(books.withColumnRenamed("id", "book"), known), model, first), first


def rebuild(spark: SparkSession, out: str, min_conf: float = review.MIN_CONF) -> DataFrame:
    """Writes the reviewer's issues anew from all that was sent and answered; returns them all, with ``ok``."""
    blocks = store.blocks_of(spark, f"{out}/blocks", books_of(spark, out))
    told = reviewers.issues(spark, f"{out}/grammar", blocks, min_conf)
    store.write_issues(told.where("ok"), f"{out}/issues")
    return told


def estimate(spark: SparkSession, out: str, client: reviewers.Client, model: str, price_in: float | None = None, price_out: float | None = None, **which) -> DataFrame:
    """One row: requests, chars, est_in, out_low, out_high, and the costs if both prices are given."""
    rows, _ = wanted_requests(spark, out, model, **which)
    tokens = F.udf(lambda params: client.count_tokens(params), "long")  # of 25 requests at most
    told = review.estimate(rows, lambda _: tokens("params"), price_in or 0.0, price_out or 0.0)
    return told if price_in and price_out else told.drop("cost_low", "cost_high")


def pilot(spark: SparkSession, out: str, client: reviewers.Client, model: str, min_conf: float = review.MIN_CONF, concurrency: int = 4, limit: int | None = None, **which) -> DataFrame:
    """Puts the requests of a few books to the client at once; returns the issues of all books reviewed so far, with ``ok``."""
    rows, first = wanted_requests(spark, out, model, limit=limit or reviewers.PILOT_BOOKS, **which)
    reviewers.pilot(rows, f"{out}/grammar", client, first, concurrency)
    return rebuild(spark, out, min_conf)


def submit(spark: SparkSession, out: str, client: reviewers.Client, model: str, dry_run: bool = False, **which) -> DataFrame:
    """Hands the requests over in batches; a dry run only writes them down. Returns the batches, or the requests."""
    rows, first = wanted_requests(spark, out, model, **which)
    if dry_run:
        store.write_json(rows.select("cid", "params"), f"{out}/grammar/dry_run_requests")
        return rows
    return reviewers.submit(rows, f"{out}/grammar", client, model, first)


def client_of(name: str | None, out: str) -> reviewers.Client:
    """The client that ``module:factory`` makes, given the folder; without a name, the offline one."""
    if not name:
        return reviewers.OfflineClient(f"{out}/grammar/offline")
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)(f"{out}/grammar")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sardabir", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("scan", "grammar", "fix", "report"):
        p = verbs.add_parser(verb)
        if verb in ("scan", "fix"):
            p.add_argument("folder")
        if verb == "grammar":
            p.add_argument("action", choices=["estimate", "pilot", "submit", "status", "collect"])
        p.add_argument("-o", "--out", required=True)
        if verb == "scan":
            p.add_argument("--dict", action="append", default=[])
            p.add_argument("--limit", type=int)
            for name, value in asdict(Thresholds()).items():
                p.add_argument("--" + name.replace("_", "-"), type=int, default=value)
        if verb in ("report", "grammar"):
            p.add_argument("--min-conf", type=float, default=0.0 if verb == "report" else review.MIN_CONF)
        if verb == "fix":
            p.add_argument("--dest")
        if verb == "grammar":
            p.add_argument("--model", default="offline")
            p.add_argument("--client")
            p.add_argument("--books", type=int)
            p.add_argument("--only", nargs="*")
            p.add_argument("--registers")
            p.add_argument("--max-chars", type=int, default=review.MAX_CHARS)
            p.add_argument("--concurrency", type=int, default=4)
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("--price-in", type=float)
            p.add_argument("--price-out", type=float)
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("sardabir").getOrCreate()
    if a.verb == "scan":
        scan(spark, a.folder, a.out, Thresholds(*(getattr(a, name) for name in asdict(Thresholds()))), a.dict, a.limit)
    elif a.verb == "fix":
        fix(spark, a.folder, a.out, a.dest)
    elif a.verb == "grammar":
        client, which = client_of(a.client, a.out), {"registers": a.registers, "only": a.only, "limit": a.books, "max_chars": a.max_chars}
        if a.action == "estimate":
            estimate(spark, a.out, client, a.model, a.price_in, a.price_out, **which).show(truncate=False)
        elif a.action == "status":
            reviewers.status(spark, f"{a.out}/grammar", client).show(1000, truncate=False)
        elif a.action == "submit":
            submit(spark, a.out, client, a.model, a.dry_run, **which).show(truncate=False)
        elif a.action == "pilot":
            pilot(spark, a.out, client, a.model, a.min_conf, a.concurrency, **which)
        else:
            reviewers.collect(spark, f"{a.out}/grammar", client).show(truncate=False)
            rebuild(spark, a.out, a.min_conf)
        if a.action in ("pilot", "collect"):
            told = reviewers.results(spark, f"{a.out}/grammar")
            review.usage(told).show()
    if a.verb in ("scan", "fix", "report") or a.action in ("pilot", "collect"):
        make_report(spark, a.out, a.min_conf if a.verb == "report" else 0.0)


if __name__ == "__main__":
    main()
