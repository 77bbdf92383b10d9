"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search, with Spark expressions only.

A test item is short and a document long, so their Jaccard similarity says little; what counts is containment, the
share of the item's shingles that the document has. Items are partitioned by size, into classes of n from 2**k to
2**(k + 1) - 1 shingles, and each class has a sketch length of its own: an item's sketch is its shingles of least hash
(bottom-k MinHash), looked for among all shingles of a document. With n shingles and a containment of at least 80 %, at
most n - ceil(0.8 n) can be missing, so of one more than that a document that contains the item has at least one; a class
takes what its largest size asks for. Documents are not sketched, so candidates are complete: none is missed by chance.
Candidates are then verified by the exact share of distinct shingles, compared as text.

Words are maximal runs of characters other than U+0020 and U+0009 to U+000D, lower-cased. Shingles are runs of five
words; an item of one to four words is one shingle, its whole sequence, sought among the documents' runs of as many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, hinted

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of item shingles that may be broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACES), -1), lambda w: w != "")


def _runs(rows: DataFrame, length: int, *keep: str) -> DataFrame:
    """The runs of ``length`` words of column ``words``, one row for each place: columns ``keep``, w0, w1, ...

    Outer, and filtered afterwards: for a plain explode, the optimizer would infer a filter that cuts the text again.
    """
    shifted = [F.slice("words", k + 1, F.greatest(F.size("words") - (length - 1), F.lit(0))) for k in range(length)]
    zipped = F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])
    return rows.select(*keep, F.explode_outer(zipped).alias("w")).where("w IS NOT NULL").select(*keep, *[F.col("w")[f"w{k}"].alias(f"w{k}") for k in range(length)])


def _shingles(rows: DataFrame, length: int, *keep: str) -> DataFrame:
    names = [f"w{k}" for k in range(length)]
    return _runs(rows, length, *keep).select(*keep, F.xxhash64(*names).alias("hash"), F.concat_ws(" ", *names).alias("shingle"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Pairs of a document and an item it contains: ``id_col``, ``item_col``, n_item, n_found and containment.

    Null or empty texts contain nothing and are contained in nothing; rows with a null id are left out, as a pair needs
    both. Repeated rows count once. Empty tables: no rows. Other columns are not read. Texts of any length are one
    row each; their shingles are exploded within the task.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    share = int(round(threshold * 1000))
    wanted = items.select(F.col(item_col).cast("bigint").alias("item"), words(F.col("text")).alias("words")).where("item IS NOT NULL AND size(words) > 0")
    wanted = wanted.withColumn("length", F.least(F.size("words"), F.lit(SHINGLE_WORDS)))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), "text").where("doc IS NOT NULL AND text IS NOT NULL")
    found = None
    # at most five lengths; shorter than five only if there are such items
    for length in [r["length"] for r in wanted.select("length").distinct().collect()]:
        one = _contained(texts, wanted.where(F.col("length") == length), length, share)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.sparkSession.range(0).select(F.col("id").alias("doc"), F.col("id").alias("item"), F.col("id").alias("n_item"), F.col("id").alias("n_found"))
    # an item id of several rows is contained if one of them is
    best = found.groupBy("doc", "item").agg(F.max(F.struct((F.col("n_found") / F.col("n_item")).alias("containment"), "n_item", "n_found")).alias("best"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "best.n_item", "best.n_found", "best.containment")


def _contained(texts: DataFrame, wanted: DataFrame, length: int, share: int) -> DataFrame:
    # an item is a distinct text; its size class sets the sketch's length
    keyed = wanted.groupBy("words").agg(F.collect_set("item").alias("holders")).withColumn("key", F.xxhash64("words"))
    grams = _shingles(keyed, length, "key").distinct()
    numbered = grams.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("hash", "shingle"))).alias("grams")).withColumn("n_item", F.size("grams"))
    largest = F.pow(F.lit(2), F.length(F.bin("n_item"))).cast("int") - 1
    sketch_size = F.least(F.col("n_item"), largest - F.ceil(largest * share / 1000) + 1)
    sketch = numbered.select("key", F.explode(F.slice("grams", F.lit(1), sketch_size.cast("int"))).alias("g")).select("key", "g.hash")
    whole = numbered.select("key", "n_item", F.explode("grams").alias("g")).select("key", "n_item", "g.hash", "g.shingle")
    small = whole.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)

    split = texts.withColumn("words", words(F.col("text")))
    # candidates: any shingle of an item's sketch
    hashes = _runs(split.select("doc", "words"), length, "doc").select("doc", F.xxhash64(*[f"w{k}" for k in range(length)]).alias("hash"))
    candidates = hashes.join(hint(sketch), "hash").select("doc", "key").distinct().checkpoint()
    # verification: the distinct shingles a candidate has of its item; texts are shuffled only if candidates are many
    named = candidates.select("doc").distinct()
    suspects = split.join(F.broadcast(named) if candidates.count() <= BROADCAST_ROWS else named, "doc", "left_semi")
    had = _shingles(suspects.select("doc", "words"), length, "doc").join(hint(whole), ["hash", "shingle"]).groupBy("doc", "key").agg(
        F.count_distinct("shingle").alias("n_found"), F.first("n_item").alias("n_item"))
    verified = had.where(F.col("n_found") * 1000 >= F.col("n_item") * share).join(candidates, ["doc", "key"], "left_semi")
    holders = keyed.select("key", F.explode("holders").alias("item"))
    return verified.join(hint(holders), "key").select("doc", "item", F.col("n_item").cast("bigint").alias("n_item"), "n_found")


def clean(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns.

    Rows that repeat an id are judged by the text of each, told apart by a 64-bit hash of both. Rows with a null id, a
    null or an empty text are kept. Empty tables: all rows, or none.
    """
    key = F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col].cast("bigint"), docs[text_col]))
    bad = contaminated(docs.select(key.alias("__key"), docs[text_col].alias("text")), items, threshold, "__key").select("__key").distinct().checkpoint()
    return docs.join(hinted(bad, bad.count()), key == bad["__key"], "left_anti")
