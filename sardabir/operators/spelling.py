"""Spelling by the corpus itself: rare words one edit from frequent ones, and rare ways to place half-spaces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import text as T
from .words import tokens


@dataclass(frozen=True)
class Thresholds:
    rare_max: int = 3
    rare_books: int = 2
    freq_min: int = 30
    ratio: int = 40
    min_len: int = 4
    dominant_min: int = 20
    dominant_ratio: int = 5


#: Frequent words, or flagged ones, that each task may hold; more are joined by a shuffle.
CARRIED = 500_000
#: Rare words that are looked up at once.
LOOKED_UP = 10_000


def zwnj_variants(stats: DataFrame, known: DataFrame, at: Thresholds = Thresholds()) -> DataFrame:
    """Words that a much more frequent form with other half-spaces shadows. Ties: the least word is dominant."""
    base = F.replace("word", F.lit(C.HALF_SPACE), F.lit(""))
    forms = stats.select("word", "tf", base.alias("base"))
    top = forms.groupBy("base").agg(F.min(F.struct((-F.col("tf")).alias("less"), F.col("word").alias("sugg"))).alias("top"), F.count("*").alias("forms"))
    best = top.select("base", (-F.col("top.less")).alias("most"), "top.sugg", "forms").where(f"forms > 1 AND most >= {at.dominant_min}").drop("forms")
    shadowed = forms.join(best, "base").where((F.col("word") != F.col("sugg")) & (F.col("most") >= at.dominant_ratio * F.col("tf")))
    return shadowed.join(known.select("word"), "word", "left_anti").select(
        "word", "sugg", F.lit("zwnj_variant").alias("kind"), "tf", F.col("most").alias("sugg_tf"),
        F.round(F.least(F.lit(0.95), F.col("most") / (F.col("most") + F.col("tf"))), 2).alias("conf"))


def rare_words(stats: DataFrame, known: DataFrame, flagged: DataFrame, at: Thresholds = Thresholds()) -> DataFrame:
    length = F.length(F.replace("word", F.lit(C.HALF_SPACE), F.lit("")))
    return stats.where((F.col("tf") <= at.rare_max) & (F.col("df") <= at.rare_books) & (length >= at.min_len)).join(
        known.select("word"), "word", "left_anti").join(flagged.select("word"), "word", "left_anti")


def _near(rare: DataFrame, often: list[str], often_tf: np.ndarray, ratio: int) -> DataFrame:
    """word, tf, cand, cand_tf: rare words with all frequent words, ``ratio`` times as frequent, that share a key's hash."""
    of, hashes = T.key_hashes(often)
    order = np.argsort(hashes, kind="stable")
    carried = rare.sparkSession.sparkContext.broadcast((pa.array(often, pa.string()), often_tf, of[order].astype(np.int32), hashes[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cands, cands_tf, owner, sought = carried.value
        for whole in batches:
            for start in range(0, whole.num_rows, LOOKED_UP):
                batch = whole.slice(start, LOOKED_UP)
                tf = batch.column(1).to_numpy()
                row, key = T.key_hashes(batch.column(0).to_pylist())
                first, end = np.searchsorted(sought, key, "left"), np.searchsorted(sought, key, "right")
                met = np.flatnonzero(end > first)
                row, first, n = row[met], first[met], (end - first)[met]
                place = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
                row, cand = np.repeat(row, n), owner[place]
                held = cands_tf[cand] >= ratio * tf[row]
                row, cand = np.divmod(np.unique(row[held] * len(cands) + cand[held]), max(len(cands), 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(tf[row], pa.int64()), cands.take(pa.array(cand)), pa.array(cands_tf[cand], pa.int64())], names=["word", "tf", "cand", "cand_tf"])

    return rare.mapInArrow(run, "word string, tf bigint, cand string, cand_tf bigint")


def corpus_typos(stats: DataFrame, known: DataFrame, flagged: DataFrame, at: Thresholds = Thresholds()) -> DataFrame:
    """Rare words with the most frequent word one edit apart. Ties: the least word.

    Two words one edit apart share a key among themselves and their strings with one character less, so the search is
    for equal keys; pairs are then verified. Frequent words are few, and each task looks its rare words up in hashes of
    their keys; if they are too many for that, keys meet in a join.
    """
    keys = lambda df, word, n: df.select("word", "tf", F.explode(F.array_union(F.array("word"), T.deletes(F.col("word")))).alias("key")).withColumnsRenamed({"word": word, "tf": n})
    often = stats.where((F.col("tf") >= at.freq_min) & (F.length("word") >= at.min_len - 1)).select("word", "tf")
    rare = rare_words(stats, known, flagged, at).select("word", "tf")
    some = often.limit(CARRIED + 1).toPandas()
    if len(some) <= CARRIED:
        near = _near(rare, some["word"].tolist(), some["tf"].to_numpy(), at.ratio)
    else:
        near = keys(rare, "word", "tf").join(keys(often, "cand", "cand_tf"), "key")
    pairs = near.where((F.col("cand") != F.col("word")) & (F.col("cand_tf") >= at.ratio * F.col("tf")))
    verified = pairs.select("word", "tf", "cand", "cand_tf").distinct().where(T.is_one_edit(F.col("word"), F.col("cand")) & ~T.is_inflection(F.col("word"), F.col("cand")))
    best = verified.groupBy("word", "tf").agg(F.min(F.struct((-F.col("cand_tf")).alias("less"), F.col("cand").alias("sugg"))).alias("best"))
    return best.select(
        "word", "best.sugg", F.lit("corpus_typo").alias("kind"), "tf", (-F.col("best.less")).alias("sugg_tf"),
        F.round(F.least(F.lit(0.95), F.lit(0.45) + F.log10(-F.col("best.less") / F.col("tf")) / 6), 2).alias("conf"))


def flagged_words(stats: DataFrame, known: DataFrame, at: Thresholds = Thresholds()) -> DataFrame:
    variants = zwnj_variants(stats, known, at)
    return variants.unionByName(corpus_typos(stats, known, variants, at))


# The messages.
_FA = {"corpus_typo": "احتمالاً غلط املایی؛ شکل رایج در کل مجموعه: «%s» (%d بار)", "zwnj_variant": "نیم‌فاصله ناهماهنگ با بقیه‌ی مجموعه؛ شکل رایج: «%s» (%d بار)"}
_EN = {"corpus_typo": "Likely typo; common form across the corpus: %s (%d×)", "zwnj_variant": "ZWNJ spacing inconsistent with the rest of the corpus; common form: %s (%d×)"}


def spelling_issues(blocks: DataFrame, flagged: DataFrame, *, compose: bool = True) -> DataFrame:
    """Every place of a flagged word, in blocks that don't look Arabic.

    ``flagged`` is looked at twice, so it should be written down. Its words go to the texts, so that no other word leaves
    the function that finds words; if they are too many for that, all words meet them in a join.
    """
    some = flagged.select("word").limit(CARRIED + 1).toPandas()["word"]
    only = blocks.sparkSession.sparkContext.broadcast(frozenset(some)) if len(some) <= CARRIED else None
    places = tokens(blocks.where(~T.is_arabic_like(F.col("t"))), compose=compose, only=only)
    told = lambda texts: F.when(F.col("kind") == "corpus_typo", F.format_string(texts["corpus_typo"], "sugg", "sugg_tf")).otherwise(F.format_string(texts["zwnj_variant"], "sugg", "sugg_tf"))
    keep = [c for c in blocks.columns if c != "t"]
    return places.join(F.broadcast(flagged) if only else flagged, places["norm"] == flagged["word"]).select(
        *keep, F.col("s").alias("off"), (F.col("e") - F.col("s")).alias("len"), F.col("raw").alias("orig"), "sugg", F.col("kind").alias("rule"), F.lit("review").alias("severity"),
        F.when(F.col("kind") == "corpus_typo", F.lit("spelling")).otherwise(F.lit("typography")).alias("category"), "conf", told(_FA).alias("msg_fa"), told(_EN).alias("msg_en"))


def rank_candidates(flagged: DataFrame) -> DataFrame:
    """Flagged words with their rank: the surest first, then by word."""
    # numbered per confidence, of which there are at most a hundred, so no task holds all words by design of the data
    counts = flagged.groupBy("conf").count()
    before = counts.select("conf", F.coalesce(F.sum("count").over(Window.orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return flagged.withColumn("nth", F.row_number().over(Window.partitionBy("conf").orderBy("word"))).join(F.broadcast(before), "conf").select(
        (F.col("before") + F.col("nth")).alias("rank"), "word", "sugg", "kind", "tf", "sugg_tf", "conf")
