"""Words of blocks, and their counts over books and the corpus."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import chars as C
from ..functions import text as T


#: Words whose normal forms a task keeps, and rows that it hands on at once.
KEPT, ROWS = 200_000, 50_000
_RUN = re.compile(f"[{C.plain(C.LETTERS, C.MARKS, C.PRESENTATION)}{C.HALF_SPACE}{C.STRETCH}]+")


#: What becomes of each code point in a word's normal form: 0 if it is in no word, _GONE if it is left out.
_GONE = 1
_FORM = np.zeros(0x110000, np.uint32)
for _first, _last in (*C.LETTERS, *C.PRESENTATION):
    _FORM[_first:_last + 1] = range(_first, _last + 1)
for _first, _last in C.MARKS:
    _FORM[_first:_last + 1] = _GONE
_FORM[[ord(c) for c in (*C.TO_PERSIAN, C.HALF_SPACE, C.STRETCH)]] = [*map(ord, C.TO_PERSIAN.values()), ord(C.HALF_SPACE), _GONE]
#: Code points that are looked at at once.
LOOKED_AT = 200_000


class _Sought:
    """Which texts may have a word whose norm is among ``only``: words are brought to their normal forms and hashed all at once."""

    def __init__(self, only: frozenset[str], compose: bool) -> None:
        self.compose = compose
        self.powers = np.cumprod(np.full(LOOKED_AT + 1, T.BASE, np.uint64))
        self.less = np.cumprod(np.full(LOOKED_AT + 1, T.LESS, np.uint64))
        self.hashes = np.unique(T.key_hashes(list(only), deletes=False)[1])

    def among(self, texts: list[str]) -> Iterator[bool]:
        """False is sure. Texts that are too long to be looked at at once are let through."""
        start = 0
        while start < len(texts):
            end, size = start + 1, len(texts[start]) + 1
            while end < len(texts) and size + len(texts[end]) < LOOKED_AT:
                size += len(texts[end]) + 1
                end += 1
            yield from self._held(texts[start:end]).tolist() if size <= LOOKED_AT else [True]
            start = end

    def _held(self, texts: list[str]) -> np.ndarray:
        ends = np.cumsum([len(t) + 1 for t in texts])
        codes = _FORM[np.frombuffer("".join([f"{t}\n" for t in texts]).encode("utf-32-le"), np.uint32)]
        held = np.zeros(len(texts), bool)
        if self.compose:
            held[np.searchsorted(ends, np.flatnonzero(codes >= C.PRESENTATION[0][0]), "right")] = True
        places = np.flatnonzero(codes != _GONE)
        codes = codes[places]
        half = codes == ord(C.HALF_SPACE)
        if half.any():
            # of several, the last is left, and none at a word's ends; each text ends with what is in no word
            left = ~(half & np.append(half[1:], False))
            places, codes, half = places[left], codes[left], half[left]
            out = codes == 0
            left = ~(half & (np.append(out[1:], True) | np.insert(out[:-1], 0, True)))
            places, codes = places[left], codes[left]
        inside = np.concatenate([[False], codes != 0, [False]])
        first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        sums = np.insert(np.cumsum(codes * self.powers[:len(codes)]), 0, np.uint64(0))
        hashes = (sums[last] - sums[first]) * self.less[first] * np.uint64(T.BASE)
        if len(self.hashes):
            met = self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes
            held[np.searchsorted(ends, places[first[met]], "right")] = True
        return held


class _Norms(dict):
    """Normal forms of the runs seen so far, half-spaces at their ends aside; each is worked out once.

    Those that are not among ``only``, if that is given, are empty.
    """

    def __init__(self, compose: bool, only: frozenset[str] | None = None) -> None:
        super().__init__()
        self.compose, self.only = compose, only

    def __missing__(self, run: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        norm = T.normed(run.strip(C.HALF_SPACE), compose=self.compose)
        if self.only is not None and norm not in self.only:
            norm = ""
        self[run] = norm
        return norm


def tokens(blocks: DataFrame, text: str = "t", *, compose: bool = True, only: Broadcast[frozenset[str]] | None = None) -> DataFrame:
    """One row for each word: the block's other columns, s, e (code points), raw and norm.

    A word is a run of word characters less the half-spaces at its ends; runs of which nothing remains are left out, and
    words whose norm is not among ``only``, if that is given.
    """
    keep = [c for c in blocks.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = _Norms(compose, only and only.value)
        sought = only and _Sought(only.value, compose)
        for batch in batches:
            of, starts, ends, raws, told = [], [], [], [], []
            texts = batch.column(len(keep)).to_pylist()
            for row, t in itertools.compress(enumerate(texts), sought.among(texts) if sought else itertools.repeat(True)):
                for m in _RUN.finditer(t):
                    raw, s = m[0], m.start()
                    if not (norm := norms[raw]):
                        continue
                    if raw[0] == C.HALF_SPACE:
                        s += len(raw) - len(raw := raw.lstrip(C.HALF_SPACE))
                    raw = raw.rstrip(C.HALF_SPACE)
                    of.append(row)
                    starts.append(s)
                    ends.append(s + len(raw))
                    raws.append(raw)
                    told.append(norm)
                if len(of) >= ROWS:
                    yield _rows(batch, keep, of, (starts, ends, raws, told))
                    of, starts, ends, raws, told = [], [], [], [], []
            yield _rows(batch, keep, of, (starts, ends, raws, told))

    schema = StructType([*[blocks.schema[c] for c in keep], StructField("s", IntegerType()), StructField("e", IntegerType()), StructField("raw", StringType()), StructField("norm", StringType())])
    return blocks.where(F.col(text).rlike(C.WORD_RUN)).select(*keep, text).mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, keep: list[str], of: list[int], columns: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
    kept = batch.select(range(len(keep))).take(pa.array(of, pa.int64())).columns
    return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*keep, "s", "e", "raw", "norm"])


def words_only(blocks: DataFrame, text: str = "t", *, compose: bool = True) -> DataFrame:
    """As tokens, with norm alone: for counting, where offsets would be waste."""
    keep = [c for c in blocks.columns if c != text]
    runs = blocks.select(*keep, F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(C.WORD_RUN), F.lit(0))).alias("run")).where("run IS NOT NULL")
    return runs.select(*keep, T.norm_word(F.btrim(F.col("run"), F.lit(C.HALF_SPACE)), compose=compose).alias("norm")).where("norm <> ''")


#: Counts that a task keeps before it hands them on.
COUNTED = 500_000


def _counted(blocks: DataFrame, *, compose: bool = True, whole: bool = False) -> DataFrame:
    """book, norm and n, in several rows where several tasks, or parts of one, have met a word; with ``whole``, one
    without norm that counts all words, for books without any too.

    Runs are counted as they are written before any is normalised, so that is done once for each, not at every place.
    """
    names = ["book", "n"] if whole else ["book", "norm", "n"]

    def told(counts: dict[str | None, Counter]) -> pa.RecordBatch:
        norms = _Norms(compose)
        if whole:
            rows = [(book, sum(n for run, n in runs.items() if norms[run])) for book, runs in counts.items()]
        else:
            rows = [(book, norm, n) for book, runs in counts.items() for run, n in runs.items() if (norm := norms[run])]
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if name == "n" else pa.string()) for c, name in zip(columns, names)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, Counter] = {}
        for batch in batches:
            for book, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(book, Counter()).update(_RUN.findall(t or ""))
            if sum(map(len, counts.values())) >= COUNTED:
                yield told(counts)
                counts = {}
        yield told(counts)

    return blocks.select("book", "t").mapInArrow(run, ", ".join(f"{name} {'bigint' if name == 'n' else 'string'}" for name in names))


def book_word_counts(blocks: DataFrame, *, compose: bool = True) -> DataFrame:
    """book, norm, n: words of all blocks that don't look Arabic."""
    plain = blocks.where(~T.is_arabic_like(F.col("t"))).select("book", "t")
    return _counted(plain, compose=compose).groupBy("book", "norm").agg(F.sum("n").alias("n"))


def word_stats(counts: DataFrame) -> DataFrame:
    """word, tf, df from the counts by book, which are a map-side sum already."""
    return counts.groupBy(F.col("norm").alias("word")).agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def book_words(blocks: DataFrame, *, compose: bool = True) -> DataFrame:
    """book, words: of all blocks, whatever they look like."""
    return _counted(blocks, compose=compose, whole=True).groupBy("book").agg(F.sum("n").alias("words"))
