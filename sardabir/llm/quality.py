"""Operator 1: a quality classifier, a factorisation machine trained in numpy.

Inputs of a score: hashed words of the whole text (weights by logarithmic counts, scaled to length one), statistics of
its structure, and as metadata its recorded length. Statistics and metadata are cut at quantiles of the training sample
and enter as indicators. Score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairs are summed in linear
time as half of (sum v_i x_i)**2 - sum (v_i x_i)**2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, slices
from .labelled import sample
from .shingles import word_hashes

WORD_BITS, RANK, BINS = 15, 8, 12
#: The training sample's bound for each class, a parameter of the operator.
PER_CLASS = 2000
EPOCHS, BATCH, RATE, DECAY, SEED = 15, 64, 0.03, 1e-4, 11

# classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 part of a character beyond ASCII,
# 6 full stop or comma, 7 vertical bar, 8 exclamation or question mark, 9 other symbols
_CLASS = np.full(256, 9, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 5
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
_CLASS[[46, 44]] = 6
_CLASS[124] = 7
_CLASS[[33, 63]] = 8
CLASSES = 10
STATISTICS = CLASSES + 8


def _per_text(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=n)


def describe(texts: list[str], lengths: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: where its hashed words end, the words' buckets and weights, and its statistics."""
    ends_all, buckets_all, weights_all, stats_all, total = [], [], [], [], 0
    for first, last in slices(texts):
        part = texts[first:last]
        n = len(part)
        data = np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in part) + b"\n", dtype=np.uint8)
        sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in part])
        kinds = _CLASS[data]
        of_byte = np.repeat(np.arange(n), sizes)
        counts = np.bincount(of_byte * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
        counts[:, 4] -= 1  # the line end that was added
        words, until = word_hashes(part)
        n_words = np.diff(until, prepend=0)
        of_word = np.repeat(np.arange(n), n_words)
        same = np.zeros(len(words), dtype=bool)
        same[1:] = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
        keys, times = np.unique((of_word.astype(np.int64) << WORD_BITS) | (words >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
        of_key = keys >> WORD_BITS
        weight = 1 + np.log(times)
        weight /= np.sqrt(np.maximum(_per_text(weight * weight, of_key, n), 1e-9))[of_key]
        # symbols, bars and marks that end a word
        word_end = np.flatnonzero((kinds[:-1] != 3) & (kinds[:-1] != 4) & ((kinds[1:] == 3) | (kinds[1:] == 4)))
        ending = np.bincount(of_byte[word_end] * CLASSES + kinds[word_end], minlength=n * CLASSES).reshape(n, CLASSES)
        chars = np.maximum(counts.sum(axis=1), 1)
        some = np.maximum(n_words, 1)
        known = np.array([np.nan if x is None else x for x in lengths[first:last]], dtype=np.float64)
        stats_all.append(np.column_stack((
            counts / chars[:, None], np.log1p(n_words), chars / some, _per_text(same, of_word, n) / some, np.bincount(of_key, minlength=n) / some,
            ending[:, 7] / some, ending[:, 8] / some, ending[:, 9] / some, np.nan_to_num(np.log1p(np.maximum(known, 0)), nan=-1.0))))
        ends_all.append(total + np.cumsum(np.bincount(of_key, minlength=n)))
        total += len(keys)
        buckets_all.append((keys & ((1 << WORD_BITS) - 1)).astype(np.int32))
        weights_all.append(weight.astype(np.float32))
    return np.concatenate(ends_all), np.concatenate(buckets_all), np.concatenate(weights_all), np.concatenate(stats_all)


@dataclass
class Model:
    """A trained machine; ``cuts`` holds the statistics' quantiles. Without ``linear`` it scores ``bias`` for all."""

    bias: float
    linear: np.ndarray | None = None
    factors: np.ndarray | None = None
    cuts: np.ndarray | None = None

    def inputs(self, ends: np.ndarray, buckets: np.ndarray, weights: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in compressed form: where each ends, features, values."""
        n = len(ends)
        bins = np.column_stack([np.searchsorted(self.cuts[k], stats[:, k], side="right") + k * BINS for k in range(STATISTICS)]) + (1 << WORD_BITS)
        starts = np.concatenate(([0], ends[:-1]))
        at = np.repeat(np.arange(n), ends - starts)
        order = np.argsort(np.concatenate((at, np.repeat(np.arange(n), STATISTICS))), kind="stable")
        features = np.concatenate((buckets, bins.ravel().astype(np.int32)))[order]
        values = np.concatenate((weights, np.full(n * STATISTICS, 1 / np.sqrt(STATISTICS), np.float32)))[order]
        return ends + STATISTICS * np.arange(1, n + 1), features, values

    def logits(self, ends: np.ndarray, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        starts = np.concatenate(([0], ends[:-1]))
        scaled = self.factors[features] * values[:, None]
        total, squares = np.add.reduceat(scaled, starts), np.add.reduceat(scaled * scaled, starts)
        return self.bias + np.add.reduceat(self.linear[features] * values, starts) + 0.5 * (total * total - squares).sum(axis=1)

    def scores(self, texts: list[str], lengths: list[int | None]) -> np.ndarray:
        if self.linear is None or not texts:
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        out = [1 / (1 + np.exp(-np.clip(self.logits(*self.inputs(*describe(texts[a:b], lengths[a:b]))), -30, 30))) for a, b in slices(texts)]
        return np.concatenate(out).astype(np.float64)


def train(texts: list[str], lengths: list[int | None], labels: np.ndarray) -> Model:
    """Fits a machine by Adagrad on logistic loss, classes weighted equally."""
    positive = int(labels.sum())
    if not len(labels) or positive in (0, len(labels)):
        return Model(bias=0.0 if not len(labels) else 3.0 if positive else -3.0)
    described = describe(texts, lengths)
    cuts = np.quantile(described[3], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    rng = np.random.default_rng(SEED)
    size = (1 << WORD_BITS) + STATISTICS * BINS
    model = Model(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32), cuts)
    ends, features, values = model.inputs(*described)
    starts = np.concatenate(([0], ends[:-1]))
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (len(labels) - positive)) * len(labels)
    past_linear, past_factors, past_bias = np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for first in range(0, len(order), BATCH):
            rows = order[first:first + BATCH]
            at = np.concatenate([np.arange(starts[r], ends[r]) for r in rows])
            own = np.cumsum(ends[rows] - starts[rows])
            f, x = features[at], values[at]
            of = np.repeat(np.arange(len(rows)), ends[rows] - starts[rows])
            scaled = model.factors[f] * x[:, None]
            total = np.add.reduceat(scaled, np.concatenate(([0], own[:-1])))
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(model.logits(own, f, x), -30, 30))) - labels[rows]) / len(rows)
            slope = (error[of] * x).astype(np.float32)
            kinds, back = np.unique(f, return_inverse=True)
            g_linear = np.bincount(back, weights=slope).astype(np.float32) + DECAY * model.linear[kinds]
            pulls = slope[:, None] * (total[of] - scaled)
            g_factors = np.column_stack([np.bincount(back, weights=pulls[:, k]) for k in range(RANK)]).astype(np.float32) + DECAY * model.factors[kinds]
            past_linear[kinds] += g_linear**2
            past_factors[kinds] += g_factors**2
            past_bias += float(error.sum()) ** 2
            model.linear[kinds] -= RATE * g_linear / np.sqrt(past_linear[kinds])
            model.factors[kinds] -= RATE * g_factors / np.sqrt(past_factors[kinds])
            model.bias -= RATE * float(error.sum()) / past_bias**0.5
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> Model:
    """A machine trained on at most ``per_class`` documents of each label among the ``usable`` label rows.

    What reaches the driver is bounded by that number times the length of a text; no other column than text and length
    is read. Without rows, or with one label only, the model is a constant.
    """
    drawn = sample(docs.select(id_col, text_col, length_col), labels, label, usable, per_class, id_col, text_col)
    rows = drawn.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(length_col).cast("bigint").alias("n"), F.col("__label").alias("y")).toArrow()
    order = sorted(range(rows.num_rows), key=lambda i: (rows["y"][i].as_py(), rows["t"][i].as_py()))
    texts, lengths, y = (rows[c].to_pylist() for c in ("t", "n", "y"))
    return train([texts[i] for i in order], [lengths[i] for i in order], np.array([y[i] for i in order], dtype=np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``id_col`` and score of every row. Null text: as empty. Null length: unknown. Null id: stays null. Equal texts of equal
    length: equal scores but for rounding. Texts of any length are read whole. Empty table: no rows. Other columns are not read."""

    def run(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(0), "score": model.scores([t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist())}

    return map_rows(docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col, F.col(length_col).cast("bigint").alias(length_col)), run, f"{id_col} long,score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, with all their columns, in one pass without a shuffle.

    A row is judged by its own text and length alone: equal rows go or stay together, null ids don't matter, null text
    counts as empty, null length as unknown. Empty table: no rows.
    """
    at, n = docs.columns.index(text_col), docs.columns.index(length_col)

    def run(batches):
        for batch in cut(batches):
            good = model.scores([t or "" for t in batch.column(at).to_pylist()], batch.column(n).to_pylist()) >= 0.5
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
