"""Operator 10: a toxicity classifier, a bidirectional GRU with attention pooling, trained in numpy.

A word's input is an embedding of the whole word beside a sum of embeddings of its runs of four characters (bytes,
with its edges), so stems tell of unseen endings. A text is cut into windows of WINDOW words, each beginning STRIDE
words after the one before, so that all overlap; every window is scored, and the text has the score of its worst one.
The training labels are of texts: of a toxic one the worst window counts, of another its worst windows and some more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, slices
from .labelled import sample
from .shingles import runs_of, span_hashes

WINDOW, STRIDE = 32, 16
WORD_BITS, GRAM_BITS = 15, 16
WIDTH, HIDDEN = 8, 8
#: The training sample's bound for each class, a parameter of the operator.
PER_CLASS = 1200
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.01, 5
#: Code points that are worked through at once, and windows of one pass of the network.
SLICE, BLOCK = 250_000, 2048
#: The logit of a text without words.
NOTHING = -6.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of several texts: hashed words, hashed runs of characters and where they end by word, words' ends by text."""

    words: np.ndarray
    grams: np.ndarray
    gram_ends: np.ndarray
    text_ends: np.ndarray


def read_words(texts: list[str]) -> Words:
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b"\n" + b"\n".join(parts) + b"\n\n\n\n", dtype=np.uint8)]
    letters = _LETTER[data]
    starts, ends = runs_of(letters)
    words = (span_hashes(data, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    clean = np.where(letters, data, 0).astype(np.uint32)
    codes = (clean[:-3] << np.uint32(24)) | (clean[1:-2] << np.uint32(16)) | (clean[2:-1] << np.uint32(8)) | clean[3:]
    codes = (codes * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    counts = np.maximum(1, ends - starts - 1)
    gram_ends = np.cumsum(counts)
    at = np.repeat(starts - 1 - (gram_ends - counts), counts) + np.arange(gram_ends[-1] if len(counts) else 0)
    text_ends = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]) + 1 if parts else np.zeros(0, int))
    return Words(words, codes[at].astype(np.int32), gram_ends, text_ends)


def read_all(texts: list[str]) -> Words:
    """As read_words, slice by slice, so that only the result takes memory in proportion to all texts."""
    parts = [read_words(texts[a:b]) for a, b in slices(texts, SLICE)]
    shifted = lambda ends, sizes: np.concatenate([e + n for e, n in zip(ends, np.cumsum([0, *sizes]))])
    return Words(
        np.concatenate([p.words for p in parts]), np.concatenate([p.grams for p in parts]),
        shifted([p.gram_ends for p in parts], [len(p.grams) for p in parts]), shifted([p.text_ends for p in parts], [len(p.words) for p in parts]))


def cut(read: Words, a: int, b: int) -> Words:
    """The words of texts a to b."""
    first, last = int(read.text_ends[a - 1]) if a else 0, int(read.text_ends[b - 1])
    start = int(read.gram_ends[first - 1]) if first else 0
    end = int(read.gram_ends[last - 1]) if last else 0
    return Words(read.words[first:last], read.grams[start:end], read.gram_ends[first:last] - start, read.text_ends[a:b] - first)


def windows(text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end of the text's words, and text of every window; a text without words has none."""
    starts = np.concatenate(([0], text_ends[:-1]))
    n = text_ends - starts
    counts = np.where(n == 0, 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1))
    of = np.repeat(np.arange(len(n)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[of] + STRIDE * nth, text_ends[of], of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Network:
    """Weights by name; ``bias`` shifts the logits so that 0.5 divides the training texts best."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None
    bias: float = 0.0

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        d, h = 2 * WIDTH, HIDDEN
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        w = {"word": rng.normal(0, 0.05, (1 << WORD_BITS, WIDTH)).astype(np.float32), "gram": rng.normal(0, 0.05, (1 << GRAM_BITS, WIDTH)).astype(np.float32)}
        for side in "fb":
            w |= {f"W{side}": normal(d, 3 * h), f"c{side}": np.zeros(3 * h, np.float32), f"U{side}": normal(h, 3 * h)}
        w |= {"A": normal(2 * h, h), "a": np.zeros(h, np.float32), "v": normal(h, 1)[:, 0], "o": normal(2 * h, 1)[:, 0], "p": np.zeros(1, np.float32)}
        return Network(w)

    def inputs(self, read: Words) -> np.ndarray:
        """Input vectors of all words, and a row of zeros, which stands for places beyond a text's end."""
        out = np.zeros((len(read.words) + 1, 2 * WIDTH), np.float32)
        if len(read.words):
            out[:-1, :WIDTH] = self.weights["word"][read.words]
            out[:-1, WIDTH:] = np.add.reduceat(self.weights["gram"][read.grams], np.concatenate(([0], read.gram_ends[:-1])))
        return out

    def _run(self, side: str, steps: list[np.ndarray], kept: list | None) -> list[np.ndarray]:
        """Hidden states after every step, for inputs already projected."""
        u, h = self.weights[f"U{side}"], HIDDEN
        state, out = np.zeros((len(steps[0]), h), np.float32), []
        for x in steps:
            own = state @ u
            gates = _sigmoid(x[:, :2 * h] + own[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h:] + r * own[:, 2 * h:])
            if kept is not None:
                kept.append((state, z, r, own[:, 2 * h:], new))
            state = new + z * (state - new)
            out.append(state)
        return out

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """What the input vectors add to the gates of either direction."""
        return {side: vectors @ self.weights[f"W{side}"] + self.weights[f"c{side}"] for side in "fb"}

    def logits(self, projected: dict[str, np.ndarray], places: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Of windows, given as ``places`` (steps x windows) among the words, the last of which is the empty one."""
        w, t = self.weights, len(places)
        states = {}
        for side, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            trace = [] if kept is not None else None
            run = self._run(side, [projected[side][places[i]] for i in order], trace)
            states[side] = run if side == "f" else run[::-1]
            if kept is not None:
                kept[side] = trace
        both = np.concatenate((np.stack(states["f"]), np.stack(states["b"])), axis=2)
        hidden = np.tanh(both @ w["A"] + w["a"])
        weight = hidden @ w["v"]
        weight[places == len(projected["f"]) - 1] = -1e9
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbd->bd", weight, both)
        if kept is not None:
            kept |= {"both": both, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ w["o"] + w["p"][0]

    def gradients(self, error: np.ndarray, vectors: np.ndarray, places: np.ndarray, kept: dict) -> tuple[dict, np.ndarray]:
        """Of the weights but the embeddings, and of the input vectors; ``error`` is the loss's slope by logit."""
        w, t, h = self.weights, len(places), HIDDEN
        both, hidden, weight, pooled = (kept[k] for k in ("both", "hidden", "weight", "pooled"))
        g = {"o": pooled.T @ error, "p": np.array([error.sum()], np.float32)}
        d_pooled = error[:, None] * w["o"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tbd,bd->tb", both, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_hidden = d_score[:, :, None] * w["v"] * (1 - hidden * hidden)
        g["v"] = np.einsum("tb,tbh->h", d_score, hidden)
        g["A"] = np.einsum("tbd,tbh->dh", both, d_hidden)
        g["a"] = d_hidden.sum(axis=(0, 1))
        d_both += d_hidden @ w["A"].T
        d_vectors = np.zeros_like(vectors)
        for side, order in (("f", range(t - 1, -1, -1)), ("b", range(t))):
            u, part = w[f"U{side}"], slice(0, h) if side == "f" else slice(h, 2 * h)
            g[f"U{side}"], d_projected = np.zeros_like(u), np.zeros((len(vectors), 3 * h), np.float32)
            carry = np.zeros((places.shape[1], h), np.float32)
            for i in order:
                state, z, r, own, new = kept[side][i if side == "f" else t - 1 - i]
                carry = carry + d_both[i][:, part]
                d_new = carry * (1 - z) * (1 - new * new)
                d_z = carry * (state - new) * z * (1 - z)
                d_r = d_new * own * r * (1 - r)
                d_own = np.concatenate((d_z, d_r, d_new * r), axis=1)
                np.add.at(d_projected, places[i], np.concatenate((d_z, d_r, d_new), axis=1))
                g[f"U{side}"] += state.T @ d_own
                carry = carry * z + d_own @ u.T
            g[f"W{side}"], g[f"c{side}"] = vectors.T @ d_projected, d_projected.sum(axis=0)
            d_vectors += d_projected @ w[f"W{side}"].T
        return g, d_vectors

    def worst(self, read: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logit of every window, with the windows' first words and texts."""
        first, end, of = windows(read.text_ends)
        projected, out = self.project(self.inputs(read)), np.empty(len(first), np.float32)
        for a in range(0, len(first), BLOCK):
            out[a:a + BLOCK] = self.logits(projected, _places(first[a:a + BLOCK], end[a:a + BLOCK], len(read.words)))
        return out, first, of

    def worst_of_all(self, read: Words, parts: list[tuple[int, int]]) -> np.ndarray:
        """The logit of every window, some texts at a time."""
        return np.concatenate([self.worst(cut(read, a, b))[0] for a, b in parts])

    def scores(self, texts: list[str]) -> np.ndarray:
        """Between 0 and 1, of the whole texts."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        worst = np.full(len(texts), NOTHING)
        for a, b in slices(texts, SLICE):
            got, _, of = self.worst(read_words(texts[a:b]))
            np.maximum.at(worst, a + of, got.astype(np.float64) + self.bias)
        return 1 / (1 + np.exp(-np.clip(worst, -30, 30)))


def _places(first: np.ndarray, end: np.ndarray, nothing: int) -> np.ndarray:
    at = first[None, :] + np.arange(WINDOW)[:, None]
    return np.where(at < end[None, :], at, nothing)


def _log_odds(read: Words, parts: list[tuple[int, int]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much likelier each hashed word and run of characters is in texts of label 1, by the texts that have it."""
    seen = {"words": np.zeros((2, 1 << WORD_BITS)), "grams": np.zeros((2, 1 << GRAM_BITS))}
    for a, b in parts:
        part = cut(read, a, b)
        of = np.repeat(np.arange(b - a), np.diff(part.text_ends, prepend=0))
        for name, ids, owner in (("words", part.words, of), ("grams", part.grams, np.repeat(of, np.diff(part.gram_ends, prepend=0)))):
            size = seen[name].shape[1]
            pairs = np.unique(owner * size + ids)
            for label in (0, 1):
                seen[name][label] += np.bincount(pairs[labels[a + pairs // size] == label] % size, minlength=size)
    n, m = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    return tuple(np.clip(np.log((x[1] + 1) / (n + 2)) - np.log((x[0] + 1) / (m + 2)), -4, 4).astype(np.float32) for x in seen.values())


def train(texts: list[str], labels: np.ndarray) -> Network:
    """Fits a network to labels of whole texts by Adam."""
    if not len(labels) or labels.min() == labels.max():
        return Network(constant=0.5 if not len(labels) else 0.95 if labels[0] else 0.05)
    rng = np.random.default_rng(SEED)
    net, read, parts = Network.fresh(rng), read_all(texts), list(slices(texts, SLICE))
    counts = np.diff(read.gram_ends, prepend=0)
    by_word, by_gram = _log_odds(read, parts, labels)
    net.weights["word"][:, 0] = by_word / 4
    net.weights["gram"][:, 0] = by_gram / 8
    first, end, of = windows(read.text_ends)
    odds = np.append(by_word[read.words], -9.0).astype(np.float32)
    rank = np.concatenate([odds[_places(first[a:a + BLOCK], end[a:a + BLOCK], len(read.words))].max(axis=0) for a in range(0, len(first), BLOCK)])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.weights.items() if k not in ("word", "gram")}
    squares = {k: np.full(net.weights[k].shape, 1e-4, np.float32) for k in ("word", "gram")}
    steps = 0
    for epoch in range(EPOCHS):
        if epoch:
            rank = net.worst_of_all(read, parts)
        order = np.lexsort((-rank, of))
        nth = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        chosen = order[(nth == 0) | (nth == 1) & (labels[of[order]] == 0)]
        others = np.flatnonzero(labels[of] == 0)
        chosen = rng.permutation(np.concatenate((chosen, rng.choice(others, min(len(others), 2 * len(texts)), replace=False))))
        positive = max(1, int(labels[of[chosen]].sum()))
        for a in range(0, len(chosen), BATCH):
            rows = chosen[a:a + BATCH]
            places = _places(first[rows], end[rows], len(read.words))
            used, back = np.unique(places[places < len(read.words)], return_inverse=True)
            local = np.full(places.shape, len(used))
            local[places < len(read.words)] = back
            spans = counts[used]
            gram_at = np.repeat(read.gram_ends[used] - np.cumsum(spans), spans) + np.arange(spans.sum())
            part = Words(read.words[used], read.grams[gram_at], np.cumsum(spans), np.array([len(used)]))
            vectors, kept = net.inputs(part), {}
            y = labels[of[rows]]
            error = _sigmoid(net.logits(net.project(vectors), local, kept)) - y
            error = (error * np.where(y == 1, len(chosen) / (2 * positive), len(chosen) / (2 * (len(chosen) - positive))) / len(rows)).astype(np.float32)
            g, d_vectors = net.gradients(error, vectors, local, kept)
            steps += 1
            for k, value in g.items():
                m, s = moments[k]
                m += np.float32(0.1) * (value - m)
                s += np.float32(0.01) * (value * value - s)
                net.weights[k] -= (RATE * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
            for k, ids, slope in (("word", part.words, d_vectors[:-1, :WIDTH]), ("gram", part.grams, np.repeat(d_vectors[:-1, WIDTH:], spans, axis=0))):
                kinds, at = np.unique(ids, return_inverse=True)
                total = np.column_stack([np.bincount(at, weights=slope[:, c], minlength=len(kinds)) for c in range(WIDTH)]).astype(np.float32)
                squares[k][kinds] += total * total
                net.weights[k][kinds] -= np.float32(0.02) * total / np.sqrt(squares[k][kinds])
    worst = np.full(len(texts), NOTHING)
    np.maximum.at(worst, of, net.worst_of_all(read, parts).astype(np.float64))
    net.bias = -_divide(worst, labels)
    return net


def _divide(worst: np.ndarray, labels: np.ndarray) -> float:
    """The logit that divides both labels with the fewest errors, classes weighted equally.

    In the gap it lies nearer to the toxic side: unseen texts of the other kind have had no window trained away.
    """
    order = np.argsort(worst)
    y = labels[order]
    below = np.concatenate(([0], np.cumsum(y) / max(1, y.sum()))) + np.concatenate(([1], 1 - np.cumsum(1 - y) / max(1, (1 - y).sum())))
    best = np.flatnonzero(below <= below.min() + 1e-9)
    k = int(best[len(best) // 2])
    low, high = worst[order[max(0, k - 1)]], worst[order[min(k, len(order) - 1)]]
    return float(low + 0.75 * (high - low))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network trained on at most ``per_class`` texts of each label among the ``usable`` label rows.

    No other column than the text is read. Without rows, or with one label only, the network is a constant.
    """
    rows = sample(docs.select(id_col, text_col), labels, label, usable, per_class, id_col, text_col).select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col("__label").alias("y")).toArrow()
    pairs = sorted(zip(rows["y"].to_pylist(), rows["t"].to_pylist()))
    return train([t for _, t in pairs], np.array([y for y, _ in pairs], dtype=np.int64))


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score of every row. Null or empty text, or one without letters: a low constant. Null id: stays null.
    Equal texts: equal scores but for rounding. Texts of any length are read whole. Empty table: no rows. Other columns are not read."""

    def run(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(0), "score": network.scores([t or "" for t in batch.column(1).to_pylist()])}

    return map_rows(docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col), run, f"{id_col} long,score double")
