"""Hashed word shingles of many texts at once, in numpy.

Words are maximal runs of code points other than U+0020 and U+0009 to U+000D, with A-Z lower-cased. A text's set holds
its distinct runs of five words; a text of one to four words has its whole sequence as one shingle; one without words
has none. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import slices

SHINGLE_WORDS = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64); works in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


class _Powers:
    """Powers of the odd base modulo 2**64 and of its inverse, as far as a text needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate((self.up, self.up * np.uint64(pow(_ODD, k, 1 << 64))))
                self.down = np.concatenate((self.down, self.down * np.uint64(pow(_ODD, -k, 1 << 64))))
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words end among them."""
    parts = [text.encode("utf-8", "surrogatepass").translate(_LOWER) for text in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    ends_of = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    starts, ends = runs_of(~_SPACE[data])
    return span_hashes(data, starts, ends), np.searchsorted(starts, ends_of)


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last value must be False."""
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        turn = np.concatenate(([0], turn))
    return turn[0::2], turn[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, which depend on their bytes only."""
    up, down = _POWERS.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * up[:len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for first, last in slices(texts):
        words, until = word_hashes(texts[first:last])
        with np.errstate(over="ignore"):
            runs = np.zeros(max(0, len(words) - SHINGLE_WORDS + 1), dtype=np.uint64)
            for k in range(SHINGLE_WORDS):
                runs = runs * np.uint64(_ODD) + words[k:k + len(runs)]
            mix(runs)
        start = 0
        for end in until:
            n = end - start
            if n >= SHINGLE_WORDS:
                out.append(np.unique(runs[start:end - SHINGLE_WORDS + 1]))
            elif n:
                with np.errstate(over="ignore"):
                    whole = np.uint64(n)
                    for w in words[start:end]:
                        whole = whole * np.uint64(_ODD) + w
                out.append(mix(np.array([whole])))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            start = end
    return out


def minima(sets: list[np.ndarray], factors: np.ndarray, shifts: np.ndarray, block: int = 32_768) -> np.ndarray:
    """MinHash minima, one row for each non-empty set and one column for each pair of factor and shift.

    Hash k of a shingle is ``factors[k] * x + shifts[k]`` modulo 2**32 over the shingle's high 32 bits, a permutation
    since the factors are odd. Sets are worked through in blocks that stay in the processor's cache.
    """
    out = np.empty((len(sets), len(factors)), dtype=np.uint32)
    for first, last in _groups([len(s) for s in sets], block):
        x = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[first:last - 1]]))).astype(np.int64)
        hashed = np.empty_like(x)
        for k, (a, b) in enumerate(zip(factors, shifts)):
            np.multiply(x, a, out=hashed)
            np.add(hashed, b, out=hashed)
            out[first:last, k] = np.minimum.reduceat(hashed, starts)
    return out


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
