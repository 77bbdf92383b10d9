"""Scalar functions over text columns, as Spark expressions. Offsets are in code points."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import chars as C

GATE_MARKS_PERCENT, GATE_TEH_MARBUTA = 12, 2


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def swap(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def collapse_white(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, F.lit(C.WHITE_RUN), F.lit(" ")))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def has_persian(text: Column) -> Column:
    return text.rlike(C.LETTER)


def is_arabic_like(text: Column) -> Column:
    """Vowelled or Arabic-looking text: marks beyond 12 % of the letters, or two teh marbutas.

    Letters are counted only in a text that has marks at all; a teh marbuta is a letter itself.
    """
    some = f"[{C.members(C.MARKS)}]"
    marks = F.length(text) - F.length(F.regexp_replace(text, F.lit(f"{some}+"), F.lit("")))
    letters = F.length(F.regexp_replace(text, F.lit(f"[^{C.L}]+"), F.lit("")))
    vowelled = text.rlike(some) & has_persian(text) & (marks / F.greatest(letters, F.lit(1)) > GATE_MARKS_PERCENT / 100)
    return (F.substring_index(text, C.TEH_MARBUTA, GATE_TEH_MARBUTA) != text) | vowelled


def gated(text: Column) -> Column:
    """Whether typography rules look at a block."""
    return has_persian(text) & ~is_arabic_like(text)


@F.pandas_udf(StringType())
def _compose(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else unicodedata.normalize("NFKC", w))


def norm_word(word: Column, *, compose: bool = False) -> Column:
    """The form under which a word is counted. With ``compose``, compatibility forms are resolved first.

    That takes a Python function, so it is for inputs that hold presentation forms; other words pass it by.
    """
    if compose:
        word = F.when(word.rlike(r"[\x{FB50}-\x{FEFC}]"), _compose(word)).otherwise(word)
    bare = F.regexp_replace(swap(word, C.TO_PERSIAN), F.lit(f"[{C.members(C.MARKS)}{C.STRETCH}]"), F.lit(""))
    return F.btrim(F.regexp_replace(bare, F.lit(r"\x{200C}{2,}"), F.lit(C.HALF_SPACE)), F.lit(C.HALF_SPACE))


def normed(word: str, *, compose: bool = False) -> str:
    """norm_word of one word, for Python."""
    if not _CHANGES.search(word):
        return word
    if compose and _FORMS.search(word):
        word = unicodedata.normalize("NFKC", word)
    return _DOUBLE.sub(C.HALF_SPACE, word.translate(_BARE)).strip(C.HALF_SPACE)


_BARE = str.maketrans(C.TO_PERSIAN | {chr(c): "" for a, b in C.MARKS for c in range(a, b + 1)} | {C.STRETCH: ""})
_FORMS, _CHANGES = re.compile("[\ufb50-\ufefc]"), re.compile(f"[\ufb50-\ufefc{''.join(C.TO_PERSIAN)}{C.plain(C.MARKS)}{C.STRETCH}{C.HALF_SPACE}]")
_DOUBLE = re.compile(f"{C.HALF_SPACE}{{2,}}")


def presentation_map() -> dict[str, str]:
    """Every presentation form and what it stands for, derived from the Unicode tables."""
    return {chr(c): unicodedata.normalize("NFKC", chr(c)) for a, b in C.PRESENTATION for c in range(a, b + 1)}


def persian_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", C.PERSIAN_DIGITS)


def deletes(word: Column) -> Column:
    """All distinct strings with one character less."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1))))


#: Powers of a number by which strings are hashed, and its reciprocal, modulo 2 to the 64th.
BASE, LESS = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def key_hashes(words: list[str], *, deletes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and, with ``deletes``, of its strings with one character less; first the number of the word that each is of.

    Equal strings have equal hashes: the sum of code points times powers of a base, modulo 2 to the 64th. So that of a
    string with one character less is a sum up to that character and one behind it, and no such string is made.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    of, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        codes = np.frombuffer("".join([words[k] for k in at]).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, n)
        powers = np.cumprod(np.full(n, BASE, np.uint64))
        ahead = np.cumsum(codes * powers, axis=1)
        of.append(at)
        hashes.append(ahead[:, -1])
        if not deletes:
            continue
        moved = np.cumsum((codes * (powers * np.uint64(LESS)))[:, ::-1], axis=1)[:, ::-1]
        less = np.hstack([np.zeros((len(at), 1), np.uint64), ahead[:, :-1]]) + np.hstack([moved[:, 1:], np.zeros((len(at), 1), np.uint64)])
        of.append(np.repeat(at, n))
        hashes.append(less.ravel())
    return np.concatenate(of), np.concatenate(hashes)


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the longest common prefix."""
    places = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)) + 1)
    unequal = F.filter(places, lambda i: (i > F.least(F.length(a), F.length(b))) | (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.get(unequal, F.lit(0)) - 1


def is_one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion, replacement or swap of neighbours apart."""
    p = common_prefix(a, b)
    swapped = F.concat(F.left(a, p), F.substr(a, p + 2, F.lit(1)), F.substr(a, p + 1, F.lit(1)), F.substr(a, p + 3))
    return (F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & (a != b) & (p + 2 <= F.length(a)) & (swapped == b))


def is_inflection(word: Column, other: Column) -> Column:
    """Whether the one edit between two words looks like ordinary inflection or spacing."""
    no_gap = lambda w: F.replace(w, F.lit(C.HALF_SPACE), F.lit(""))
    p = common_prefix(word, other)
    longer = F.when(F.length(word) >= F.length(other), word).otherwise(other)
    extra, last, first = F.substr(longer, p + 1, F.lit(1)), p + 1 == F.length(longer), p == 0
    here, there = F.substr(word, p + 1, F.lit(1)), F.substr(other, p + 1, F.lit(1))
    one_of = lambda c, letters: c.isin(*letters)
    respelt = (word.contains(C.HALF_SPACE) | other.contains(C.HALF_SPACE)) & (no_gap(word) == no_gap(other))
    replaced = (last & one_of(here, C.ENDING_LETTERS) & one_of(there, C.ENDING_LETTERS)) | (first & one_of(here, C.LEADING_LETTERS) & one_of(there, C.LEADING_LETTERS))
    added = (extra == C.HALF_SPACE) | (last & one_of(extra, C.ENDING_LETTERS)) | (first & one_of(extra, C.LEADING_LETTERS))
    return respelt | ((F.levenshtein(word, other) == 1) & F.when(F.length(word) == F.length(other), replaced).otherwise(added))


def plain_context(text: Column, offset: Column, length: Column, width: int = 50) -> Column:
    """The match between brackets with ``width`` code points on either side."""
    start = F.greatest(F.lit(0), offset - width)
    return F.concat(F.substr(text, start + 1, offset - start), F.lit("⟦"), F.substr(text, offset + 1, length), F.lit("⟧"), F.substr(text, offset + length + 1, F.lit(width)))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


# How half-spaces and spaces are shown in reports.
SHOWN_HALF_SPACE = '<span class="zw" title="نیم‌فاصله"></span>'
SHOWN_SPACE = '<span class="sp" title="فاصله"></span>'


def show_spaces(text: Column) -> Column:
    """Escaped for HTML, with half-spaces and plain spaces made visible."""
    marked = F.translate(escape_html(text), f" \u00a0{C.HALF_SPACE}", "\u0001\u0001\u0002")
    return F.replace(F.replace(marked, F.lit("\u0001"), F.lit(SHOWN_SPACE)), F.lit("\u0002"), F.lit(SHOWN_HALF_SPACE))


def html_context(text: Column, offset: Column, length: Column, suggestion: Column, width: int = 70) -> Column:
    """As plain_context, in HTML, with the suggestion after the match and dots where text is cut."""
    start, end = F.greatest(F.lit(0), offset - width), offset + length + width
    return F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")), escape_html(F.substr(text, start + 1, offset - start)),
        F.when(length > 0, F.concat(F.lit("<mark>"), show_spaces(F.substr(text, offset + 1, length)), F.lit("</mark>"))).otherwise(F.lit("")),
        F.lit("<ins>"), F.when(suggestion == "", F.lit("∅")).otherwise(show_spaces(suggestion)), F.lit("</ins>"),
        escape_html(F.substr(text, offset + length + 1, F.lit(width))), F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")))
