"""The typography rules: hit counts and safe fixes as Spark expressions, and all hits of a block with their overlaps.

Rules have an order, which is their priority. Four of them replace single characters one by one; they never compete
with others for a place, and later rules see their results. A hit of any other rule is dropped if it overlaps one of
an earlier rule.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import chars as C
from ..functions import text as T


@dataclass(frozen=True)
class Rule:
    """``pattern`` and ``put`` in Java's notation; ``when`` names a further condition on the place of a match."""

    id: str
    pattern: str
    put: str
    severity: str
    category: str
    message_fa: str
    message_en: str
    when: str = ""


_Z = r"\x{200C}"
_L, _NOT_BEFORE, _NOT_AFTER, _S = C.LETTER, C.EDGE_BEFORE, C.EDGE_AFTER, C.SPACE

# Identifiers, patterns, replacements, severities, categories and messages, in order of priority.
RULES = [
    Rule("bom", r"\x{FEFF}", "", "safe", "typography", "نویسه‌ی نامرئی BOM", "Stray byte-order mark"),
    Rule("presentation_forms", f"[{C.members(C.PRESENTATION)}]+", "NFKC", "safe", "typography", "حروف نمایشی (Presentation Forms) به‌جای حروف استاندارد", "Arabic presentation-form characters instead of standard letters"),
    Rule("arabic_yeh", r"[\x{064A}\x{0649}]", "ی", "safe", "typography", "«ي» عربی به‌جای «ی» فارسی", "Arabic yeh instead of Persian yeh"),
    Rule("arabic_kaf", r"\x{0643}", "ک", "safe", "typography", "«ك» عربی به‌جای «ک» فارسی", "Arabic kaf instead of Persian kaf"),
    Rule("other_heh", r"[\x{06BE}\x{06D5}]", "ه", "safe", "typography", "نویسه‌ی «ه» نادرست", "Wrong heh code point"),
    Rule("arabic_digits", r"[\x{0660}-\x{0669}]", "DIGITS", "safe", "typography", "رقم عربی به‌جای رقم فارسی", "Arabic-Indic digit instead of Persian digit"),
    Rule("latin_comma", f"(?<={_L}){_S}*,", "،", "safe", "typography", "ویرگول لاتین به‌جای «،»", "Latin comma after Persian word"),
    Rule("latin_question", f"(?<={_L}){_S}*\\?", "؟", "safe", "typography", "علامت سؤال لاتین به‌جای «؟»", "Latin question mark after Persian word"),
    Rule("latin_semicolon", f"(?<={_L}){_S}*;", "؛", "safe", "typography", "نقطه‌ویرگول لاتین به‌جای «؛»", "Latin semicolon after Persian word"),
    Rule("space_before_punct", f"(?<={_L}){_S}+(?=[\\x{{060C}}\\x{{061B}}\\x{{061F}}!:]|\\.(?!\\.))", "", "safe", "typography", "فاصله‌ی اضافه پیش از نشانه‌ی سجاوندی", "Space before punctuation"),
    Rule("space_after_punct", f"([\\x{{060C}}\\x{{061B}}\\x{{061F}}!])(?={_L})", "$1 ", "safe", "typography", "نبودِ فاصله پس از نشانه‌ی سجاوندی", "Missing space after punctuation"),
    Rule("zwnj_duplicate", _Z + "{2,}", C.HALF_SPACE, "safe", "typography", "نیم‌فاصله‌ی تکراری", "Repeated ZWNJ"),
    Rule("zwnj_dangling", f"{_Z}+(?!{_L})|(?<!{_L}){_Z}+", "", "safe", "typography", "نیم‌فاصله‌ی بی‌جا (کنار فاصله یا نشانه)", "ZWNJ next to a space or punctuation"),
    Rule("zwnj_mi", f"{_NOT_BEFORE}(ن?می){_S}(?={_L}+[میدت]{_NOT_AFTER})", "$1" + C.HALF_SPACE, "safe", "typography", "«می/نمی» باید با نیم‌فاصله به فعل بچسبد", "Verb prefix می/نمی needs a ZWNJ, not a space"),
    Rule("zwnj_ha", f"(?<={_L}){_S}(ها|های|هایی|هایم|هایت|هایش|هایمان|هایتان|هایشان){_NOT_AFTER}", C.HALF_SPACE + "$1", "safe", "typography", "پسوند جمع «ها» باید با نیم‌فاصله بچسبد", "Plural suffix ها needs a ZWNJ, not a space"),
    Rule("zwnj_mi_other", f"{_NOT_BEFORE}(ن?می){_S}(?={_L}{{2,}})", "$1" + C.HALF_SPACE, "review", "typography", "احتمالاً «می» پیشوند فعل است و نیم‌فاصله می‌خواهد (اگر «می» به معنای شراب نیست)", "Probably verb prefix می needing ZWNJ (unless it means 'wine')"),
    Rule("zwnj_tar", f"(?<={_L}){_S}(تر|ترین){_NOT_AFTER}", C.HALF_SPACE + "$1", "review", "typography", "پسوند «تر/ترین» معمولاً با نیم‌فاصله می‌آید (مگر «تر» به معنای خیس)", "Comparative تر/ترین usually takes a ZWNJ (unless تر means 'wet')"),
    Rule("zwnj_after_heh", f"(?<={_L}ه){_S}(ام|ای|ایم|اید|اند){_NOT_AFTER}", C.HALF_SPACE + "$1", "review", "typography", "پس از «ه» پایانی، «ام/ای/اند…» با نیم‌فاصله می‌آید", "After final ه, the clitic ام/ای/اند takes a ZWNJ"),
    Rule("repeated_word", f"{_NOT_BEFORE}(از|به|در|که|را|با|این|آن|تا|برای|یک){_S}+\\1{_NOT_AFTER}", "$1", "review", "grammar", "واژه‌ی تکراری", "Repeated word"),
    Rule("period_no_space", f"(?<={_L})\\.(?={_L})", ". ", "review", "typography", "نبودِ فاصله پس از نقطه (مگر در اختصار)", "Missing space after full stop (unless abbreviation)"),
    Rule("tatweel", r"\x{0640}+", "", "review", "typography", "کشیده (ـ) در متن", "Tatweel/kashida in running text"),
    Rule("latin_digits", "[0-9]+", "DIGITS", "style", "style", "رقم لاتین در متن فارسی", "Latin digits in Persian text", when="persian_near"),
    Rule("latin_quotes", '"([^"\\n]{1,300})"', "«$1»", "style", "style", "گیومه‌ی لاتین به‌جای «»", "Latin quotes around Persian text", when="persian_inside"),
]
ONE_TO_ONE = ("arabic_yeh", "arabic_kaf", "other_heh", "arabic_digits")
SAFE = [r for r in RULES if r.severity == "safe"]
BY_ID = {r.id: r for r in RULES}


# ---- as Spark expressions -------------------------------------------------------------------------------------

#: Matches that are folded at once; each fold copies its own array, so this bounds what is copied for a match.
FOLDED = 64


def spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern that is never empty: array of (off, len, orig), without a Python function.

    Matches and the gaps between them alternate, so a running sum of their lengths gives the offsets. It runs over
    FOLDED matches at a time, from where a first sum over such stretches says that they begin.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, F.lit(pattern), -1)
    length = lambda p: F.length(p["g"]) + F.length(p["m"])

    def told(pieces: Column) -> Column:
        stretches = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.greatest(F.size(pieces) - 1, F.lit(0)), F.lit(FOLDED))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(stretches, lambda at: F.aggregate(F.slice(pieces, at + 1, F.lit(FOLDED)), F.lit(0), lambda n, p: n + length(p)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return T.let(starts, lambda begins: F.flatten(F.transform(stretches, lambda at, k: one(F.slice(pieces, at + 1, F.lit(FOLDED)), F.get(begins, k)))))

    def one(pieces: Column, start: Column) -> Column:
        empty = F.array().cast("array<struct<off:int,len:int,orig:string>>")
        return F.aggregate(
            pieces, F.struct(start.alias("at"), empty.alias("hits")),
            lambda acc, p: F.struct((acc["at"] + length(p)).alias("at"), F.concat(acc["hits"], F.array(F.struct((acc["at"] + F.length(p["g"])).alias("off"), F.length(p["m"]).alias("len"), p["m"].alias("orig")))).alias("hits")))["hits"]

    # the gap after the last match has none, and is left out
    return T.let(F.filter(F.arrays_zip(found.alias("m"), gaps.alias("g")), lambda p: p["m"].isNotNull()), told)


def hit_count(text: Column, rule: Rule) -> Column:
    """How often a rule's pattern and condition hold in a text, overlaps with other rules aside."""
    if not rule.when:
        return T.count_of(text, rule.pattern)
    hits = spans(text, rule.pattern)
    latin = "[A-Za-z]"

    def holds(hit: Column) -> Column:
        if rule.when == "persian_inside":
            return hit["orig"].rlike(C.LETTER) & ~hit["orig"].rlike(latin)
        before = F.substr(text, F.greatest(hit["off"] - 1, F.lit(1)), F.least(hit["off"], F.lit(2)))
        after = F.substr(text, hit["off"] + hit["len"] + 1, F.lit(2))
        beside = F.concat(before, F.lit(" "), after)
        return beside.rlike(C.LETTER) & ~beside.rlike(latin)

    return F.size(F.filter(hits, holds))


def apply_rule(text: Column, rule: Rule) -> Column:
    if rule.put == "DIGITS":
        source = C.ARABIC_DIGITS if rule.id == "arabic_digits" else "0123456789"
        return F.translate(text, source, C.PERSIAN_DIGITS)
    if rule.put == "NFKC":
        return compose_forms(text)
    return F.regexp_replace(text, F.lit(rule.pattern), F.lit(rule.put))


@F.pandas_udf(StringType())
def _composed_forms(texts: pd.Series) -> pd.Series:
    table = str.maketrans(T.presentation_map())
    return texts.map(lambda t: None if t is None else t.translate(table))


def compose_forms(text: Column) -> Column:
    """Presentation forms as ordinary letters; only texts that hold any go through Python."""
    return F.when(text.rlike(BY_ID["presentation_forms"].pattern), _composed_forms(text)).otherwise(text)


def _changing_forms() -> str:
    """Runs of presentation forms that composing changes."""
    same = [c for c, put in T.presentation_map().items() if c == put]
    ranges: list[list[int]] = []
    for c in map(ord, same):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    inert = C.members([tuple(r) for r in ranges])
    every = C.members(C.PRESENTATION)
    return f"[{inert}]*[{every}&&[^{inert}]][{every}]*"


def apply_safe(blocks: DataFrame, text: str = "t") -> DataFrame:
    """``blocks`` with ``fixed`` (the text after all safe rules, one after another) and ``fixes`` (rule to count).

    A rule counts what it changes, on the text its predecessors left. Blocks that typography leaves alone stay.
    """
    keep, out = blocks.columns, blocks.withColumn("__ok", T.gated(F.col(text))).withColumn("__t0", F.col(text))
    counts = []
    for n, rule in enumerate(SAFE, 1):
        pattern = _changing_forms() if rule.put == "NFKC" else rule.pattern
        out = out.withColumn(f"__n{n}", F.when(F.col("__ok"), T.count_of(F.col(f"__t{n - 1}"), pattern)).otherwise(0))
        out = out.withColumn(f"__t{n}", F.when(F.col("__ok"), apply_rule(F.col(f"__t{n - 1}"), rule)).otherwise(F.col(f"__t{n - 1}")))
        counts += [F.lit(rule.id), F.col(f"__n{n}").cast("bigint")]
    return out.select(*keep, F.col(f"__t{len(SAFE)}").alias("fixed"), F.map_filter(F.create_map(*counts), lambda _, n: n > 0).alias("fixes"))


# ---- all hits of a block --------------------------------------------------------------------------------------

def _python_form(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)


class Finder:
    """The rules compiled for Python; a place that is taken is marked in a bytearray, one byte for each code point."""

    def __init__(self) -> None:
        one_to_one = [BY_ID[k] for k in ONE_TO_ONE]
        self.table = str.maketrans({**C.TO_PERSIAN, **dict(zip(C.ARABIC_DIGITS, C.PERSIAN_DIGITS))})
        self.single = re.compile("|".join(f"(?P<{r.id}>{_python_form(r.pattern)})" for r in one_to_one))
        self.first = [(r, re.compile(_python_form(r.pattern))) for r in RULES[:2]]
        self.rest = [(r, re.compile(_python_form(r.pattern)), re.sub(r"\$(\d)", r"\\\1", r.put)) for r in RULES[2:] if r.id not in ONE_TO_ONE]
        self.order = {r.id: n for n, r in enumerate(RULES)}
        self.letters, self.marks = (re.compile(f"[{C.plain(x)}]") for x in (C.LETTERS, C.MARKS))
        self.latin = re.compile("[A-Za-z]")
        self.digits = str.maketrans("0123456789", C.PERSIAN_DIGITS)

    def gated(self, text: str) -> bool:
        if not self.letters.search(text) or text.count(C.TEH_MARBUTA) >= T.GATE_TEH_MARBUTA:
            return False
        # letters are counted only in a text that has marks
        return not self.marks.search(text) or len(self.marks.findall(text)) / len(self.letters.findall(text)) <= T.GATE_MARKS_PERCENT / 100

    def _holds(self, rule: Rule, text: str, m: re.Match) -> bool:
        beside = text[max(0, m.start() - 2):m.start()] + " " + text[m.end():m.end() + 2] if rule.when == "persian_near" else m[1]
        return bool(self.letters.search(beside)) and not self.latin.search(beside)

    def hits(self, text: str | None) -> list[tuple[int, int, str, str, str]]:
        """(off, len, orig, sugg, rule) by offset, and by priority at the same one."""
        if not text or not self.gated(text):
            return []
        found: list[tuple[int, int, str, str, str]] = []
        taken = bytearray(len(text))

        def take(s: int, e: int, put: str, seen: str, rule: str) -> None:
            if put != seen and not any(taken[s:e]):
                taken[s:e] = b"\1" * (e - s)
                found.append((s, e - s, text[s:e], put, rule))

        for rule, pattern in self.first:
            for m in pattern.finditer(text):
                take(*m.span(), unicodedata.normalize("NFKC", m[0]) if rule.put == "NFKC" else rule.put, m[0], rule.id)
        found += [(m.start(), 1, m[0], m[0].translate(self.table), m.lastgroup) for m in self.single.finditer(text)]
        work = text.translate(self.table)
        for rule, pattern, put in self.rest:
            for m in pattern.finditer(work):
                if not rule.when or self._holds(rule, work, m):
                    take(*m.span(), m[0].translate(self.digits) if put == "DIGITS" else m.expand(put), m[0], rule.id)
        return sorted(found, key=lambda h: (h[0], self.order[h[4]]))


HIT = "off int, len int, orig string, sugg string, rule string"


def find_issues(blocks: DataFrame, text: str = "t") -> DataFrame:
    """One row for each hit: the block's other columns, off, len, orig, sugg, rule, severity, category.

    The gate is a Spark filter, so blocks without Persian never reach Python; what does goes there in batches of Arrow
    columns, and hits come back so. Blocks are independent: no shuffle, no state.
    """
    keep = [c for c in blocks.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            of, columns = [], ([], [], [], [], [])
            for row, t in enumerate(batch.column(len(keep)).to_pylist()):
                hits = finder.hits(t)
                of += [row] * len(hits)
                for column, values in zip(columns, zip(*hits)):
                    column += values
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.select(range(len(keep))).take(pa.array(of, pa.int64())).columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*keep, "off", "len", "orig", "sugg", "rule"])

    schema = StructType([*[blocks.schema[c] for c in keep], *_parse(HIT)])
    hits = blocks.where(T.gated(F.col(text))).select(*keep, text).mapInArrow(run, schema)
    severity = F.create_map(*[F.lit(x) for r in RULES for x in (r.id, r.severity)])
    category = F.create_map(*[F.lit(x) for r in RULES for x in (r.id, r.category)])
    return hits.withColumn("severity", severity[F.col("rule")]).withColumn("category", category[F.col("rule")])


def _parse(ddl: str) -> list[StructField]:
    kinds = {"int": IntegerType(), "string": StringType()}
    return [StructField(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))]


def priority(rule: Column) -> Column:
    """A rule's place in order; what comes first of several hits of one place."""
    return F.create_map(*[F.lit(x) for n, r in enumerate(RULES) for x in (r.id, n)])[rule].cast("bigint")


def messages(issues: DataFrame) -> DataFrame:
    """Rule hits with their messages in Persian and English."""
    fa = F.create_map(*[F.lit(x) for r in RULES for x in (r.id, r.message_fa)])
    en = F.create_map(*[F.lit(x) for r in RULES for x in (r.id, r.message_en)])
    return issues.withColumn("msg_fa", fa[F.col("rule")]).withColumn("msg_en", en[F.col("rule")])
