"""Safe fixes written into markup and ePub files; tags, comments and untouchable elements stay byte for byte."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars as C
from .typography import SAFE, Finder, _python_form

# Elements whose text is never changed, and what counts as markup and as an element's name.
UNTOUCHED = frozenset("script style head rt rp svg math code pre".split())
MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<[^>]+>", re.S)
NAME = re.compile(r"<\s*(/?)\s*([A-Za-z][\w:.\-]*)")


class Fixer:
    """The safe rules for one text at a time."""

    def __init__(self) -> None:
        self.finder = Finder()
        self.rules = [(r, re.compile(_python_form(r.pattern)), re.sub(r"\$(\d)", r"\\\1", r.put)) for r in SAFE]
        self.digits = str.maketrans(C.ARABIC_DIGITS, C.PERSIAN_DIGITS)

    def text(self, text: str, counts: Counter) -> str:
        """``text`` after all rules in turn; ``counts`` gains what each changed."""
        if not self.finder.gated(text):
            return text
        for rule, pattern, put in self.rules:
            def swap(m: re.Match) -> str:
                new = unicodedata.normalize("NFKC", m[0]) if put == "NFKC" else m[0].translate(self.digits) if put == "DIGITS" else m.expand(put)
                counts[rule.id] += new != m[0]
                return new

            text = pattern.sub(swap, text)
        return text

    def markup(self, source: str) -> tuple[str, dict[str, int]]:
        """The document with its text between tags fixed, and the number of changes by rule."""
        out, counts, depth, at = [], Counter(), 0, 0
        for tag in [*MARKUP.finditer(source), None]:
            text = source[at:tag.start() if tag else len(source)]
            out.append(self.text(text, counts) if depth == 0 and not text.isspace() and text else text)
            if tag:
                out.append(tag[0])
                at = tag.end()
                name = NAME.match(tag[0])
                if name and name[2].rpartition(":")[2].lower() in UNTOUCHED and not tag[0].rstrip().endswith("/>"):
                    depth = max(0, depth + (-1 if name[1] else 1))
        return "".join(out), {k: n for k, n in counts.items() if n}

    def book(self, content: bytes, spine: list[str]) -> tuple[bytes, dict[str, int]]:
        """A corrected copy of an ePub, and the number of changes by rule.

        The format asks for ``mimetype`` to come first, without compression. Other entries keep name, time, attributes
        and way of compression; of those in ``spine``, the ones that are UTF-8 text get fixed.
        """
        counts: Counter = Counter()
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            entries = {e.filename: (e, book.read(e)) for e in book.infolist()}
        for name in set(spine) & entries.keys():
            entry, data = entries[name]
            try:
                text, changed = self.markup(data.decode("utf-8"))
            except UnicodeDecodeError:
                continue  # its bytes go over as they are
            counts.update(changed)
            entries[name] = entry, text.encode("utf-8")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as book:
            for name in [*(n for n in ("mimetype",) if n in entries), *(n for n in entries if n != "mimetype")]:
                entry, data = entries[name]
                told = zipfile.ZipInfo(name, entry.date_time)
                told.external_attr, told.compress_type = entry.external_attr, entry.compress_type if name != "mimetype" else zipfile.ZIP_STORED
                book.writestr(told, data)
        return out.getvalue(), dict(counts)


def fix_markup(pages: DataFrame, html: str = "html") -> DataFrame:
    """The documents' other columns with ``fixed`` and ``fixes`` (rule to count)."""
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixer = Fixer()
        for batch in batches:
            got = [(None, {}) if s is None else fixer.markup(s) for s in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array([t for t, _ in got], pa.string()), pa.array([list(n.items()) for _, n in got], pa.map_(pa.string(), pa.int64()))], names=[*keep, "fixed", "fixes"])

    from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

    schema = StructType([*[pages.schema[c] for c in keep], StructField("fixed", StringType()), StructField("fixes", MapType(StringType(), LongType()))])
    return pages.mapInArrow(run, schema)


def fix_books(files: DataFrame, spines: DataFrame) -> DataFrame:
    """rel, content (the corrected copy), fixes and error; ``files`` has rel and content, ``spines`` rel and spine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixer = Fixer()
        for batch in batches:
            for rel, content, spine in zip(*(batch.column(c).to_pylist() for c in range(3))):
                try:
                    new, counts, error = *fixer.book(content, spine or []), None
                except Exception as e:  # noqa: BLE001
                    new, counts, error = None, {}, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([rel], pa.string()), pa.array([new], pa.binary()), pa.array([list(counts.items())], pa.map_(pa.string(), pa.int64())), pa.array([error], pa.string())], names=["rel", "content", "fixes", "error"])

    return files.select("rel", "content").join(spines.select("rel", "spine"), "rel").mapInArrow(run, "rel string, content binary, fixes map<string,bigint>, error string")


def fix_counts(fixed: DataFrame, by: str) -> DataFrame:
    """``by``, rule, n of what was changed."""
    return fixed.select(by, F.explode("fixes").alias("rule", "n")).groupBy(by, "rule").agg(F.sum("n").alias("n"))
