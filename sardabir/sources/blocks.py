"""Text blocks of XHTML and HTML documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import chars as C

# Elements that begin and end blocks, and those whose content is no text.
BLOCK_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote td th dt dd figcaption caption pre div section article aside header footer body table tr ul ol dl hr figure nav main".split())
SKIP_TAGS = frozenset("head script style svg math rt rp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WHITE = re.compile(f"[{C.plain(C.WHITE)}]+")


class _Reader(HTMLParser):
    """Collects (anchor, text) of blocks. Entities are always resolved; markup that isn't well-formed is read as it comes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str | None, str]] = []
        self.open: list[str] = []
        self.parts: list[str] = []
        self.anchor: str | None = None
        self.skipped = 0

    def _flush(self) -> None:
        text = _WHITE.sub(" ", "".join(self.parts)).strip(" ")
        if text:
            self.blocks.append((self.anchor, text))
        self.parts, self.anchor = [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        tag = tag.rpartition(":")[2]
        if self.skipped:
            self.skipped += tag not in _VOID
            return
        if tag in SKIP_TAGS:
            self.skipped = 1
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd") and tag in self.open:
            self._close(tag, stop=("ul", "ol", "dl", "table", "div", "blockquote", "section"))
        if tag in BLOCK_TAGS:
            self._flush()
            self.anchor = dict(attrs).get("id")
        elif tag == "br":
            self.parts.append(" ")
        if tag == "hr":
            self._flush()
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag.rpartition(":")[2] not in _VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str, stop: tuple = ()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] in stop:
                return
            if self.open[k] == tag:
                for ended in reversed(self.open[k:]):
                    if ended in BLOCK_TAGS:
                        self._flush()
                del self.open[k:]
                return

    def handle_endtag(self, tag: str) -> None:
        tag = tag.rpartition(":")[2]
        if self.skipped:
            self.skipped -= tag not in _VOID
        else:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)


def read_blocks(source: str | None) -> list[tuple[str | None, str]]:
    """(anchor, text) of a document's blocks in order; of what can't be read, none."""
    if not source:
        return []
    body = re.search(r"<body\b", source, re.I)
    reader = _Reader()
    reader.feed(re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: m[1].replace("&", "&amp;").replace("<", "&lt;"), source[body.start():] if body else source, flags=re.S))
    reader.close()
    reader._flush()
    return reader.blocks


def extract_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each block: the document's other columns, i, anchor and t. Streams; a document is the unit of work."""
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, places, anchors, texts = [], [], [], []
            for row, source in enumerate(batch.column(batch.schema.get_field_index(html)).to_pylist()):
                for i, (anchor, text) in enumerate(read_blocks(source)):
                    of.append(row)
                    places.append(i)
                    anchors.append(anchor)
                    texts.append(text)
            taken = batch.select(keep).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(places, pa.int32()), pa.array(anchors, pa.string()), pa.array(texts, pa.string())], names=[*keep, "i", "anchor", "t"])

    schema = StructType([*[pages.schema[c] for c in keep], StructField("i", IntegerType()), StructField("anchor", StringType()), StructField("t", StringType())])
    return pages.mapInArrow(run, schema)

