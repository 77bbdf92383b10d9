"""Books in ePub files: listing, opening, spine order and blocks."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import extract_blocks
from .lists import book_id, title_or_stem

OPENED = "rel string, size bigint, mtime bigint, title string, spine array<string>, docs array<string>, error string"


class Unreadable(Exception):
    """A book that cannot be opened; the reason becomes the row's ``error``."""


@dataclass
class Book:
    title: str = ""
    spine: list[str] = field(default_factory=list)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2].lower()


class _Tags(HTMLParser):
    """The tags of damaged XML as a flat tree: attributes and the text that follows each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ElementTree.Element("damaged")
        self.prefixes: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.prefixes |= {k[6:]: v or "" for k, v in attrs if k.startswith("xmlns:")}
        prefix, _, name = tag.rpartition(":")
        ElementTree.SubElement(self.root, f"{{{self.prefixes.get(prefix, prefix)}}}{name}" if prefix else name, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if len(self.root):
            self.root[-1].text = (self.root[-1].text or "") + data


def _xml(data: bytes, what: str) -> ElementTree.Element:
    """The tree of a container or package file; of a damaged one, its tags as far as they can be read."""
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        reader = _Tags()
        reader.feed(data.decode("utf-8", "replace"))
        reader.close()
        if not len(reader.root):
            raise Unreadable(f"unreadable {what}: {e}") from e
        return reader.root


def open_book(content: bytes) -> tuple[Book, zipfile.ZipFile]:
    """Title and documents in reading order, by the container and package files."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unreadable(f"not a zip file: {e}") from e
    names = book.namelist()
    by_lower = {n.lower(): n for n in names}
    known = lambda name: name if name in names else by_lower.get(name.lower())
    container = known("META-INF/container.xml")
    if not container:
        raise Unreadable("no META-INF/container.xml")
    roots = [e.get("full-path") for e in _xml(book.read(container), "container.xml").iter() if _local(e) == "rootfile" and e.get("full-path")]
    if not roots:
        raise Unreadable("no rootfile in container.xml")
    package_name = known(roots[0])
    if not package_name:
        raise Unreadable(f"no package file {roots[0]}")
    package, base = _xml(book.read(package_name), "package file"), posixpath.dirname(package_name)
    titles = [e.text or "" for e in package.iter() if e.tag.endswith("}title") and "purl.org/dc" in e.tag]
    manifest, order = {}, []
    for e in package.iter():
        if _local(e) == "item" and e.get("id") and e.get("href"):
            path = posixpath.normpath(posixpath.join(base, unquote(e.get("href").partition("#")[0])))
            manifest[e.get("id")] = (path, e.get("media-type") or "")
        elif _local(e) == "itemref" and e.get("idref"):
            order.append(e.get("idref"))
    out = Book(titles[0].strip() if titles else "")
    for path, media in (manifest[i] for i in order if i in manifest):
        name = known(path) if "html" in media or path.lower().endswith((".xhtml", ".html", ".htm")) else None
        if name and name not in out.spine:
            out.spine.append(name)
    return out, book


def find_files(spark: SparkSession, root: str) -> DataFrame:
    """path, rel, size and mtime of all ePub files below ``root``, by Spark's own file source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(root)
    # the paths come with their scheme, however the root was given
    base = F.lit("/" + root.partition("://")[2].partition("/")[2].strip("/") if "://" in root else "/" + root.strip("/"))
    return files.select("path", F.substr("path", F.instr("path", base) + F.length(base) + 1).alias("rel"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "content")


def open_books(files: DataFrame) -> DataFrame:
    """A row per file: rel, size, mtime, title, spine, docs (the spine's documents as text) and error.

    Any failure is that book's alone. A document that isn't UTF-8 is read with replacement characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel, size, mtime, content in zip(*(batch.column(c).to_pylist() for c in range(4))):
                title, spine, docs, error = None, None, None, None
                try:
                    book, archive = open_book(content)
                    title, spine = book.title, book.spine
                    docs = [archive.read(name).decode("utf-8", "replace") for name in spine]
                except Exception as e:  # noqa: BLE001
                    title, spine, docs, error = None, None, None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
                    (rel, pa.string()), (size, pa.int64()), (mtime, pa.int64()), (title, pa.string()), (spine, pa.list_(pa.string())), (docs, pa.list_(pa.string())), (error, pa.string()))], names=["rel", "size", "mtime", "title", "spine", "docs", "error"])

    return files.select("rel", "size", "mtime", "content").mapInArrow(run, OPENED)


def books_table(opened: DataFrame) -> DataFrame:
    return opened.select(book_id(F.col("rel")).alias("id"), "rel", "size", "mtime", title_or_stem(F.col("title"), F.col("rel")).alias("title"), "spine", "error")


def book_blocks(opened: DataFrame) -> DataFrame:
    """book, file, file_pos, i, anchor, t of all readable books, in reading order by (file_pos, i)."""
    files = opened.where("error IS NULL").select(book_id(F.col("rel")).alias("book"), F.posexplode(F.arrays_zip("spine", "docs")).alias("file_pos", "d"))
    return extract_blocks(files.select("book", F.col("d.spine").alias("file"), "file_pos", F.col("d.docs").alias("html")))
