"""Queries that SQL has no words for, over the books made up from pages, against plain loops over the same pages."""

import json
import re

import pytest
from conftest import SMALL

from sardabir.operators import markup, review
from sardabir.plans import catalog
from sardabir.sources import blocks


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", catalog.persian_markup(F.col("html")).alias("html")).collect()
    return {r["page_id"]: r["html"] for r in rows}


def of_books(pages):
    """rel, and (file, html) in reading order, of all readable books."""
    books = {}
    for k in sorted(pages):
        books.setdefault(k // 5, []).append(pages[k])
    return {f"shelf/{n}.epub": [(f"OPS/Text/{k} a.XHTML", docs[k]) for k in reversed(range(len(docs)))] for n, docs in books.items() if n % 11}


def test_book_blocks(spark, pages):
    import hashlib

    want = [(hashlib.sha1(rel.encode()).hexdigest()[:12], file, at, i, a or "", t) for rel, docs in of_books(pages).items() for at, (file, html) in enumerate(docs) for i, (a, t) in enumerate(blocks.read_blocks(html))]
    got = [(r["book"], r["file"], r["file_pos"], r["i"], r["anchor"] or "", r["t"]) for r in catalog.QUERIES["book_blocks"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def summed(documents):
    counts, fixer = {}, markup.Fixer()
    for key, html in documents:
        for rule, n in fixer.markup(html)[1].items():
            counts[key, rule] = counts.get((key, rule), 0) + n
    return counts


def test_fixes_of_pages_and_books(spark, pages):
    by_page = summed(pages.items())
    assert {(r["page_id"], r["rule"]): r["n"] for r in catalog.QUERIES["fix_counts"](spark, SMALL).collect()} == by_page and by_page
    in_books = summed((rel, html) for rel, docs in of_books(pages).items() for _, html in docs)
    assert {(r["rel"], r["rule"]): r["n"] for r in catalog.QUERIES["fix_epub"](spark, SMALL).collect()} == in_books


def test_pilot(spark):
    asked = {r["cid"]: r["params"] for r in catalog.requests(spark, SMALL).select("cid", "params").collect()}
    got = {r["cid"]: (r["text"], r["error"]) for r in catalog.QUERIES["llm_pilot"](spark, SMALL).collect()}
    assert got == {cid: (review.offline_reviewer(params), None) for cid, params in asked.items()}
    assert all(json.loads(text)["issues"] for text, _ in got.values())


def test_pages_of_the_report(spark):
    found = [r.asDict() for r in catalog.QUERIES["rules_find_issues"](spark, SMALL).collect()]
    got = {r["book"]: r["html"] for r in catalog.QUERIES["report_book_page"](spark, SMALL).collect()}
    assert set(got) >= {r["book"] for r in found}
    for book, html in got.items():
        mine = [r for r in found if r["book"] == book]
        kinds = [r["category"] for r in mine if r["severity"] != "safe"]
        assert sorted(re.findall('<article data-kind="([a-z]+)">', html)) == sorted(kinds)
        safe = {r["rule"] for r in mine if r["severity"] == "safe"}
        assert html.count("<details>") == len(safe) and html.count("<button") == 1 + len(set(kinds)) if kinds else "<button" not in html
        places = [tuple(map(int, m)) for m in re.findall(r'<bdi dir="ltr">(\d+) ¶(\d+)</bdi>', html)]
        assert places == sorted(places)


def test_index_of_the_report(spark):
    html = catalog.QUERIES["report_index"](spark, SMALL).first()["html"]
    density = {r["book"]: r["density"] for r in catalog.QUERIES["book_density"](spark, SMALL).collect()}
    names = re.findall(r'href="books/(.+?)\.html"', html)
    assert names == sorted(density, key=lambda b: (-density[b], b)) and "shelf/0.epub" in html.split("</table>")[1]
