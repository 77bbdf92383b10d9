"""Operator 5: main text of web pages, by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is read into a tree of its block elements; inline elements belong to the block they stand in. Each node is
described by its tag, the tokens of its class, id and role, its depth, its siblings, and by densities of its subtree
(text, links, markup, sentences). Trees tell how likely a node holds main text. The decoding picks the likeliest
labelling in which whatever lies inside a rejected node is rejected, so an ancestor and a descendant never contradict
each other. The trees are trained on pages made up by a seeded generator, whose main text is known.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost
from .common import map_rows

MARK = re.compile(r"<[a-zA-Z/!?]")
#: A tag up to the first ``>`` outside quotes; nothing is tried twice.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Their content is no text of the page.
RAW = frozenset("script style noscript template svg math canvas iframe object head title textarea select option datalist video audio map".split())
#: What stands in these is no markup.
PLAIN = frozenset("script style title textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are nodes of the tree, by group.
GROUPS = {
    "root": "html body", "article": "article main", "part": "section div center", "text": "p blockquote pre address", "head": "h1 h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol dl menu", "item": "li dt dd", "table": "table thead tbody tfoot caption colgroup", "row": "tr", "cell": "td th",
    "figure": "figure figcaption details summary", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form fieldset button label legend",
}
GROUP_OF = {tag: i for i, tags in enumerate(GROUPS.values()) for tag in tags.split()}
NAMES = list(GROUPS)
#: A start of one of these ends an open paragraph.
ENDS_P = frozenset(tag for tag in GROUP_OF if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "button", "label", "caption", "colgroup", "summary", "legend", "html", "body"))
#: A start of the first ends an open one of the second, up to the elements after that.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Tokens of class, id or role, as they are usual.
AGAINST = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot bottom sidebar side aside rail widget widgets related recommended popular trending more share sharing social follow cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login form search comment comments discussion replies respond disqus reply tags pagination pager copyright legal toolbar skip contentinfo complementary dialog".split())
IN_FAVOUR = frozenset("article content main post body entry story text page-content prose markdown post-content article-body entry-content maincontent".split())
PARTS = re.compile(r"[A-Za-z]+")


def next_token(source: str, at: int) -> tuple[int, int, str, bool, str, bool] | None:
    """Start and end of the next markup, and of a tag its name, whether it is an end tag, its attributes, and whether it closes itself.

    Every character is looked at a bounded number of times, whatever the page says: a tag whose quotes never close ends
    at its first ``>``, and where no ``>`` follows, the last tag begun is left out.
    """
    m = MARK.search(source, at)
    if m is None:
        return None
    start = m.start()
    if source.startswith("<!--", start):
        end = source.find("-->", start + 4)
        return start, end + 3 if end >= 0 else len(source), "", False, "", False
    tag = TAG.match(source, start) or OPEN_TAG.match(source, start)
    if tag:
        attributes = tag[3]
        closed = attributes.endswith("/")
        return start, tag.end(), tag[2].lower(), bool(tag[1]), attributes[:-1] if closed else attributes, closed
    end = source.find(">", start)
    if end >= 0:
        return start, end + 1, "", False, "", False
    rest = source.find("<!--", start)
    if rest < 0:
        rest = source.rfind("<")
    return (rest, len(source), "", False, "", False) if MARK.match(source, rest) else None


def past_end(source: str, at: int, tag: str) -> int | None:
    """Where the page goes on after the end tag of an element of RAW whose content begins at ``at``; none if it never ends.

    In PLAIN elements any ``<`` is text, so the first end tag counts, found by plain search. Others hold markup, and an
    end tag in a script, comment or attribute in them is none of theirs.
    """
    first = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
    if first is None:
        return None
    if tag in PLAIN:
        return source.find(">", first.end()) + 1 or len(source)
    while token := next_token(source, at):
        _, at, inner, ends, _, closed = token
        if ends and inner == tag:
            return at
        if inner in PLAIN and not ends and not closed:
            at = past_end(source, at, inner) or at
    return None


class Page:
    """The block elements of a page, in order: a parent always comes before its children."""

    def __init__(self, source: str) -> None:
        self.parent: list[int] = [-1]
        self.group: list[int] = [0]
        self.tag: list[str] = ["html"]
        self.tokens: list[str] = [""]
        self.hidden: list[bool] = [False]
        self._parts: list[tuple[int, list[str]]] = []
        self.link: list[int] = [0]
        self.marks: list[int] = [0]
        self.breaks: list[int] = [0]
        self.inputs: list[int] = [0]
        self._read(source)
        #: (node, text) in page order; two entries of one node have another node's between them
        self.texts = [(node, "".join(parts)) for node, parts in self._parts]

    def _read(self, source: str) -> None:
        node, stack, at, linked, endless = 0, [0], 0, 0, set()
        opened: Counter[str] = Counter()  # how many elements of a name are on the stack, so that none is sought in vain

        def close(names: set[str], limit: set[str] = frozenset()) -> None:
            if not any(opened[n] for n in names):
                return
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name in limit:
                    return
                if name in names:
                    opened.subtract(self.tag[i] for i in stack[k:])
                    del stack[k:]
                    return

        while token := next_token(source, at):
            start, end, tag, ends, attributes, closed = token
            if start > at:
                self._text(node, source[at:start], linked)
            at = end
            if not tag:
                continue
            if tag in RAW:
                if not ends and not closed:
                    # an end tag that never comes would swallow the page; then only this tag is left out
                    end = None if tag in endless else past_end(source, at, tag)
                    if end is not None:
                        at = end
                    elif tag in ("script", "style", "svg", "template", "textarea"):
                        at = len(source)
                    else:
                        endless.add(tag)
                if tag in ("textarea", "select"):
                    self.inputs[node] += 1
                continue
            if tag == "a":
                linked = 0 if ends else 1
                self.marks[node] += 1
                continue
            if tag not in GROUP_OF:
                if tag == "br" or tag == "hr":
                    self.breaks[node] += 1
                    self._text(node, " ", 0)
                elif tag == "input":
                    self.inputs[node] += 1
                self.marks[node] += 1
                continue
            if tag in ("html", "body"):
                continue
            if ends:
                close({tag})
            else:
                if tag in ENDS_P:
                    close({"p"})
                if tag in SIBLINGS:
                    close(*SIBLINGS[tag])
                self._open(stack[-1], tag, attributes)
                if not closed:
                    stack.append(len(self.tag) - 1)
                    opened[tag] += 1
                linked = 0
            node = stack[-1]
        if at < len(source):
            self._text(node, source[at:], linked)

    def _open(self, parent: int, tag: str, attributes: str) -> None:
        self.parent.append(parent)
        self.group.append(GROUP_OF[tag])
        self.tag.append(tag)
        tokens, hidden = "", False
        if attributes and not attributes.isspace():
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                value = a or b or c
                name = name.lower()
                if name in ("class", "id", "role"):
                    tokens += " " + value
                else:
                    hidden |= name == "hidden" or "display:none" in value.replace(" ", "").lower()
        self.tokens.append(tokens)
        self.hidden.append(hidden)
        for counts in (self.link, self.marks, self.breaks, self.inputs):
            counts.append(0)

    def _text(self, node: int, text: str, linked: int) -> None:
        if self._parts and self._parts[-1][0] == node:
            self._parts[-1][1].append(text)
        else:
            self._parts.append((node, [text]))
        if linked:
            self.link[node] += len(text.strip())


@functools.lru_cache(maxsize=65_536)
def _votes(tokens: str) -> tuple[int, int]:
    words = [w.lower() for part in tokens.split() for w in {part, *PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", part))}]
    return sum(w in AGAINST for w in words), sum(w in IN_FAVOUR for w in words)


def describe(page: Page) -> np.ndarray:
    """Features of all nodes of a page."""
    n = len(page.parent)
    own, stops, size = [0] * n, [0] * n, [1] * n
    for node, text in page.texts:
        length = len(text) if not text.isspace() else 0
        own[node] += length
        if length:
            stops[node] += text.count(".") + text.count(",")
    total, links, marks, points, inputs, paragraphs = own[:], page.link[:], page.marks[:], stops[:], page.inputs[:], [int(g == 3) for g in page.group]
    children, first = [0] * n, [0] * n
    parent, group = page.parent, page.group
    heads = [int(g == 4) for g in group]
    items = [int(g == 6) for g in group]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        links[p] += links[i]
        marks[p] += marks[i]
        points[p] += points[i]
        inputs[p] += inputs[i]
        paragraphs[p] += paragraphs[i]
        heads[p] += heads[i]
        items[p] += items[i]
        size[p] += size[i]
        children[p] += 1
    depth, place, above_against, above_for, closed, within = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    seen = [0] * n
    rows = []
    whole, log = max(1, total[0]), math.log1p
    starts = _offsets(page)
    for i in range(n):
        p = parent[i]
        against, favour = _votes(page.tokens[i]) if page.tokens[i] else (0, 0)
        if p >= 0:
            depth[i], place[i] = depth[p] + 1, seen[p]
            seen[p] += 1
            above_against[i], above_for[i] = above_against[p] + against, above_for[p] + favour
            closed[i] = closed[p] or group[i] in (11, 12, 13, 14, 15)
            within[i] = within[p] + (group[p] == 1)
        else:
            above_against[i], above_for[i] = against, favour
        t, up = total[i], max(p, 0)
        kinds = [0.0] * len(NAMES)
        kinds[group[i]] = 1.0
        rows.append((
            log(t), t / whole, own[i] / max(1, t), links[i] / max(1, t), t / size[i], t / (1 + marks[i] + size[i]), 100 * points[i] / max(1, t), log(points[i]),
            paragraphs[i], heads[i], items[i], inputs[i], depth[i], children[i], place[i], children[up], place[i] / max(1, children[up]),
            starts[i] / whole, against, favour, above_against[i], above_for[i], float(closed[i]), t / max(1, total[up]), within[i], group[up],
            total[up] / whole, log(total[up]), paragraphs[up], links[up] / max(1, total[up]), size[up], *kinds))
    return np.array(rows, dtype=np.float32)


def _offsets(page: Page) -> list[int]:
    """How much text comes before each node's first text (that of the node before it if it has none)."""
    out, seen = [-1] * len(page.parent), 0
    for node, text in page.texts:
        if out[node] < 0:
            out[node] = seen
        if not text.isspace():
            seen += len(text)
    last = 0
    for i, at in enumerate(out):
        last = out[i] = last if at < 0 else at
    return out


def decode(page: Page, logits: np.ndarray) -> list[bool]:
    """The likeliest labelling in which a kept node's parent is kept; hidden nodes are rejected."""
    n, parent = len(page.parent), page.parent
    kept = np.minimum(-np.logaddexp(0, -logits), 0).tolist()
    rejected = np.minimum(-np.logaddexp(0, logits), 0).tolist()
    for i in range(n - 1, -1, -1):
        if page.hidden[i]:
            kept[i] = -math.inf
        if i:
            # kept: the parent may take the better of both for this child; rejected: all of it is rejected
            kept[parent[i]] += max(kept[i], rejected[i])
            rejected[parent[i]] += rejected[i]
    out = [False] * n
    for i in range(n):
        out[i] = (i == 0 or out[parent[i]]) and kept[i] >= rejected[i]
    return out


def joined(page: Page, kept: list[bool]) -> str:
    """The text of the kept nodes: references decoded, white space of a block as one space, blocks joined by one."""
    blocks = (" ".join(html.unescape(text).split()) for node, text in page.texts if kept[node])
    return " ".join(block for block in blocks if block)


def extract(sources: list[str], trees: Trees) -> list[str]:
    pages = [Page(s) for s in sources]
    described = [describe(p) for p in pages]
    logits = trees.logits(np.concatenate(described)) if described else np.zeros(0)
    ends = np.cumsum([len(d) for d in described])
    return [joined(p, decode(p, part)) for p, part in zip(pages, np.split(logits, ends[:-1]))] if pages else []


def made_up_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page with random words, and those words that belong to its main text. No word stands in both kinds of text."""
    good: set[str] = set()
    serial = iter(range(10**9))

    def words(n: int, main: bool) -> str:
        out = []
        for _ in range(n):
            w = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4))) + f"{'q' if main else 'x'}{next(serial)}"
            if main:
                good.add(w)
            out.append(w + (rng.choice(",.;") if rng.random() < 0.15 else ""))
        return " ".join(out) + ("." if n > 6 and rng.random() < 0.8 else "")

    plain = rng.random() < 0.15  # class names that say nothing

    def named(tag: str, names: str, *, ids: bool = True) -> str:
        if rng.random() < (0.4 if tag == "article" else 0.08):
            return f"<{tag}>"
        name = "c" + str(rng.randint(1, 99)) if plain else rng.choice(names.split())
        return f'<{tag} {rng.choice(["class", "class", "id"]) if ids else "class"}="{name}{rng.choice(["", "", " wide", " box-" + str(rng.randint(1, 9))])}">'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(rng.randint(1, 4), False)}</a>' + rng.choice(["</li>", "</li>", ""]) for i in range(n)) + "</ul>" if rng.random() < 0.7 else " | ".join(f'<a href="/{i}">{words(rng.randint(1, 3), False)}</a>' for i in range(n))

    def nav() -> str:
        tag = rng.choice(["nav", "nav", "div"])
        return named(tag, "nav menu navbar main-menu navigation breadcrumbs topbar") + links(rng.randint(3, 12)) + f"</{tag}>"

    def header() -> str:
        tag = rng.choice(["header", "div"])
        return named(tag, "header site-header masthead banner top") + rng.choice(["", f"<h1>{words(3, False)}</h1>", f"<p>{words(rng.randint(3, 12), False)}</p>", nav()]) + f"</{tag}>"

    def footer() -> str:
        tag = rng.choice(["footer", "footer", "div"])
        return named(tag, "footer site-footer copyright bottom legal") + rng.choice(["&copy; ", ""]) + words(rng.randint(3, 40), False) + rng.choice(["", links(rng.randint(2, 8)), f"<p>{words(rng.randint(5, 30), False)}</p>"]) + f"</{tag}>"

    def advert() -> str:
        tag = rng.choice(["div", "div", "aside", "section"])
        return named(tag, "ad ads advert sponsored promo banner-ad adbox") + rng.choice(["", "<p>"]) + words(rng.randint(3, 40), False) + rng.choice(["", f' <a href="#">{words(2, False)}</a>']) + f"</{tag}>"

    def notice() -> str:
        tag = rng.choice(["div", "div", "section", "aside"])
        return named(tag, "cookie cookie-notice consent gdpr alert notice popup") + f"<p>{words(rng.randint(6, 35), False)}</p>" + rng.choice(["<button>ok x</button>", "", f'<a href="#">{words(1, False)}</a>']) + f"</{tag}>"

    def side() -> str:
        tag = rng.choice(["aside", "aside", "div"])
        boxes = "".join(f"<h3>{words(2, False)}</h3>" + rng.choice([links(rng.randint(3, 8)), f"<p>{words(rng.randint(5, 40), False)}</p>"]) for _ in range(rng.randint(1, 3)))
        return named(tag, "sidebar side widget related rail recommended popular") + boxes + f"</{tag}>"

    def form() -> str:
        return named("form", "search login newsletter subscribe contact-form") + f"<label>{words(2, False)}</label><input name=q>" + rng.choice(["", "<textarea></textarea>", f"<p>{words(8, False)}</p>"]) + f"<button>{words(1, False)}</button></form>"

    def comments() -> str:
        tag = rng.choice(["section", "div", "div"])
        item = rng.choice(["div", "div", "li", "li", "article"])
        each = lambda: named(item, "comment reply comment-body") + rng.choice(["", f"<h4>{words(2, False)}</h4>", f"<b>{words(1, False)}</b> "]) + f"<p>{words(rng.randint(3, 50), False)}</p></{item}>"
        return named(tag, "comments comment-list discussion replies disqus respond") + rng.choice(["", f"<h3>{words(2, False)}</h3>"]) + "".join(each() for _ in range(rng.randint(1, 8))) + rng.choice(["", form()]) + f"</{tag}>"

    def inline(text: str) -> str:
        parts = text.split(" ")
        if len(parts) > 4 and rng.random() < 0.4:
            k = rng.randint(0, len(parts) - 3)
            tag = rng.choice(["b", "i", "em", "a href='/x'", "span", "strong"])
            parts[k], parts[k + 1] = f"<{tag}>" + parts[k], parts[k + 1] + f"</{tag.split()[0]}>"
        return " ".join(parts)

    def paragraph() -> str:
        kind = rng.random()
        long = inline(words(rng.choice([rng.randint(1, 12), rng.randint(10, 60), rng.randint(40, 160)]), True))
        if kind < 0.72:
            return rng.choice(["<p>", "<p>", "<p>", "<p><b>", "<p class=lead>"]) + long + rng.choice(["</p>", "</p>", "</p>", "<br>", ""])
        if kind < 0.79:
            return f"<h{(k := rng.randint(2, 4))}>{words(rng.randint(1, 8), True)}</h{k}>"
        if kind < 0.86:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{words(rng.randint(2, 25), True)}" + rng.choice(["</li>", ""]) for _ in range(rng.randint(2, 6))) + f"</{tag}>"
        if kind < 0.90:
            return f"<blockquote>{rng.choice(['', '<p>'])}{long}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words(rng.randint(1, 4), True)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{words(rng.randint(3, 12), True)}</figcaption></figure>"
        return f"<pre>{words(rng.randint(4, 30), True)}</pre>" if rng.random() < 0.5 else f"<div>{long}</div>"

    def main() -> str:
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        inside = [paragraph() for _ in range(rng.choice([1, 2, rng.randint(2, 8), rng.randint(5, 25)]))]
        for extra, chance in ((advert, 0.15), (side, 0.08), (form, 0.06), (nav, 0.05)):
            if rng.random() < chance:
                inside.insert(rng.randint(0, len(inside)), extra())
        if rng.random() < 0.75:
            inside.insert(0, rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"]).format(words(rng.randint(2, 12), True)))
        if rng.random() < 0.2:
            inside.append(named("div", "share social tags related") + links(rng.randint(2, 5)) + "</div>")
        if rng.random() < 0.1:
            inside.append(comments())
        return named(tag, "article post content entry-content article-body main story text page") + "".join(inside) + f"</{tag}>"

    before = [f() for f, chance in ((header, 0.6), (nav, 0.7), (notice, 0.25), (advert, 0.5), (form, 0.15)) if rng.random() < chance]
    after = [f() for f, chance in ((comments, 0.3), (side, 0.4), (advert, 0.25), (notice, 0.15), (footer, 0.8), (form, 0.1)) if rng.random() < chance]
    if rng.random() < 0.2:
        rng.shuffle(before)
    body = main()
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
        body = named("div", "wrap container row page layout outer inner", ids=False) + (side() if rng.random() < 0.15 else "") + body + "</div>"
    source = f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
    if rng.random() < 0.1:
        source = source[:rng.randint(len(source) // 2, len(source))]
    return source, good


#: Made-up training pages and their seed.
PAGES, SEED = 700, 77


@functools.lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> Trees:
    """Trees fitted to made-up pages. A node is to be kept if it has main text in it; nodes without text don't count."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        source, good = made_up_page(rng)
        page = Page(source)
        has, any_text = [False] * len(page.parent), [False] * len(page.parent)
        for node, text in page.texts:
            any_text[node] |= not text.isspace()
            has[node] = has[node] or any(w.strip(",.;") in good for w in text.split())
        for i in range(len(has) - 1, 0, -1):
            has[page.parent[i]] |= has[i]
            any_text[page.parent[i]] |= any_text[i]
        keep = np.array(any_text)
        x.append(describe(page)[keep])
        y.append(np.array(has, dtype=np.float64)[keep])
    return boost(np.concatenate(x), np.concatenate(y))


def main_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null or empty html: empty text. Html that is cut anywhere is read as far as it goes. Repeated rows: equal results.
    Null page_id or url: stay null. Empty table: no rows. Other columns are not read.
    """
    trees = trees or trained()

    def run(batch: pa.RecordBatch) -> dict:
        sources, texts = batch.column(2).to_pylist(), []
        for first in range(0, len(sources), 256):
            texts += extract([s or "" for s in sources[first:first + 256]], trees)
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), run, "page_id long,url string,text string,n_chars long")
