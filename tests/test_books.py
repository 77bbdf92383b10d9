import csv
import io
import json
import re
import zipfile

from pyspark.sql import functions as F

from sardabir import cli
from sardabir.operators import review, reviewers
from sardabir.sources import blocks, epub, lists, store
from sardabir.streaming import follow


def book(docs, title="کتاب"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
        items = "".join(f'<item id="d{i}" href="T/{i}.xhtml#x" media-type="application/xhtml+xml"/>' for i in range(len(docs)))
        refs = "".join(f'<itemref idref="d{i}"/>' for i in range(len(docs)))
        z.writestr("OPS/b.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for i, d in enumerate(docs):
            z.writestr(f"OPS/t/{i}.XHTML", d)
    return out.getvalue()


def test_blocks_of_markup():
    read = blocks.read_blocks("<html><head><title>no</title></head><body><div id='a'>one<p id=b>two<br>three</p>tail<!-- no --><script>no</script></div>&amp; end</body></html>")
    assert read == [("a", "one"), ("b", "two three"), (None, "tail"), (None, "& end")]
    assert blocks.read_blocks(None) == [] and blocks.read_blocks("") == []


TEXT = "<html><body><p>او می خواند, و رفت به خانه</p><p>کتاب ها زياد بود و بزرگ</p></body></html>"


def walked(node, out, state):
    """Blocks of well-formed markup by its tree: depth first, a block element closes what is open on entry and on exit."""
    def flush():
        text = re.sub(r"[\s\u00a0]+", " ", "".join(state["parts"])).strip()
        if text:
            out.append((state["anchor"], text))
        state.update(parts=[], anchor=None)

    if node.tag not in ("script", "style", "svg", "math", "rt", "rp", "head"):
        block = node.tag in blocks.BLOCK_TAGS
        if block:
            flush()
            state["anchor"] = node.get("id")
        if node.tag == "br":
            state["parts"].append(" ")
        state["parts"].append(node.text or "")
        for child in node:
            walked(child, out, state)
            state["parts"].append(child.tail or "")
        if block:
            flush()
    return out


def test_blocks_equal_a_walk_over_the_tree(spark):
    import random
    from xml.etree import ElementTree

    rng = random.Random(2)

    def made_up(depth):
        inside = "".join(rng.choice(["متن ", "a  b\n", "\u00a0", "&amp;", "", "x"]) + (made_up(depth - 1) if depth and rng.random() < 0.6 else "") for _ in range(rng.randint(0, 3)))
        tag = rng.choice(["div", "section", "blockquote", "b", "span", "i", "em", "script", "svg", "ruby", "h2", "article", "br"])
        return "<br/>" if tag == "br" else f"<{tag}{rng.choice(['', ' id=' + chr(34) + 'n' + str(rng.randint(1, 99)) + chr(34)])}>{inside.replace('<', '<') if tag not in ('script',) else 'var a;'}</{tag}>"

    pages = [f"<html><head><title>no</title></head><body>{''.join(made_up(4) for _ in range(5))}</body></html>" for _ in range(120)]
    want = [(k, i, a, t) for k, p in enumerate(pages) for i, (a, t) in enumerate(walked(ElementTree.fromstring(p).find("body"), [], {"parts": [], "anchor": None}))]
    df = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    assert sorted((r["k"], r["i"], r["anchor"] or "", r["t"]) for r in blocks.extract_blocks(df).collect()) == sorted((k, i, a or "", t) for k, i, a, t in want)


def test_scan_report_and_fix(spark, tmp_path):
    shelf = tmp_path / "in" / "sub"
    shelf.mkdir(parents=True)
    (shelf / "a.EPUB").write_bytes(book([TEXT, TEXT]))
    (shelf / "bad.epub").write_bytes(b"not a zip")
    (shelf / "other.txt").write_text("x")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    files = epub.find_files(spark, folder)
    assert sorted(r["rel"] for r in files.collect()) == ["sub/a.EPUB", "sub/bad.epub"]
    cli.scan(spark, folder, out)
    books = {r["rel"]: r for r in cli.books_of(spark, out).collect()}
    assert books["sub/a.EPUB"]["title"] == "کتاب" and books["sub/a.EPUB"]["words"] == 26 and "Unreadable" in books["sub/bad.epub"]["error"]
    rules = {r["rule"] for r in store.read_issues(spark, f"{out}/issues").collect()}
    assert {"zwnj_mi", "latin_comma", "zwnj_ha", "arabic_yeh"} <= rules
    assert "sub/bad.epub" in cli.make_report(spark, out)
    counts = {r["rule"]: r["n"] for r in cli.fix(spark, folder, out, str(tmp_path / "fixed")).collect()}
    assert counts == {"zwnj_mi": 2, "latin_comma": 2, "zwnj_ha": 2, "arabic_yeh": 2}
    with zipfile.ZipFile(tmp_path / "fixed" / "sub" / "a.EPUB") as z:
        assert z.namelist()[0] == "mimetype" and "می‌خواند،" in z.read("OPS/t/0.XHTML").decode()
    cli.make_report(spark, out)
    page = (tmp_path / "out" / "report" / "books" / f"{books['sub/a.EPUB']['id']}.html").read_text(encoding="utf-8")
    assert "8 تغییر" in page and page.count("<details>") == 4 and page.count("<html") == 1
    summary = list(csv.DictReader(io.StringIO((tmp_path / "out" / "report" / "summary.csv").read_bytes().decode("utf-8-sig"))))
    assert [(r["file"], r["words"], r["auto_fixed"], r["issues_per_1000_words"], bool(r["error"])) for r in summary] == [("sub/a.EPUB", "26", "8", "0.0", False), ("sub/bad.epub", "", "", "", True)]
    assert (tmp_path / "out" / "report" / "all_issues.csv").read_bytes().decode("utf-8-sig").startswith("book,file,paragraph,category,rule,source,original,suggestion,confidence,message,context\r\n")
    assert (tmp_path / "out" / "spelling_candidates.csv").read_bytes()[:3] == b"\xef\xbb\xbf"

    # a second scan reads only what is new, and leaves out what the whitelist has
    (tmp_path / "out" / "whitelist.txt").write_text("کتاب\n", encoding="utf-8")
    (shelf / "c.epub").write_bytes(book([TEXT], "دیگر"))
    cli.scan(spark, folder, out)
    assert {r["rel"]: (r["blocks_version"], r["words"]) for r in cli.books_of(spark, out).collect() if not r["error"]} == {"sub/a.EPUB": (0, 26), "sub/c.epub": (1, 13)}
    stats = json.loads(next((tmp_path / "out" / "corpus_stats.json").glob("part-*.json")).read_text())
    assert (stats["books"], stats["tokens"], stats["known_words"], stats["thresholds"]["ratio"]) == (2, 39, 1, 40)


def grammar(spark, out):
    return {(r["book"], r["f"], r["i"], r["off"]) for r in store.read_issues(spark, out + "/issues").where("source = 'grammar'").collect()}


def test_reviews_of_several_runs(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for name in "abcd":
        (folder / f"{name}.epub").write_bytes(book([TEXT], name))
    cli.scan(spark, str(folder), out)
    client = reviewers.OfflineClient(f"{out}/grammar/offline")
    cli.pilot(spark, out, client, "any", min_conf=0.0, only=["a.epub"])
    first = grammar(spark, out)
    assert len(first) == 2
    # a second run neither takes the first one's numbers nor its issues
    assert cli.submit(spark, out, client, "any", only=["b.epub"], dry_run=True).count() == 1 and reviewers.next_number(spark, f"{out}/grammar") == 1
    assert cli.estimate(spark, out, client, "any", 1.0, 2.0, only=["b.epub"]).first()["requests"] == 1
    assert cli.submit(spark, out, client, "any", only=["b.epub"]).count() == 1
    assert [r["cid"] for r in reviewers.table(spark, f"{out}/grammar", "manifest").orderBy("cid").collect()] == ["c0000000", "c0000001"]
    told = reviewers.status(spark, f"{out}/grammar", client).collect()
    assert [(r["state"], r["ok"], r["collected"]) for r in told] == [("ended", 1, False)]
    assert reviewers.collect(spark, f"{out}/grammar", client).count() == 0
    kept = cli.rebuild(spark, out, 0.0)
    assert first < grammar(spark, out) and len(grammar(spark, out)) == 4 and kept.where("ok").count() == 4
    # collecting again changes nothing
    reviewers.collect(spark, f"{out}/grammar", client)
    assert reviewers.results(spark, f"{out}/grammar").count() == 2
    cli.pilot(spark, out, client, "any", min_conf=0.0)
    assert reviewers.next_number(spark, f"{out}/grammar") == 2 + reviewers.PILOT_BOOKS and len(grammar(spark, out)) == 6


def test_damaged_package_files_are_read_as_far_as_they_go():
    whole = book([TEXT, TEXT])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            data = old.read(name)
            new.writestr(name, data.replace(b"</metadata>", b"<meta & bad></metadata") if name.endswith("opf") else data)
    told, _ = epub.open_book(out.getvalue())
    assert (told.title, told.spine) == ("کتاب", ["OPS/t/0.XHTML", "OPS/t/1.XHTML"])


def test_lists(spark, tmp_path):
    (tmp_path / "w.dic").write_text("12345\nواژه/AB\n# x\nکتاب\ty\n\n", encoding="utf-8")
    assert sorted(r["word"] for r in lists.load_wordlist(spark, str(tmp_path / "w.dic")).collect()) == ["واژه", "کتاب"]
    (tmp_path / "r.csv").write_text("﻿file,register\na.epub,formal\n,skip\na.epub,poem\n", encoding="utf-8")
    assert [tuple(r) for r in lists.load_registers(spark, str(tmp_path / "r.csv")).collect()] == [("a.epub", "poem")]


def test_packing_and_verification(spark):
    text = lambda n: "ا" * n
    rows = [("a", 0, n, text(k)) for n, k in enumerate((3000, 3000, 12))] + [("b", 0, 0, text(7000)), ("b", 0, 1, text(12)), ("c", 0, 0, text(11))]
    df = spark.createDataFrame([(b, str(f), f, i, t) for b, f, i, t in rows], "book string, file string, file_pos int, i int, t string")
    got = {(r["book"], r["i"]): r["chunk"] for r in review.chunks(df).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("b", 0): 0, ("b", 1): 1}
    parse = lambda s: len(spark.createDataFrame([(s,)], "t string").select(review.parse_issues(F.col("t")).alias("x")).first()["x"])
    assert [parse(s) for s in ('so {"issues":[{"p":1}]} end', "[1]", '{"issues":[', '{"issues":[1,{}]}', "")] == [1, 0, 0, 1, 0]
    assert parse("{'issues':[{'p':1}]}") == 0
    claims = [  # each with whether it holds
        ('{"p":1,"original":"كتاب","suggestion":"x"}', True), ('{"p":1,"original":"گم","suggestion":"x"}', False), ('{"p":0,"original":"بد","suggestion":"x"}', False),
        ('{"p":1,"original":"بد","suggestion":"بد"}', False), ('{"p":1,"original":"بد","suggestion":"x","confidence":0.3}', False), ('{"p":1,"original":"بد","suggestion":"x","confidence":null}', False),
        ('{"p":"1.5","original":"بد","suggestion":"x"}', False), ('{"p":1.5,"original":"بد","suggestion":"x"}', True), ('{"p":" 1 ","original":"بد","suggestion":"x"}', True),
        ('{"p":true,"original":"بد","suggestion":"x"}', True), ('{"p":null,"original":"بد","suggestion":"x"}', False), ('{"original":"بد","suggestion":"x"}', False),
        ('{"p":1,"original":"بد\\n","suggestion":"x","confidence":"0.9"}', True), ('{"p":1,"original":"\\u00a0 بد","suggestion":"x","confidence":"high"}', False), ('{"p":1,"original":"","suggestion":"x"}', False),
    ]
    answers = spark.createDataFrame([(f"c{k}", "b", f'{{"issues":[{claim}]}}') for k, (claim, _) in enumerate(claims)], "cid string, book string, text string")
    items = spark.createDataFrame([(f"c{k}", 1, "f", 0, "یک کتاب بد") for k in range(len(claims))], "cid string, p int, f string, i int, t string")
    told = {r["cid"]: r for r in review.verify(answers, items, 0.5).collect()}
    assert [told[f"c{k}"]["ok"] for k in range(len(claims))] == [ok for _, ok in claims]
    assert (told["c0"]["orig"], told["c0"]["off"], told["c7"]["p"]) == ("کتاب", 3, 1)


def test_packing_equals_a_plain_loop(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for n in range(30):
        chunk = size = pos = 0
        for i in range(rng.randint(1, 90)):
            length = rng.choice([12, 50, 300, 900, 1300])
            if pos and size + length > 1000:
                chunk, size, pos = chunk + 1, 0, 0
            rows.append((f"b{n}", str(i // 7), i // 7, i % 7, "ا" * length))
            want[f"b{n}", i // 7, i % 7] = chunk, pos
            size, pos = size + length, pos + 1
    df = spark.createDataFrame(rows, "book string, file string, file_pos int, i int, t string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        assert {(r["book"], r["file_pos"], r["i"]): (r["chunk"], r["pos"]) for r in review.chunks(df, 1000).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    df = spark.createDataFrame([("a", "f", 0, k, "او می خواند, و رفت") for k in range(5)], "book string, file string, file_pos bigint, i int, t string")
    store.write_blocks(df, str(tmp_path / "b"))
    follow.write_stream(follow.follow_issues(follow.follow_blocks(spark, str(tmp_path / "b"))), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == follow.follow_issues(store.read_blocks(spark, str(tmp_path / "b"))).count() == 10
