"""The plane of external reviewers: paragraphs packed into requests, answers parsed, verified and turned into issues.

The reviewer itself is a function of a request; the engine never calls a network.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import text as T

MAX_CHARS, PER_BATCH, MAX_TOKENS, MIN_CHARS, MIN_CONF, SAMPLE = 6000, 5000, 4096, 12, 0.6, 25
#: Output tokens of a request, assumed for estimates.
LEAST_OUT, MOST_OUT = 60, 600
PROMPT = "Proofread the numbered Persian paragraphs and answer with a JSON object {\"issues\": [...]}; each issue has p, original, suggestion, type, note and confidence."
ISSUE = "p string, original string, suggestion string, type string, note string, confidence string"


def chunkable(blocks: DataFrame) -> DataFrame:
    """Blocks that are worth a review: long enough, Persian, and not Arabic-looking."""
    return blocks.where((F.length("t") >= MIN_CHARS) & T.gated(F.col("t")))


def chunks(blocks: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """book, chunk (from 0), pos (from 0), f, i, t and nth (the chunk's number over all books in order): greedy packing
    of a book's paragraphs in order.

    A paragraph that would take a chunk beyond ``max_chars`` begins the next one. That depends on all before, so a
    book's lengths stream through one task in order; the texts stay out of it and are joined back.
    """
    ready = chunkable(blocks).select("book", F.col("file_pos").cast("int").alias("file_pos"), F.col("file").alias("f"), F.col("i").cast("int").alias("i"), "t")
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lengths = ready.select("book", "file_pos", "i", F.length("t").alias("n")).repartition(tasks, "book").sortWithinPartitions("book", "file_pos", "i")
    placed = lengths.mapInArrow(lambda batches: _packed(batches, max_chars), "book string, file_pos int, i int, chunk int, pos int")
    # numbered by what was packed, without the texts; the lengths are dealt out once for both
    sizes = placed.groupBy("book").agg((F.max("chunk") + 1).cast("bigint").alias("count"))
    return placed.join(F.broadcast(_before(sizes)), "book").join(ready, ["book", "file_pos", "i"]).select("book", "chunk", "pos", "file_pos", "f", "i", "t", (F.col("before") + F.col("chunk")).alias("nth"))


def _before(sizes: DataFrame) -> DataFrame:
    """book and how many chunks (``count``) the books before it have, which is one row of two values for each book."""
    return sizes.select("book", (F.sum("count").over(Window.orderBy("book")) - F.col("count")).alias("before"))


def _packed(batches: Iterator[pa.RecordBatch], max_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows (book, file_pos, i, n) in order with the chunk and the place in it, one chunk after another."""
    book, chunk, size, pos = None, 0, 0, 0
    for batch in batches:
        names, ends = batch.column(0).to_pylist(), np.cumsum(batch.column(3).to_numpy(), dtype=np.int64)
        chunks, places = np.empty(len(names), np.int32), np.empty(len(names), np.int32)
        turns = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]] + [len(names)]
        for at, until in zip(turns, turns[1:]):
            if names[at] != book:
                book, chunk, size, pos = names[at], 0, 0, 0
            while at < until:
                before = int(ends[at - 1]) if at else 0
                # up to where the chunk is full; an empty one takes a paragraph of any length
                stop = min(until, max(int(np.searchsorted(ends, before + max_chars - size, side="right")), at + (pos == 0)))
                chunks[at:stop], places[at:stop] = chunk, np.arange(pos, pos + stop - at)
                size, pos = size + int(ends[stop - 1] if stop else 0) - before, pos + stop - at
                if stop < until:
                    chunk, size, pos = chunk + 1, 0, 0
                at = stop
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(chunks), pa.array(places)], names=["book", "file_pos", "i", "chunk", "pos"])


def user_message(texts: Column, register: Column) -> Column:
    """Numbered paragraphs, after a line on the book's register if there is one."""
    head = F.when(F.coalesce(register, F.lit("")) != "", F.concat(F.lit("Book register/genre note: "), register, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(head, F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n\n"))


def requests(packed: DataFrame, registers: DataFrame, model: str, first: int = 0, per_batch: int = PER_BATCH) -> DataFrame:
    """One row per chunk: nth, cid, book, items, content, params (JSON) and batch; ``registers`` has book and register.

    Numbers run over books and chunks in order, cids from ``first`` on. They come with the chunks, or else from a
    count per book, so what one task numbers is a row of two values for each book.
    """
    if "nth" not in packed.columns:
        sizes = packed.select("book", "chunk").distinct().groupBy("book").count()
        packed = packed.join(_before(sizes), "book").withColumn("nth", F.col("before") + F.col("chunk"))
    told = packed.groupBy("book", "chunk", "nth").agg(F.array_sort(F.collect_list(F.struct("pos", "f", "i", "t"))).alias("x"))
    nth = F.col("nth")
    content = user_message(F.col("x.t"), F.col("register"))
    rows = told.join(registers.select("book", "register"), "book", "left")
    return rows.select(
        nth.alias("nth"), F.format_string("c%07d", nth + first).alias("cid"), "book", F.transform("x", lambda p: F.struct(p["f"].alias("f"), p["i"].alias("i"))).alias("items"),
        content.alias("content"), F.floor(nth / per_batch).alias("batch")).withColumn("params", F.to_json(F.struct(
            F.lit(model).alias("model"), F.lit(MAX_TOKENS).alias("max_tokens"), F.lit(PROMPT).alias("system"),
            F.array(F.struct(F.lit("user").alias("role"), F.col("content").alias("content"))).alias("messages"))))


def registers_of(books: DataFrame, registers: DataFrame) -> DataFrame:
    """book and register: by relative path, else by file name, else by id; the first that isn't empty."""
    out = books.select("book", "rel", F.substring_index("rel", "/", -1).alias("name"))
    for n, key in enumerate(("rel", "name", "book")):
        side = registers.select(F.col("file").alias(f"__k{n}"), F.nullif(F.col("register"), F.lit("")).alias(f"__r{n}"))
        out = out.join(side, F.col(key) == F.col(f"__k{n}"), "left")
    return out.select("book", F.coalesce("__r0", "__r1", "__r2").alias("register"))


def systematic_sample(rows: DataFrame, total: int, sample: int = SAMPLE) -> DataFrame:
    """Every (total // sample)-th request from the first on, ``sample`` at most."""
    step = max(1, total // sample)
    return rows.where((F.col("nth") % step == 0) & (F.col("nth") < step * sample))


def estimate(rows: DataFrame, count_tokens: Callable[[Column], Column], price_in: float, price_out: float) -> DataFrame:
    """One row: requests, chars, est_in (sampled tokens carried on), out_low, out_high, cost_low, cost_high."""
    whole = rows.agg(F.count("*").alias("requests"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars")).first()
    sampled = systematic_sample(rows, whole["requests"]).agg(F.sum(count_tokens(F.col("content"))).alias("tok"), F.count("*").alias("n"))
    est = sampled.select(F.lit(whole["requests"]).cast("bigint").alias("requests"), F.lit(whole["chars"]).cast("bigint").alias("chars"), "tok", "n").select(
        "requests", "chars", F.floor(F.col("tok") / F.col("n") * F.col("requests")).alias("est_in"), (LEAST_OUT * F.col("requests")).alias("out_low"), (MOST_OUT * F.col("requests")).alias("out_high"))
    cost = lambda out: F.col("est_in") / 1e6 * price_in + F.col(out) / 1e6 * price_out
    return est.withColumn("cost_low", cost("out_low")).withColumn("cost_high", cost("out_high"))


def latest_results(results: DataFrame) -> DataFrame:
    """The last answer of each request, by file and line; failed ones never replace an answer."""
    order = Window.partitionBy("cid").orderBy(F.desc("file"), F.desc("line"))
    return results.where("error IS NULL").withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def usage(results: DataFrame) -> DataFrame:
    """One row: tokens_in, tokens_out and errors of all answers, replaced ones too."""
    zero = lambda c: F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col(c))), F.lit(0)).cast("bigint")
    return results.agg(zero("in").alias("tokens_in"), zero("out").alias("tokens_out"), F.count_if(F.col("error").isNotNull()).alias("errors"))


#: JSON as Python reads it: strings stand between double quotes only.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}
_STRIP = f"^[{C.members(C.WHITE)}]+|[{C.members(C.WHITE)}]+$"


def parse_issues(text: Column) -> Column:
    """The objects of ``issues``, as JSON each, between the first opening and the last closing brace; none if that is no JSON object."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    body = F.when((start > 0) & (F.instr(text, "}") > 0) & (end > start), F.substr(text, start, end - start + 1))
    # item by item, so that one of another kind doesn't spoil the others
    items = F.from_json(body, F.lit("issues array<string>"), _STRICT)["issues"]
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & x.startswith("{") & F.from_json(x, F.lit("map<string,string>"), _STRICT).isNotNull())


def _number(x: Column, name: str) -> Column:
    """A field that is a JSON number or true or false, as double; null if it is anything else."""
    return F.coalesce(F.from_json(x, F.lit(f"{name} double"), _STRICT)[name], F.from_json(x, F.lit(f"{name} boolean"), _STRICT)[name].cast("double"))


def verify(answers: DataFrame, items: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """Claims checked against the paragraphs: book, cid, p, ..., ok.

    ``answers`` has cid, book and text; ``items`` has cid, p (from 1), f, i and t. A claim holds if its paragraph has
    the quoted text, literally or with Arabic letters taken for Persian ones; its span is cut from the paragraph. A
    paragraph's number may be a number, of which the whole part counts, or a string of digits; a confidence that is
    missing is 0.5, one that is null or no number drops the claim.
    """
    claims = answers.select("cid", "book", F.posexplode(parse_issues(F.col("text"))).alias("k", "x")).withColumn("m", F.from_json("x", F.lit("map<string,string>"), _STRICT))
    text = lambda name, default: F.coalesce(F.col("m")[name], F.lit(default))
    strip = lambda c: F.regexp_replace(c, F.lit(_STRIP), F.lit(""))
    as_number, written = _number(F.col("x"), "p"), strip(F.col("m")["p"])
    p = F.when(as_number.isNotNull(), F.when(~F.isnan(as_number) & (F.abs(as_number) < 1e9), as_number.cast("int"))).when(written.rlike("^[+-]?[0-9]{1,9}$"), written.try_cast("int"))
    conf = F.when(~F.map_contains_key("m", "confidence"), F.lit(0.5)).otherwise(F.coalesce(_number(F.col("x"), "confidence"), strip(F.col("m")["confidence"]).try_cast("double")))
    claims = claims.select(
        "cid", "book", "k", p.alias("p"), conf.alias("conf"), strip(text("original", "")).alias("original"), strip(text("suggestion", "")).alias("sugg"), text("type", "grammar").alias("type"), text("note", "").alias("note"))
    looked = claims.join(items.select("cid", "p", "f", "i", "t"), ["cid", "p"], "left")
    alike = lambda c: T.swap(c, C.TO_PERSIAN_QUOTED)
    exact, near = F.expr("instr(t, original)"), F.instr(alike(F.col("t")), alike(F.col("original")))
    off = F.when(exact > 0, exact).otherwise(near) - 1
    ok = F.col("t").isNotNull() & (F.col("original") != "") & (F.col("original") != F.col("sugg")) & F.coalesce((F.col("conf") >= min_conf) & ~F.isnan("conf"), F.lit(False)) & (off >= 0)
    return looked.select(
        "cid", "book", "k", "p", "f", "i", off.cast("int").alias("off"), F.length("original").alias("len"), F.substr("t", off + 1, F.length("original")).alias("orig"), "sugg",
        F.concat(F.lit("llm_"), F.col("type")).alias("rule"), F.lit("review").alias("severity"), F.when(F.col("type") == "spelling", "spelling").otherwise("grammar").alias("category"),
        F.round("conf", 2).alias("conf"), F.col("note").alias("msg_fa"), F.coalesce(ok, F.lit(False)).alias("ok"))


def items_of(manifest: DataFrame, blocks: DataFrame) -> DataFrame:
    """cid, book, p, f, i, t of every paragraph that was sent; of one that is gone, empty text."""
    sent = manifest.select("cid", "book", F.posexplode("items").alias("__pos", "it")).select("cid", "book", (F.col("__pos") + 1).alias("p"), "it.f", "it.i")
    texts = blocks.select("book", F.col("file").alias("f"), "i", "t")
    return sent.join(texts, ["book", "f", "i"], "left").select("cid", "book", "p", "f", "i", F.coalesce("t", F.lit("")).alias("t"))


def rebuild_issues(manifest: DataFrame, results: DataFrame, blocks: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """All issues anew from what was sent and answered; answers nobody asked for are left out."""
    answers = latest_results(results).join(manifest.select("cid", "book"), "cid").select("cid", "book", "text")
    return verify(answers, items_of(manifest, blocks), min_conf)


def run_reviewer(rows: DataFrame, reviewer: Callable[[str], str], parallel: int = 4) -> DataFrame:
    """cid, text, in, out, error: every request put to ``reviewer``, ``parallel`` at a time; a failure is that request's alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield answered(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), reviewer)

    return rows.select("cid", "params").repartition(parallel, "cid").mapInArrow(run, ANSWER)


ANSWER = "cid string, text string, in bigint, out bigint, error string"


def answered(asked: Iterable[tuple[str, str]], reviewer: Callable[[str], str]) -> pa.RecordBatch:
    """Answers (cid, text, in, out, error) to requests (cid, params)."""
    out = []
    for cid, params in asked:
        try:
            text = reviewer(params)
            out.append((cid, text, len(params) // 4, len(text) // 4, None))
        except Exception as e:  # noqa: BLE001
            out.append((cid, None, None, None, f"{type(e).__name__}: {e}"))
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*out)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cid", "text", "in", "out", "error"])


def offline_reviewer(params: str) -> str:
    """A reviewer without a network: it doubts each paragraph's first word."""
    content = json.loads(params)["messages"][0]["content"]
    issues = []
    for n, paragraph in enumerate(p for p in content.split("\n\n") if p.startswith("[")):
        words = paragraph.split("] ", 1)[1].split()
        if words:
            issues.append({"p": n + 1, "original": words[0], "suggestion": words[0] + words[0][-1], "type": ("spelling", "grammar")[n % 2], "note": "", "confidence": 0.5 + n % 5 / 10})
    return json.dumps({"issues": issues}, ensure_ascii=False)


def batches(rows: DataFrame) -> DataFrame:
    """batch, n, first_cid, last_cid: what is handed over to a reviewer at once."""
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("cid").alias("first_cid"), F.max("cid").alias("last_cid"))


def batch_status(handed: DataFrame, results: DataFrame, rows: DataFrame) -> DataFrame:
    """Per batch how many requests were answered, failed or are open, and whether it is collected.

    Collecting again is idempotent: only batches with open requests are asked for.
    """
    best = results.groupBy("cid").agg(F.max(F.col("error").isNull()).alias("fine"))
    told = rows.select("batch", "cid").join(best, "cid", "left").groupBy("batch").agg(
        F.count_if("fine").alias("answered"), F.count_if(~F.col("fine")).alias("failed"), F.count_if(F.col("fine").isNull()).alias("open"))
    return handed.join(told, "batch").withColumn("collected", F.col("open") == 0)
