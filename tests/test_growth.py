"""What grew too fast over larger tables: how often a plan reads the texts, and the forms that replaced slow ones."""

import random

import pytest
from pyspark.sql import functions as F

from sardabir.functions import text as T
from sardabir.operators import words
from sardabir.plans import catalog, persianized

from conftest import SMALL

LETTERS = "ابمیهکيكىھە" + "‌‌" + "  .,;?\"07xـَةﻻﷺٰ \t"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_a_letter_is_no_string_of_its_own_where_words_are_counted(spark):
    assert "regexp_extract_all" not in plan(catalog.QUERIES["word_stats"](spark, SMALL))


@pytest.mark.parametrize("name", ["rule_arabic_yeh", "rule_latin_quotes", "rule_latin_semicolon", "book_words"])
def test_texts_are_read_once(name, spark):
    assert plan(catalog.QUERIES[name](spark, SMALL)).count("Relation [") == 1


def test_normal_forms_in_python_are_those_of_the_expression(spark):
    for compose in (True, False):
        df = spark.createDataFrame([(t,) for t in texts(500, 1)], "t string").select("t", T.norm_word(F.col("t"), compose=compose).alias("n"))
        assert [T.normed(r["t"], compose=compose) for r in df.collect()] == [r["n"] for r in df.collect()]


def test_words_and_their_places_are_those_of_the_texts(spark):
    rows = [("b", n, t) for n, t in enumerate(texts(300, 2))] + [(None, 300, None), ("none", 301, "...")]
    df = spark.createDataFrame(rows, "book string, k int, t string")
    got = words.tokens(df).collect()
    assert all(rows[r["k"]][2][r["s"]:r["e"]] == r["raw"] and T.normed(r["raw"], compose=True) == r["norm"] != "" for r in got)
    counted = {r["book"]: r["words"] for r in words.book_words(df).collect()}
    assert counted == {"b": sum(r["book"] == "b" for r in got), None: 0, "none": 0} and counted["b"] > 300


def test_lines_are_those_of_the_expression(spark, tmp_path):
    odd = ["", "\n\n a \n", "The of to\tin on,", "Élan ñ ü ê ä ö ß x\u0085y\n.\n", "İ ΑΣ. ΑΣ", None, "a \x1c b\r\n\n 　", "𝒳 of 😀"]
    spark.createDataFrame([(n, f"s{n % 2}", t) for n, t in enumerate(odd * 2)] + [(-1, None, "a b"), (None, "s", "b of c")], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lines = docs.select(F.col("source").alias("book"), F.col("doc_id").cast("string").alias("file"), F.col("doc_id").alias("file_pos"), F.posexplode_outer(F.split(persianized.persian(F.col("text"), F.col("doc_id")), "\n")).alias("i", "line"))
    want = lines.select("book", "file", "file_pos", "i", T.collapse_white(F.col("line")).alias("t")).where("t <> ''")
    assert sorted(map(repr, persianized.blocks(spark, str(tmp_path)).collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("name", ["user_message", "grammar_requests", "request_params", "llm_pilot"])
def test_requests_read_the_texts_for_their_lengths_and_to_be_sent(name, spark):
    # and sources alone, for the registers
    said = plan(catalog.QUERIES[name](spark, SMALL)).split("Relation [")
    assert len([x for x in said[1:] if "text" in x.split("]")[0]]) <= 4 and "MapInArrow" in "".join(said)


def test_requests_are_numbered_alike_with_and_without_the_chunks_numbers(spark):
    from sardabir.operators import review

    rows = [(f"b{n % 5}", str(n % 3), n % 3, n, "کتاب " * (n % 7 + 3)) for n in range(200)]
    packed = review.chunks(spark.createDataFrame(rows, "book string, file string, file_pos int, i int, t string"), 100)
    names = spark.createDataFrame([("b1", "r")], "book string, register string")
    one, two = (sorted(map(repr, review.requests(p, names, "any").collect())) for p in (packed, packed.drop("nth")))
    assert one == two and len(one) > 20


def test_the_pages_of_books_take_one_search_for_hits(spark, monkeypatch):
    from sardabir.operators import typography

    asked, find = [], typography.find_issues
    monkeypatch.setattr(typography, "find_issues", lambda *a: asked.append(1) or find(*a))
    pages = catalog.QUERIES["report_book_page"](spark, SMALL)
    assert len(asked) == 1 and pages.columns == ["book", "html"]


def test_flagged_words_are_worked_out_once_and_only_their_places_leave_the_texts(spark, monkeypatch):
    from sardabir.operators import spelling

    asked, find = [], words.tokens
    monkeypatch.setattr(spelling, "tokens", lambda *a, **b: asked.append(find(*a, **b)) or asked[-1])
    issues = catalog.QUERIES["spelling_issues"](spark, SMALL)
    assert "levenshtein" not in plan(issues) and len(asked) == 1 and asked[0].count() == issues.count() > 0
    monkeypatch.setattr(spelling, "CARRIED", 0)
    joined = catalog.QUERIES["spelling_issues"](spark, SMALL)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, issues.collect())) and asked[1].count() > asked[0].count()


def test_places_of_some_words_are_those_among_all(spark):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts(500, 3))], "k int, t string")
    every = words.tokens(df).collect()
    some = frozenset([r["norm"] for r in every][::7])
    got = words.tokens(df, only=spark.sparkContext.broadcast(some)).collect()
    assert sorted(map(repr, got)) == sorted(repr(r) for r in every if r["norm"] in some) and 0 < len(got) < len(every)
    assert words.tokens(df, only=spark.sparkContext.broadcast(frozenset())).count() == 0
    plain = words.tokens(df, compose=False, only=spark.sparkContext.broadcast(some)).collect()
    assert sorted(map(repr, plain)) == sorted(repr(r) for r in words.tokens(df, compose=False).collect() if r["norm"] in some)


def test_texts_without_some_words_are_passed_over(monkeypatch):
    monkeypatch.setattr(words, "LOOKED_AT", 200)
    told = texts(2000, 6) + ["ا" * 300, "", "‌‌", "ا‌‌", "ﻻ"]
    for compose in (True, False):
        norms = [{T.normed(run.strip("‌"), compose=compose) for run in words._RUN.findall(t)} - {""} for t in told]
        for some in (frozenset().union(*norms[::40]), frozenset(["ا"]), frozenset()):
            held = list(words._Sought(some, compose).among(told))
            sure = [bool(n & some) for n in norms]
            assert len(held) == len(told) and all(h or not s for h, s in zip(held, sure))
            assert all(h == s for h, s, t in zip(held, sure, told) if len(t) < 200 and not (compose and ("ﻻ" in t or "ﷺ" in t)))


def test_hashes_of_keys_meet_where_keys_do():
    rng = random.Random(4)
    some = ["", "ا", "😀ب"] + sorted({"".join(rng.choice("ابم") for _ in range(rng.randint(1, 7))) for _ in range(200)})
    of, hashes = T.key_hashes(some)
    told = [set() for _ in some]
    for k, h in zip(of.tolist(), hashes.tolist()):
        told[k].add(h)
    keys = [{w, *(w[:k] + w[k + 1:] for k in range(len(w)))} for w in some]
    assert all(bool(told[a] & told[b]) == bool(keys[a] & keys[b]) for a in range(1, len(some)) for b in range(1, a))


def test_typos_found_by_hashes_are_those_of_the_join(spark, monkeypatch):
    from sardabir.operators import spelling

    rng = random.Random(5)
    far = "".join(rng.choice("ابم") for _ in range(20_000))  # all its strings with one character less would be 400 MB
    rows = [("".join(rng.choice("ابکس‌") for _ in range(rng.randint(3, 7))), rng.choice([1, 1, 2, 40, 90, 200]), 1) for _ in range(900)]
    stats = spark.createDataFrame(list({w: (w, *r) for w, *r in rows}.values()), "word string, tf bigint, df bigint").cache()
    none = spark.createDataFrame([], "word string")
    got = sorted(map(repr, spelling.corpus_typos(stats, none, none).collect()))
    long = spark.createDataFrame([(far, 500, 3), (far[:9000] + "ک" + far[9001:], 2, 1)], "word string, tf bigint, df bigint")
    assert [(r["sugg_tf"], r["tf"]) for r in spelling._near(long.where("tf = 2").select("word", "tf"), [far], long.where("tf = 500").toPandas()["tf"].to_numpy(), 40).selectExpr("cand_tf AS sugg_tf", "tf").collect()] == [(500, 2)]
    monkeypatch.setattr(spelling, "CARRIED", 0)
    assert got == sorted(map(repr, spelling.corpus_typos(stats, none, none).collect())) and len(got) > 20
