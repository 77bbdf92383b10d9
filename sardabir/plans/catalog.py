"""The engine's queries, one per operator, with equivalent DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars as C
from ..functions import text as T
from ..operators import issues as I
from ..operators import markup, review, spelling, typography, words
from ..sources import blocks as html_blocks
from ..sources import lists
from . import fragments as S
from .persianized import blocks as B
from .persianized import persian

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


KEY = ["book", "file", "i"]
_KEY = "book, file, i"

# ---- predicates and scalar functions --------------------------------------------------------------------------


@query("ws_collapse", f"WITH {S.BLOCKS} SELECT {_KEY}, t FROM blocks")
def _(spark, d):
    return B(spark, d).select(*KEY, "t")


@query("has_persian", f"WITH {S.BLOCKS} SELECT {_KEY}, regexp_matches(t, '{C.LETTER}') AS v FROM blocks")
def _(spark, d):
    return B(spark, d).select(*KEY, T.has_persian(F.col("t")).alias("v"))


@query("is_arabic_like", f"WITH {S.BLOCKS} SELECT {_KEY}, {S.arabic()} AS v FROM blocks")
def _(spark, d):
    return B(spark, d).select(*KEY, T.is_arabic_like(F.col("t")).alias("v"))


@query("rule_gate", f"WITH {S.BLOCKS} SELECT {_KEY} FROM blocks WHERE {S.gated()}")
def _(spark, d):
    return B(spark, d).where(T.gated(F.col("t"))).select(*KEY)


@query("spelling_gate", f"WITH {S.BLOCKS} SELECT {_KEY} FROM blocks WHERE NOT {S.arabic()}")
def _(spark, d):
    return B(spark, d).where(~T.is_arabic_like(F.col("t"))).select(*KEY)


@query("chunk_gate", f"WITH {S.BLOCKS} SELECT {_KEY} FROM blocks WHERE length(t) >= 12 AND {S.gated()}")
def _(spark, d):
    return review.chunkable(B(spark, d)).select(*KEY)


@query("digits", f"SELECT doc_id, translate(text, '0123456789', '{C.PERSIAN_DIGITS}') AS v FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.persian_digits(F.col("text")).alias("v"))


@query("escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS v FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("v"))


@query("norm_word", f"""WITH {S.BLOCKS} SELECT DISTINCT run, {S.norm('run')} AS norm FROM (SELECT unnest(regexp_extract_all(t, '{C.WORD_RUN}')) AS run FROM blocks)""")
def _(spark, d):
    runs = B(spark, d).select(F.explode(F.regexp_extract_all("t", F.lit(C.WORD_RUN), F.lit(0))).alias("run")).distinct()
    return runs.select("run", T.norm_word(F.col("run"), compose=True).alias("norm"))


@query("deletes", f"""WITH {S.STATS} SELECT word, unnest(list_distinct(list_transform(range(1, length(word) + 1), lambda k: left(word, k - 1) || substr(word, k + 1)))) AS less FROM stats""")
def _(spark, d):
    return stats_of(spark, d).select("word", F.explode(T.deletes(F.col("word"))).alias("less"))


#: Rare words and frequent ones that share a string with one character less, or are one; as corpus_typos looks for them.
_KEYS = "unnest(list_distinct([word] || list_transform(range(1, length(word) + 1), lambda k: left(word, k - 1) || substr(word, k + 1)))) AS key"
_PAIRS = f"""{S.STATS},
        rare AS (SELECT word AS w, {_KEYS} FROM stats WHERE tf <= 3), often AS (SELECT word AS c, {_KEYS} FROM stats WHERE tf >= 30),
        pairs AS (SELECT {S.PAIR_COLUMNS} FROM (SELECT DISTINCT w, c FROM rare JOIN often USING (key) WHERE w <> c))"""


def _pairs(spark, d):
    keys = lambda rows, name: rows.select(F.col("word").alias(name), F.explode_outer(F.array_union(F.array("word"), T.deletes(F.col("word")))).alias("key"))
    stats = kept_stats(spark, d)
    return keys(stats.where("tf <= 3"), "w").join(keys(stats.where("tf >= 30"), "c"), "key").select("w", "c").where("w <> c").distinct()


@query("edit1", f"WITH {_PAIRS} SELECT w, c, {S.one_edit('w', 'c')} AS v FROM pairs")
def _(spark, d):
    return _pairs(spark, d).select("w", "c", T.is_one_edit(F.col("w"), F.col("c")).alias("v"))


@query("morph_variant", f"WITH {_PAIRS} SELECT w, c, {S.INFLECTION} AS v FROM pairs")
def _(spark, d):
    return _pairs(spark, d).select("w", "c", T.is_inflection(F.col("w"), F.col("c")).alias("v"))


_SPAN = "CAST(length(t) // 3 AS INTEGER) AS off, CAST(length(t) // 5 AS INTEGER) AS len"


def _span_blocks(spark, d):
    return B(spark, d).withColumn("off", F.floor(F.length("t") / 3).cast("int")).withColumn("len", F.floor(F.length("t") / 5).cast("int"))


@query("plain_context", f"""WITH {S.BLOCKS} SELECT {_KEY}, substr(t, greatest(0, off - 50) + 1, off - greatest(0, off - 50)) || '⟦' || substr(t, off + 1, len) || '⟧' || substr(t, off + len + 1, 50) AS v
        FROM (SELECT *, {_SPAN} FROM blocks)""")
def _(spark, d):
    return _span_blocks(spark, d).select(*KEY, T.plain_context(F.col("t"), F.col("off"), F.col("len")).alias("v"))


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _vis(x: str) -> str:
    return f"replace(replace(translate({_esc(x)}, ' ' || chr(160) || chr(8204), chr(1) || chr(1) || chr(2)), chr(1), '{T.SHOWN_SPACE}'), chr(2), '{T.SHOWN_HALF_SPACE}')"


@query("html_context", f"""WITH {S.BLOCKS} SELECT {_KEY},
            CASE WHEN off > 70 THEN '…' ELSE '' END || {_esc('substr(t, greatest(0, off - 70) + 1, off - greatest(0, off - 70))')}
            || CASE WHEN len > 0 THEN '<mark>' || {_vis('substr(t, off + 1, len)')} || '</mark>' ELSE '' END
            || '<ins>' || CASE WHEN len % 2 = 0 THEN '∅' ELSE {_vis('left(t, 6)')} END || '</ins>' || {_esc('substr(t, off + len + 1, 70)')}
            || CASE WHEN off + len + 70 < length(t) THEN '…' ELSE '' END AS v
        FROM (SELECT *, {_SPAN} FROM blocks)""")
def _(spark, d):
    sugg = F.when(F.col("len") % 2 == 0, F.lit("")).otherwise(F.left("t", F.lit(6)))
    return _span_blocks(spark, d).select(*KEY, T.html_context(F.col("t"), F.col("off"), F.col("len"), sugg).alias("v"))


# ---- typography rules -----------------------------------------------------------------------------------------


def _rule_query(rule: typography.Rule) -> None:
    @query(f"rule_{rule.id}", S.RULE_SQL.get(rule.id))
    def _(spark, d):
        hits = F.when(T.gated(F.col("t")), typography.hit_count(F.col("t"), rule)).otherwise(0)
        return B(spark, d).select("book", hits.alias("n")).groupBy("book").agg(F.sum("n").alias("n"))


for _rule in typography.RULES:
    _rule_query(_rule)


_FOUND = S.found_sql()


@query("rules_find_issues", f"WITH {_FOUND} SELECT * FROM found")
def _(spark, d):
    return typography.messages(typography.find_issues(B(spark, d)))


@query("rules_apply_safe", f"WITH {S.fixed_sql()} SELECT {_KEY}, x AS fixed, fixes FROM fixed")
def _(spark, d):
    told = F.transform(F.map_entries("fixes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return typography.apply_safe(B(spark, d).select(*KEY, "t")).select(*KEY, "fixed", F.array_join(told, ",").alias("fixes"))


@query("safe_counts", f"WITH {_FOUND} SELECT book, rule, count(*) AS n FROM found WHERE severity = 'safe' GROUP BY book, rule")
def _(spark, d):
    return I.safe_counts(typography.find_issues(B(spark, d)))


@query("safe_examples", f"""WITH {_FOUND}
        SELECT * EXCLUDE (msg_fa, msg_en) FROM (SELECT *, CAST(row_number() OVER (PARTITION BY book, rule ORDER BY file_pos, i, off) AS INTEGER) AS nth FROM found WHERE severity = 'safe') WHERE nth <= 15""")
def _(spark, d):
    return I.safe_examples(typography.find_issues(B(spark, d)))


@query("char_rule_spans", f"""WITH {S.GATED}, pieces AS (SELECT {_KEY}, regexp_extract_all(t, '[\\x{{064A}}\\x{{0649}}]') AS ms, string_split_regex(t, '[\\x{{064A}}\\x{{0649}}]') AS gs FROM gated)
        SELECT {_KEY}, ms[k] AS orig, CAST(length(array_to_string(gs[1:k], '')) + k - 1 AS INTEGER) AS off FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM pieces)""")
def _(spark, d):
    hits = B(spark, d).where(T.gated(F.col("t"))).select(*KEY, F.explode(typography.spans(F.col("t"), typography.BY_ID["arabic_yeh"].pattern)).alias("h"))
    return hits.select(*KEY, "h.orig", "h.off")


# ---- words, counts, spelling ----------------------------------------------------------------------------------


def counts_of(spark, d):
    return words.book_word_counts(B(spark, d))


def stats_of(spark, d):
    return words.word_stats(counts_of(spark, d))


def known_of(spark, d):
    """The benchmark's words in Persian letters, as a stand-in for a dictionary."""
    texts = table(spark, d, "benchmark").select(persian(F.col("text"), F.lit(1)).alias("t"))
    return words.words_only(texts).select(F.col("norm").alias("word")).distinct()


def kept_stats(spark, d):
    """The statistics, written down once for all parts of a plan that need them."""
    from ..sources import store

    return store.checkpointed(stats_of(spark, d))


def flagged_of(spark, d):
    return spelling.flagged_words(kept_stats(spark, d), known_of(spark, d))


@query("tokenize", f"WITH {S.BLOCKS}, {S.TOKENS} SELECT {_KEY}, s, e, raw, norm FROM tokens WHERE norm <> ''")
def _(spark, d):
    return words.tokens(B(spark, d)).select(*KEY, "s", "e", "raw", "norm")


@query("book_word_counts", f"WITH {S.COUNTS} SELECT * FROM counts")
def _(spark, d):
    return counts_of(spark, d)


@query("word_stats", f"WITH {S.STATS} SELECT * FROM stats")
def _(spark, d):
    return stats_of(spark, d)


_BOOK_WORDS = f"""(SELECT b.book, count(w.book) AS words FROM (SELECT DISTINCT book FROM blocks) b
            LEFT JOIN (SELECT book FROM (SELECT book, {S.norm(f"trim(run, {S.ZW})")} AS norm FROM (SELECT book, {S._RUNS} AS run FROM blocks)) WHERE norm <> '') w USING (book) GROUP BY b.book)"""


@query("book_words", f"WITH {S.BLOCKS} SELECT * FROM {_BOOK_WORDS}")
def _(spark, d):
    return words.book_words(B(spark, d))


@query("corpus_stats", f"WITH {S.STATS} SELECT (SELECT count(DISTINCT book) FROM blocks) AS books, CAST(sum(tf) AS BIGINT) AS tokens, count(*) AS types, (SELECT count(*) FROM known) AS known_words FROM stats")
def _(spark, d):
    one = stats_of(spark, d).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"), F.count("*").alias("types"))
    books = B(spark, d).agg(F.count_distinct("book").alias("books"))
    return books.crossJoin(one).crossJoin(known_of(spark, d).agg(F.count("*").alias("known_words")))


@query("zwnj_variants", f"WITH {S.VARIANTS} SELECT * FROM variants")
def _(spark, d):
    return spelling.zwnj_variants(kept_stats(spark, d), known_of(spark, d))


@query("rare_words", f"WITH {S.TYPOS} SELECT word, tf FROM rare")
def _(spark, d):
    stats, known = kept_stats(spark, d), known_of(spark, d)
    return spelling.rare_words(stats, known, spelling.zwnj_variants(stats, known)).select("word", "tf")


@query("corpus_typos", f"WITH {S.TYPOS} SELECT * FROM typos")
def _(spark, d):
    stats, known = kept_stats(spark, d), known_of(spark, d)
    return spelling.corpus_typos(stats, known, spelling.zwnj_variants(stats, known))


@query("flagged_words", f"WITH {S.FLAGGED} SELECT * FROM flagged")
def _(spark, d):
    return flagged_of(spark, d)


@query("candidates_ranked", f"WITH {S.FLAGGED} SELECT row_number() OVER (ORDER BY conf DESC, word) AS rank, * FROM flagged")
def _(spark, d):
    return spelling.rank_candidates(flagged_of(spark, d))


@query("spelling_candidates", f"WITH {S.FLAGGED} SELECT word, sugg AS suggestion, kind, tf AS count, sugg_tf AS suggestion_count, conf AS confidence FROM flagged")
def _(spark, d):
    return flagged_of(spark, d).select("word", F.col("sugg").alias("suggestion"), "kind", F.col("tf").alias("count"), F.col("sugg_tf").alias("suggestion_count"), F.col("conf").alias("confidence"))


@query("spelling_issues", f"""WITH {S.FLAGGED}, {S.TOKENS}
        SELECT book, file, i, s AS off, CAST(e - s AS INTEGER) AS len, raw AS orig, sugg, kind AS rule, 'review' AS severity, CASE WHEN kind = 'corpus_typo' THEN 'spelling' ELSE 'typography' END AS category, conf,
               CASE WHEN kind = 'corpus_typo' THEN 'Likely typo; common form across the corpus: ' ELSE 'ZWNJ spacing inconsistent with the rest of the corpus; common form: ' END || sugg || ' (' || sugg_tf || '×)' AS msg_en
        FROM tokens JOIN flagged ON norm = word WHERE (book, file, i) IN (SELECT (book, file, i) FROM blocks WHERE NOT {S.arabic()})""")
def _(spark, d):
    from ..sources import store

    lines = B(spark, d)
    return spelling.spelling_issues(lines.select(*KEY, "t"), store.checkpointed(flagged_of(spark, d))).drop("msg_fa")


# ---- findings, counts, reports --------------------------------------------------------------------------------


def findings(spark, d):
    """Findings made up from events; the same as in the SQL."""
    e, third = table(spark, d, "events"), F.col("event_id") % 3
    case = F.when(third == 0, "rules").when(third == 1, "spelling").otherwise("grammar")
    severity = F.when((third == 0) & (F.col("event_id") % 4 < 2), "safe").when(F.col("event_id") % 12 == 6, "style").otherwise("review")
    fifth = F.col("event_id") % 5
    category = F.when(fifth == 0, "grammar").when(fifth == 1, "spelling").when(fifth == 2, "style").otherwise("typography")
    return e.select(
        F.concat(F.lit("b"), F.col("user_id") % 40).alias("book"), F.concat(F.lit("f"), fifth).alias("f"), (F.col("event_id") % 4).cast("int").alias("i"),
        (F.floor(F.col("event_id") / 7) % 9 * 5).cast("int").alias("off"), (2 + F.floor(F.col("event_id") / 3) % 2).cast("int").alias("len"), case.alias("source"), severity.alias("severity"),
        category.alias("category"), F.concat(F.lit("r"), F.col("event_id") % 6).alias("rule"), F.when(third == 0, None).otherwise(F.round(F.col("event_id") % 100 / 100, 2)).alias("conf"), F.col("event_id").alias("seq"))


def deduped(spark, d):
    return I.dedup(findings(spark, d))


@query("union_sources", f"WITH {S.FINDINGS} SELECT source, count(*) AS n FROM findings GROUP BY source")
def _(spark, d):
    return I.union_sources(*[findings(spark, d).where(F.col("source") == s) for s in I.SOURCES]).groupBy("source").agg(F.count("*").alias("n"))


@query("dedup_issues", f"WITH {S.DEDUP} SELECT * FROM deduped")
def _(spark, d):
    return deduped(spark, d).select("book", "f", "i", "off", "len", "source", "severity", "category", "rule", "conf", "seq")


@query("issues_min_conf", f"WITH {S.DEDUP} SELECT * FROM deduped WHERE coalesce(conf, 1) >= 0.6")
def _(spark, d):
    return I.at_least(deduped(spark, d), 0.6).select("book", "f", "i", "off", "len", "source", "severity", "category", "rule", "conf", "seq")


_COUNTS = "count(*) FILTER (category = 'grammar') AS grammar, count(*) FILTER (category = 'spelling') AS spelling, count(*) FILTER (category = 'typography') AS typography, count(*) FILTER (category = 'style') AS style"
_REVIEW = f"WITH {S.DEDUP}, tallies AS (SELECT book, {_COUNTS} FROM deduped WHERE severity <> 'safe' GROUP BY book)"


@query("category_counts", f"{_REVIEW} SELECT * FROM tallies")
def _(spark, d):
    return I.category_counts(I.for_review(deduped(spark, d)))


_BOOKS = "books AS (SELECT 'b' || (user_id % 45) AS book, sum(length(event_type)) AS words FROM events GROUP BY 1 UNION ALL SELECT 'b-none', 0)"
_DENSITY = f"""{_REVIEW}, {_BOOKS},
        density AS (SELECT book, CAST(words AS BIGINT) AS words, coalesce(grammar, 0) AS grammar, coalesce(spelling, 0) AS spelling, coalesce(typography, 0) AS typography, coalesce(style, 0) AS style,
                           (coalesce(grammar, 0) + coalesce(spelling, 0) + coalesce(typography, 0)) / CASE WHEN words = 0 THEN 1 ELSE words END * 1000 AS density
                    FROM books LEFT JOIN tallies USING (book))"""


def _books(spark, d):
    seen = table(spark, d, "events").groupBy(F.concat(F.lit("b"), F.col("user_id") % 45).alias("book")).agg(F.sum(F.length("event_type")).alias("words"))
    return seen.unionByName(spark.sql("SELECT 'b-none' AS book, 0L AS words"))


def density(spark, d):
    return I.book_density(_books(spark, d), I.category_counts(I.for_review(deduped(spark, d))))


@query("book_density", f"{_DENSITY} SELECT * FROM density")
def _(spark, d):
    return density(spark, d)


@query("report_totals", f"""{_DENSITY}, safe AS (SELECT book, count(*) AS n FROM findings WHERE severity = 'safe' GROUP BY book)
        SELECT count(*) AS books, CAST(sum(words) AS BIGINT) AS words, CAST(sum(coalesce(n, 0)) AS BIGINT) AS safe, CAST(sum(grammar) AS BIGINT) AS grammar, CAST(sum(spelling) AS BIGINT) AS spelling,
               CAST(sum(typography) AS BIGINT) AS typography, CAST(sum(style) AS BIGINT) AS style FROM density LEFT JOIN safe USING (book)""")
def _(spark, d):
    return I.totals(density(spark, d), I.safe_counts(findings(spark, d)))


@query("report_summary", f"""{_DENSITY}, safe AS (SELECT book, count(*) AS n FROM findings WHERE severity = 'safe' GROUP BY book)
        SELECT 'T-' || book AS book, book AS file, words, grammar, spelling, typography AS typography_review, style, coalesce(n, 0) AS auto_fixed, round(density, 2) AS issues_per_1000_words, '' AS error FROM density LEFT JOIN safe USING (book)
        UNION ALL SELECT '', 'bad.epub', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no zip'""")
def _(spark, d):
    from ..operators import report

    fine = _books(spark, d).select(F.col("book").alias("id"), F.col("book").alias("rel"), F.concat(F.lit("T-"), "book").alias("title"), F.lit(None).cast("string").alias("error"))
    every = fine.unionByName(spark.sql("SELECT 'bad' AS id, 'bad.epub' AS rel, CAST(NULL AS string) AS title, 'no zip' AS error"))
    return report.summary(every, density(spark, d), I.safe_counts(findings(spark, d)))


# what the rules leave to a reviewer, in full
@query("report_all_issues", f"""WITH {_FOUND}
        SELECT 'T-' || book AS book, file, i AS paragraph, category, rule, 'rules' AS source, orig AS original, sugg AS suggestion, CAST(NULL AS DOUBLE) AS confidence, msg_fa AS message,
               substr(t, greatest(0, off - 50) + 1, off - greatest(0, off - 50)) || '⟦' || substr(t, off + 1, len) || '⟧' || substr(t, off + len + 1, 50) AS context
        FROM found JOIN (SELECT book, file, i, t FROM gated) USING (book, file, i) WHERE severity <> 'safe'""")
def _(spark, d):
    from ..operators import report

    lines = B(spark, d)
    titles = lines.select("book").distinct().withColumn("title", F.concat(F.lit("T-"), "book"))
    return report.all_issues(_left_to_review(lines), lines, titles)


def _left_to_review(lines, hits=None):
    hits = typography.find_issues(lines.withColumnRenamed("file", "f")) if hits is None else hits
    found = typography.messages(hits).withColumn("source", F.lit("rules")).withColumn("conf", F.lit(None).cast("double"))
    spines = lines.groupBy("book").agg(F.transform(F.array_sort(F.collect_set(F.struct("file_pos", "file"))), lambda x: x["file"]).alias("spine"))
    return I.review_order(I.for_review(found).withColumn("seq", typography.priority(F.col("rule"))), spines)


@query("issue_context", f"""WITH {S.BLOCKS}, {S.FINDINGS}
        SELECT file_pos, fi.i, seq, substr(x, greatest(0, off - 50) + 1, off - greatest(0, off - 50)) || '⟦' || substr(x, off + 1, len) || '⟧' || substr(x, off + len + 1, 50) AS context
        FROM (SELECT *, seq % (SELECT count(*) FROM documents) AS file_pos FROM findings) fi LEFT JOIN (SELECT file_pos, i, t FROM blocks) b USING (file_pos, i), LATERAL (SELECT coalesce(t, '') AS x)""")
def _(spark, d):
    n = table(spark, d, "documents").count()
    found = findings(spark, d).drop("book", "f").withColumn("file_pos", F.col("seq") % n).withColumn("book", F.lit("x")).withColumn("f", F.col("file_pos").cast("string"))
    lines = B(spark, d).withColumn("book", F.lit("x"))
    return I.with_context(found, lines).select("file_pos", "i", "seq", "context")


@query("review_order", f"""WITH {S.DEDUP}, spine AS (SELECT unnest(['f3', 'f0', 'f4', 'f1']) AS f, unnest(range(4)) AS place)
        SELECT book, f, i, off, seq, CAST(row_number() OVER (PARTITION BY book ORDER BY place NULLS LAST, i, off, list_position(['rules', 'spelling', 'grammar'], string_split(source, '+')[1]), seq) AS INTEGER) AS nth
        FROM deduped LEFT JOIN spine USING (f)""")
def _(spark, d):
    spines = _books(spark, d).select("book", F.array(*[F.lit(f) for f in ("f3", "f0", "f4", "f1")]).alias("spine"))
    return I.review_order(deduped(spark, d), spines).select("book", "f", "i", "off", "seq", "nth")


_TALLY = "count(*) FILTER (category = '{0}') AS {0}"


# the flagship: books by the density of all that the rules leave to a reviewer; style does not count
@query("top_books_by_density", f"""WITH {_FOUND}, tallies AS (SELECT book, {', '.join(_TALLY.format(c) for c in I.CATEGORIES)} FROM found WHERE severity <> 'safe' GROUP BY book)
        SELECT *, (grammar + spelling + typography) / CASE WHEN words = 0 THEN 1 ELSE words END * 1000 AS density
        FROM (SELECT book, words, {', '.join(f'coalesce({c}, 0) AS {c}' for c in I.CATEGORIES)} FROM {_BOOK_WORDS} LEFT JOIN tallies USING (book))""")
def top_books_by_density(spark, d):
    lines = B(spark, d)
    counts = I.category_counts(I.for_review(typography.find_issues(lines.select("book", "t"))))
    return I.top_books(I.book_density(words.book_words(lines), counts))


# ---- sources --------------------------------------------------------------------------------------------------

_REL = "replace(replace(url, 'https://', ''), 'http://', '')"


def _files(spark, d):
    return table(spark, d, "pages").select("page_id", F.replace(F.replace("url", F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")).alias("rel"), F.length("html").cast("bigint").alias("size"), (F.col("page_id") * 7 % 1000).alias("mtime"), "html")


@query("book_id", f"SELECT page_id, substr(sha1({_REL}), 1, 12) AS id FROM pages")
def _(spark, d):
    return _files(spark, d).select("page_id", lists.book_id(F.col("rel")).alias("id"))


_TITLE = "CASE WHEN page_id % 3 = 0 THEN ' ' WHEN page_id % 3 = 1 THEN NULL ELSE ' T' || page_id || ' ' END"


@query("src_title", f"""SELECT page_id, CASE WHEN trim(coalesce(x, '')) <> '' THEN trim(x) ELSE regexp_replace(string_split({_REL}, '/')[-1], '(.)\\.[^.]*$', '\\1') END AS title
        FROM (SELECT *, {_TITLE} AS x FROM pages)""")
def _(spark, d):
    title = F.when(F.col("page_id") % 3 == 0, " ").when(F.col("page_id") % 3 == 1, None).otherwise(F.concat(F.lit(" T"), F.col("page_id"), F.lit(" ")))
    return _files(spark, d).select("page_id", lists.title_or_stem(title, F.col("rel")).alias("title"))


@query("incremental_scan", f"""WITH now AS (SELECT {_REL} AS rel, length(html) AS size, page_id * 7 % 1000 AS mtime, page_id FROM pages),
        before AS (SELECT rel, size + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS size, mtime, CASE WHEN page_id % 7 = 0 THEN 'x' END AS error FROM now WHERE page_id % 4 <> 0)
        SELECT n.rel, n.size, n.mtime, coalesce(n.size = b.size AND n.mtime = b.mtime AND b.error IS NULL, false) AS cached FROM now n LEFT JOIN before b USING (rel)""")
def _(spark, d):
    now = _files(spark, d)
    before = now.where("page_id % 4 <> 0").select("rel", (F.col("size") + F.when(F.col("page_id") % 5 == 0, 1).otherwise(0)).alias("size"), "mtime", F.when(F.col("page_id") % 7 == 0, "x").alias("error"))
    return lists.plan_scan(now, before)


# by id, by path and by file name; of these the first by path
_ONLY = "id IN (SELECT substr(sha1(rel), 1, 12) FROM files WHERE page_id IN (2, 7, 9)) OR rel IN (SELECT rel FROM files WHERE page_id IN (4, 5)) OR name IN (SELECT name FROM files WHERE page_id IN (3, 8, 13))"


@query("select_books", f"""WITH files AS (SELECT page_id, {_REL} AS rel, substr(sha1({_REL}), 1, 12) AS id, string_split({_REL}, '/')[-1] AS name FROM pages)
        SELECT page_id FROM files WHERE page_id % 7 <> 0 AND ({_ONLY}) ORDER BY rel LIMIT 5""")
def _(spark, d):
    books = _files(spark, d).select("page_id", "rel", lists.book_id(F.col("rel")).alias("id"), F.when(F.col("page_id") % 7 == 0, "x").alias("error"))
    named = books.where("page_id IN (2, 3, 4, 5, 7, 8, 9, 13)").select("page_id", "rel", "id").collect()
    only = [r["id"] if r["page_id"] in (2, 7, 9) else r["rel"] if r["page_id"] in (4, 5) else r["rel"].rpartition("/")[2] for r in named]
    return lists.select_books(books, only=only, limit=5).select("page_id")


@query("load_wordlist", f"""WITH lines AS (SELECT item_id AS line_no, CASE item_id % 4 WHEN 0 THEN left(x, 9) || '/AB' WHEN 1 THEN '# ' || x WHEN 2 THEN left(x, 7) || chr(9) || 'y' ELSE ' ' END AS line FROM (SELECT item_id, {S._sql_text()} AS x FROM benchmark)),
        entries AS (SELECT trim(string_split(string_split(trim(line), '/')[1], chr(9))[1]) AS w FROM lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND NOT (line_no = 0 AND regexp_matches(trim(line), '^[0-9]+$')))
        SELECT DISTINCT word FROM (SELECT {S.norm('w')} AS word FROM entries) WHERE word <> ''""")
def _(spark, d):
    x, k = persian(F.col("text"), F.lit(1)), F.col("item_id") % 4
    line = F.when(k == 0, F.concat(F.left(x, F.lit(9)), F.lit("/AB"))).when(k == 1, F.concat(F.lit("# "), x)).when(k == 2, F.concat(F.left(x, F.lit(7)), F.lit("\ty"))).otherwise(" ")
    return lists.words_of_lines(table(spark, d, "benchmark").select(F.col("item_id").alias("line_no"), line.alias("line")))


_REGISTER_ROWS = "SELECT doc_id AS line, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'd' || doc_id % 20 END AS file, CASE WHEN doc_id % 2 = 0 THEN ' d' || doc_id % 15 || ' ' END AS book, ' g' || quality || ' ' AS register FROM labels"


@query("load_registers", f"SELECT file, arg_max(register, line) AS register FROM (SELECT line, trim(CASE WHEN coalesce(file, '') <> '' THEN file ELSE coalesce(book, '') END) AS file, trim(register) AS register FROM ({_REGISTER_ROWS})) WHERE file <> '' GROUP BY file")
def _(spark, d):
    rows = table(spark, d, "labels").select(
        F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("d"), F.col("doc_id") % 20)).alias("file"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" d"), F.col("doc_id") % 15, F.lit(" "))).alias("book"), F.concat(F.lit(" g"), "quality", F.lit(" ")).alias("register"))
    return lists.registers_of_rows(rows)


@query("register_lookup", """WITH books AS (SELECT 'b' || doc_id AS book, 'dir/' || doc_id % 50 || '/n' || doc_id % 60 AS rel FROM documents),
        regs AS (SELECT 'dir/' || n || '/n' || n AS file, CASE WHEN n % 4 = 0 THEN '' ELSE 'rel' || n END AS register FROM range(0, 60) t(n) UNION ALL SELECT 'n' || n, 'name' || n FROM range(0, 30) t(n) UNION ALL SELECT 'b' || n, 'id' || n FROM range(0, 500) t(n))
        SELECT book, coalesce(nullif(a.register, ''), nullif(b.register, ''), nullif(c.register, '')) AS register
        FROM books LEFT JOIN regs a ON a.file = rel LEFT JOIN regs b ON b.file = string_split(rel, '/')[-1] LEFT JOIN regs c ON c.file = book""")
def _(spark, d):
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    books = table(spark, d, "documents").select(text("b", F.col("doc_id")).alias("book"), text("dir/", F.col("doc_id") % 50, "/n", F.col("doc_id") % 60).alias("rel"))
    n = F.col("id")
    regs = spark.range(60).select(text("dir/", n, "/n", n).alias("file"), F.when(n % 4 == 0, "").otherwise(text("rel", n)).alias("register")).unionByName(
        spark.range(30).select(text("n", n).alias("file"), text("name", n).alias("register"))).unionByName(spark.range(500).select(text("b", n).alias("file"), text("id", n).alias("register")))
    return review.registers_of(books, regs)


@query("store_roundtrip", f"WITH {S.BLOCKS} SELECT book, file, file_pos, i, t FROM blocks")
def _(spark, d):
    from ..sources import store

    place = store.scratch(spark, "store_roundtrip")
    store.write_blocks(B(spark, d), place)
    return store.read_blocks(spark, place)


@query("extract_blocks")
def _(spark, d):
    return html_blocks.extract_blocks(table(spark, d, "pages").select("page_id", "html"))


@query("fix_markup")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", persian_markup(F.col("html")).alias("html"))
    return markup.fix_markup(pages).select("page_id", "fixed", F.map_entries("fixes").alias("fixes"))


@query("fix_counts")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", persian_markup(F.col("html")).alias("html"))
    return markup.fix_counts(markup.fix_markup(pages), "page_id")


def persian_markup(html):
    """Paragraphs' text in Persian letters, tags as they are: upper-case vowels stand for the tags' own letters."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?<=>)([^<]*) the ", "$1 می "), r"(?<=>)([^<]*) of ", "$1 از,"), r"(?<=>)([^<]*) and ", "$1 كتاب ")


# ---- reviewers ------------------------------------------------------------------------------------------------

_CHUNKS = f"""WITH RECURSIVE {S.BLOCKS},
        ready AS MATERIALIZED (SELECT book, file AS f, file_pos, i, t, length(t) AS n, row_number() OVER (PARTITION BY book ORDER BY file_pos, i) AS k FROM blocks WHERE length(t) >= 12 AND {S.gated()}),
        packed AS (
            SELECT book, k, n AS size, 0 AS chunk, 0 AS pos FROM ready WHERE k = 1
            UNION ALL
            SELECT r.book, r.k, CASE WHEN p.size + r.n > 6000 THEN r.n ELSE p.size + r.n END, CASE WHEN p.size + r.n > 6000 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.size + r.n > 6000 THEN 0 ELSE p.pos + 1 END
            FROM packed p JOIN ready r ON r.book = p.book AND r.k = p.k + 1),
        chunked AS (SELECT book, chunk, pos, f, i, t FROM packed JOIN ready USING (book, k))"""
_MESSAGES = f"""{_CHUNKS}, messages AS (
            SELECT book, chunk, CASE WHEN book < 'src5' THEN 'Book register/genre note: ' || book || chr(10) || chr(10) ELSE '' END || string_agg('[' || (pos + 1) || '] ' || t, chr(10) || chr(10) ORDER BY pos) AS content FROM chunked GROUP BY book, chunk),
        requests AS MATERIALIZED (SELECT row_number() OVER (ORDER BY book, chunk) - 1 AS nth, book, chunk, content FROM messages)"""


def packed(spark, d):
    return review.chunks(B(spark, d))


def requests(spark, d, **how):
    # of every source, also of one without blocks: only packed books look theirs up
    books = table(spark, d, "documents").select(F.col("source").alias("book")).distinct()
    return review.requests(packed(spark, d), books.select("book", F.when(F.col("book") < "src5", F.col("book")).alias("register")), "any", **how)


@query("chunk_paragraphs", f"{_CHUNKS} SELECT * FROM chunked")
def _(spark, d):
    return packed(spark, d).select("book", "chunk", "pos", "f", "i", "t")


@query("user_message", f"{_MESSAGES} SELECT book, content FROM requests")
def _(spark, d):
    return requests(spark, d).select("book", "content")


@query("grammar_requests", f"{_MESSAGES} SELECT 'c' || lpad(CAST(nth AS VARCHAR), 7, '0') AS cid, nth, book, content FROM requests")
def _(spark, d):
    return requests(spark, d).select("cid", "nth", "book", "content")


_PROMPT = review.PROMPT.replace("'", "''")


@query("request_params", f"""{_MESSAGES} SELECT 'c' || lpad(CAST(nth AS VARCHAR), 7, '0') AS cid,
        CAST(json_object('model', 'any', 'max_tokens', {review.MAX_TOKENS}, 'system', '{_PROMPT}', 'messages', json_array(json_object('role', 'user', 'content', content))) AS VARCHAR) AS params FROM requests""")
def _(spark, d):
    return requests(spark, d).select("cid", "params")


@query("batch_partition", f"{_MESSAGES} SELECT nth // 50 AS batch, count(*) AS n, 'c' || lpad(CAST(min(nth) AS VARCHAR), 7, '0') AS first_cid, 'c' || lpad(CAST(max(nth) AS VARCHAR), 7, '0') AS last_cid FROM requests GROUP BY 1")
def _(spark, d):
    # batches of 50, as the made-up books ask for fewer requests than one full batch takes
    return review.batches(requests(spark, d, per_batch=50))


@query("systematic_sample", f"{_MESSAGES}, one AS (SELECT greatest(1, count(*) // 25) AS step FROM requests) SELECT nth, book FROM requests, one WHERE nth % step = 0 AND nth < step * 25")
def _(spark, d):
    rows = requests(spark, d)
    return review.systematic_sample(rows, rows.count()).select("nth", "book")


@query("cost_estimate", f"""{_MESSAGES}, one AS (SELECT greatest(1, count(*) // 25) AS step FROM requests),
        est AS (SELECT (SELECT count(*) FROM requests) AS requests, (SELECT sum(length(content)) FROM requests) AS chars, floor(sum(length(content) // 3) / count(*) * (SELECT count(*) FROM requests)) AS est_in FROM requests, one WHERE nth % step = 0 AND nth < step * 25)
        SELECT requests, chars, CAST(est_in AS BIGINT) AS est_in, 60 * requests AS out_low, 600 * requests AS out_high, est_in / 1e6 * 0.5 + 60 * requests / 1e6 * 2.5 AS cost_low, est_in / 1e6 * 0.5 + 600 * requests / 1e6 * 2.5 AS cost_high FROM est""")
def _(spark, d):
    return review.estimate(requests(spark, d), lambda c: F.floor(F.length(c) / 3), 0.5, 2.5)


# answers made up from conversations: the first turns' texts are paragraphs, and every answer doubts some of them
_ITEMS = f"""told AS (SELECT conv_id, turn, replace({S._sql_text()}, '"', '') AS t FROM conversations),
        items AS MATERIALIZED (SELECT 'c' || conv_id AS cid, 'b' || conv_id % 9 AS book, CAST(turn + 1 AS INTEGER) AS p, 'f' || turn AS f, CAST(turn AS INTEGER) AS i, regexp_replace(t, '{C.WHITE_RUN}', ' ', 'g') AS t FROM told),
        claims AS (
            SELECT cid, book, p, '{{"p":' || CASE p % 4 WHEN 0 THEN '"' || p || '"' ELSE CAST(p AS VARCHAR) END || ',"original":"' || CASE p % 5 WHEN 0 THEN 'zzz' WHEN 1 THEN translate(substr(t, 3, 6), 'يك', 'یک') ELSE substr(t, 2, 7) END
                   || '","suggestion":"' || CASE WHEN p % 6 = 2 THEN substr(t, 2, 7) ELSE 'x' END || '","type":"' || CASE WHEN p % 2 = 0 THEN 'spelling' ELSE 'grammar' END || '","confidence":' || CASE p % 3 WHEN 0 THEN '0.55' ELSE '0.75' END || '}}' AS c FROM items),
        answers AS MATERIALIZED (
            SELECT cid, book, CASE WHEN book = 'b3' THEN 'no json' ELSE 'Here: {{"issues":[' || string_agg(c, ',' ORDER BY p) || ',5,{{"p":99,"original":"a"}}]}} end' END AS text FROM claims GROUP BY cid, book)"""
_PARSED = f"""WITH {_ITEMS.replace('{{', '{').replace('}}', '}')},
        parsed AS (SELECT cid, book, unnest(json_extract(substr(text, instr(text, '{{'), length(text) - instr(reverse(text), '}}') + 2 - instr(text, '{{')), '$.issues[*]')) AS x FROM answers WHERE instr(text, '{{') > 0),
        objects AS (SELECT cid, book, x FROM parsed WHERE json_type(x) = 'OBJECT'),
        fields AS (
            SELECT cid, book, CAST(try_cast(json_extract_string(x, '$.p') AS DOUBLE) AS INTEGER) AS p, trim(coalesce(json_extract_string(x, '$.original'), '')) AS original, trim(coalesce(json_extract_string(x, '$.suggestion'), '')) AS sugg,
                   coalesce(json_extract_string(x, '$.type'), 'grammar') AS type, coalesce(try_cast(json_extract_string(x, '$.confidence') AS DOUBLE), 0.5) AS conf FROM objects),
        verified AS (
            SELECT f.cid, f.book, p, original, sugg, type, conf, items.f, items.i, items.t,
                   CASE WHEN instr(t, original) > 0 THEN instr(t, original) ELSE instr(translate(t, 'يىك', 'ییک'), translate(original, 'يىك', 'ییک')) END - 1 AS off
            FROM fields f LEFT JOIN (SELECT cid, p, f, i, t FROM items) items USING (cid, p)),
        judged AS MATERIALIZED (SELECT *, coalesce(t IS NOT NULL AND original <> '' AND original <> sugg AND conf >= 0.6 AND off >= 0, false) AS ok FROM verified)""".replace("'{{'", "'{'").replace("'}}'", "'}'")


def answers(spark, d):
    told = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.replace(persian(F.col("text"), F.lit(1)), F.lit('"'), F.lit("")), F.lit(C.WHITE_RUN), F.lit(" ")).alias("t"))
    items = told.select(F.concat(F.lit("c"), "conv_id").alias("cid"), F.concat(F.lit("b"), F.col("conv_id") % 9).alias("book"), (F.col("turn") + 1).cast("int").alias("p"), F.concat(F.lit("f"), "turn").alias("f"), F.col("turn").cast("int").alias("i"), "t")
    p, text = F.col("p"), lambda s: F.lit(s)
    original = F.when(p % 5 == 0, "zzz").when(p % 5 == 1, F.translate(F.substr("t", F.lit(3), F.lit(6)), "يك", "یک")).otherwise(F.substr("t", F.lit(2), F.lit(7)))
    claim = F.concat(text('{"p":'), F.when(p % 4 == 0, F.concat(text('"'), p, text('"'))).otherwise(p.cast("string")), text(',"original":"'), original, text('","suggestion":"'),
                     F.when(p % 6 == 2, F.substr("t", F.lit(2), F.lit(7))).otherwise("x"), text('","type":"'), F.when(p % 2 == 0, "spelling").otherwise("grammar"), text('","confidence":'), F.when(p % 3 == 0, "0.55").otherwise("0.75"), text("}"))
    joined = items.groupBy("cid", "book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", claim.alias("c")))), lambda x: x["c"]), ",").alias("c"))
    return items, joined.select("cid", "book", F.when(F.col("book") == "b3", "no json").otherwise(F.concat(text('Here: {"issues":['), "c", text(',5,{"p":99,"original":"a"}]} end'))).alias("text"))


@query("parse_issues", f"{_PARSED} SELECT cid, count(*) AS n FROM objects GROUP BY cid")
def _(spark, d):
    parsed = answers(spark, d)[1].select("cid", F.explode(review.parse_issues(F.col("text"))).alias("x"))
    return parsed.groupBy("cid").agg(F.count("*").alias("n"))


@query("verify_issues", f"{_PARSED} SELECT cid, book, p, f, i, CAST(off AS INTEGER) AS off, CAST(length(original) AS INTEGER) AS len, substr(t, off + 1, length(original)) AS orig, sugg, 'llm_' || type AS rule, CASE WHEN type = 'spelling' THEN 'spelling' ELSE 'grammar' END AS category, round(conf, 2) AS conf FROM judged WHERE ok")
def _(spark, d):
    items, told = answers(spark, d)
    return review.verify(told, items.drop("book")).where("ok").select("cid", "book", "p", "f", "i", "off", "len", "orig", "sugg", "rule", "category", "conf")


@query("verify_counts", f"{_PARSED} SELECT book, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM judged GROUP BY book")
def _(spark, d):
    items, told = answers(spark, d)
    return review.verify(told, items.drop("book")).groupBy("book").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("dropped"))


_RESULTS = """results AS MATERIALIZED (SELECT 'c' || user_id AS cid, 'r' || event_id % 7 AS file, event_id AS line, CASE WHEN event_id % 6 <> 0 THEN 't' || event_id END AS text, CASE WHEN event_id % 6 <> 0 THEN event_id % 90 END AS "in", CASE WHEN event_id % 6 <> 0 THEN event_id % 30 END AS out,
            CASE WHEN event_id % 6 = 0 THEN 'errored' END AS error FROM events)"""


def results(spark, d):
    e = table(spark, d, "events")
    fine, n = F.col("event_id") % 6 != 0, F.col("event_id")
    return e.select(F.concat(F.lit("c"), "user_id").alias("cid"), F.concat(F.lit("r"), n % 7).alias("file"), n.alias("line"), F.when(fine, F.concat(F.lit("t"), n)).alias("text"), F.when(fine, n % 90).alias("in"), F.when(fine, n % 30).alias("out"), F.when(~fine, "errored").alias("error"))


@query("latest_result", f"WITH {_RESULTS} SELECT cid, text FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY file DESC, line DESC) AS nth FROM results WHERE error IS NULL) WHERE nth = 1")
def _(spark, d):
    return review.latest_results(results(spark, d)).select("cid", "text")


@query("usage_totals", f"""WITH {_RESULTS} SELECT CAST(sum("in") AS BIGINT) AS tokens_in, CAST(sum(out) AS BIGINT) AS tokens_out, count(error) AS errors FROM results""")
def _(spark, d):
    return review.usage(results(spark, d))


@query("grammar_issues", f"{_PARSED} SELECT book, f, i, CAST(off AS INTEGER) AS off, substr(t, off + 1, length(original)) AS orig, sugg, 'llm_' || type AS rule FROM judged WHERE ok AND book <> 'b5'")
def _(spark, d):
    items, told = answers(spark, d)
    # an answer that nobody asked for, and one of each request that a later one replaces
    manifest = items.where("book <> 'b5'").groupBy("cid", "book").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "f", "i"))), lambda x: F.struct(x["f"].alias("f"), x["i"].alias("i"))).alias("items"))
    early = told.select("cid", F.lit("a").alias("file"), F.lit(0).alias("line"), F.lit('{"issues":[]}').alias("text"), F.lit(None).cast("string").alias("error"))
    late = told.select("cid", F.lit("b").alias("file"), F.lit(0).alias("line"), "text", F.lit(None).cast("string").alias("error"))
    blocks = items.select(F.concat("cid", F.lit("/"), "f").alias("file"), "book", "i", "t")
    manifest = manifest.withColumn("items", F.transform("items", lambda x: F.struct(F.concat("cid", F.lit("/"), x["f"]).alias("f"), x["i"].alias("i"))))
    out = review.rebuild_issues(manifest, early.unionByName(late), blocks).where("ok")
    return out.select("book", F.substring_index("f", "/", -1).alias("f"), "i", "off", "orig", "sugg", "rule")


@query("llm_pilot")
def _(spark, d):
    return review.run_reviewer(requests(spark, d), review.offline_reviewer)


# ---- books in ePub files, synthesised from pages ---------------------------------------------------------------

PAGES_PER_BOOK = 5


def epub_files(spark, d):
    """rel, size, mtime and content of books made up from pages, five to each; every eleventh is broken."""
    import io
    import zipfile

    import pyarrow as pa

    def make(batches):
        for batch in batches:
            for n, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    put = lambda name, text, how=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), text, how)
                    put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
                    put("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
                    # names with spaces, a picture and a missing item in the spine, and a document that is there twice
                    items = "".join(f'<item id="d{k}" href="Text/{k}%20a.xhtml#top" media-type="application/xhtml+xml"/>' for k in range(len(docs))) + '<item id="cover" href="cover.png" media-type="image/png"/>'
                    spine = '<itemref idref="cover"/>' + "".join(f'<itemref idref="d{k}"/>' for k in reversed(range(len(docs)))) + '<itemref idref="none"/><itemref idref="d0"/>'
                    put("OPS/book.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> Book {n} </dc:title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
                    for k, doc in enumerate(docs):
                        put(f"OPS/Text/{k} a.XHTML", doc)
                data = out.getvalue() if n % 11 else b"broken"
                yield pa.RecordBatch.from_arrays([pa.array([f"shelf/{n}.epub"]), pa.array([len(data)]), pa.array([n]), pa.array([data], pa.binary())], names=["rel", "size", "mtime", "content"])

    pages = table(spark, d, "pages").select(F.floor(F.col("page_id") / PAGES_PER_BOOK).alias("n"), "page_id", persian_markup(F.col("html")).alias("html"))
    grouped = pages.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "html"))), lambda p: p["html"]).alias("docs"))
    return grouped.mapInArrow(make, "rel string, size bigint, mtime bigint, content binary")


@query("src_find_files", "SELECT DISTINCT 'shelf/' || page_id // 5 || '.epub' AS rel, true AS sized FROM pages")
def _(spark, d):
    from ..sources import epub, store

    place = store.scratch(spark, "src_find_files")
    store.write_files(epub_files(spark, d).unionByName(spark.sql("SELECT 'other.txt' AS rel, 1L AS size, 0L AS mtime, CAST('x' AS binary) AS content")), place, "rel", "content")
    return epub.find_files(spark, place).select("rel", (F.col("size") > 0).alias("sized"))


def _opened(spark, d):
    from ..sources import epub

    return epub.open_books(epub_files(spark, d))


@query("src_epub_open", """SELECT 'shelf/' || n || '.epub' AS rel, n AS mtime, CASE WHEN n % 11 <> 0 THEN 'Book ' || n END AS title, n % 11 = 0 AS broken FROM (SELECT DISTINCT page_id // 5 AS n FROM pages)""")
def _(spark, d):
    return _opened(spark, d).select("rel", "mtime", "title", F.col("error").isNotNull().alias("broken"))


@query("src_spine_order", """SELECT 'shelf/' || n || '.epub' AS rel, CAST(k - 1 - j AS INTEGER) AS file_pos, 'OPS/Text/' || j || ' a.XHTML' AS file
        FROM (SELECT n, k, unnest(range(k)) AS j FROM (SELECT page_id // 5 AS n, count(*) AS k FROM pages GROUP BY 1)) WHERE n % 11 <> 0""")
def _(spark, d):
    return _opened(spark, d).where("error IS NULL").select("rel", F.posexplode("spine").alias("file_pos", "file"))


@query("book_blocks")
def _(spark, d):
    from ..sources import epub

    return epub.book_blocks(_opened(spark, d))


@query("fix_epub")
def _(spark, d):
    files = epub_files(spark, d)
    return markup.fix_counts(markup.fix_books(files, _opened(spark, d).where("error IS NULL").select("rel", "spine")), "rel")


@query("report_book_page")
def _(spark, d):
    from ..operators import report

    from ..sources import store

    lines = B(spark, d)
    # looked for once, and written down for the parts of the page
    hits = store.checkpointed(typography.find_issues(lines.withColumnRenamed("file", "f")))
    review_rows = _left_to_review(lines, hits)
    hits = typography.messages(hits)
    told = I.book_density(words.book_words(lines), I.category_counts(review_rows))
    return report.book_pages(told, review_rows, I.safe_examples(hits), I.safe_counts(hits), lines)


# ---- sinks and the life of batches ----------------------------------------------------------------------------


@query("sink_tables", f"WITH {S.FINDINGS} SELECT source, count(*) AS n, CAST(sum(off) AS BIGINT) AS offsets, count(conf) AS sure FROM findings GROUP BY source")
def _(spark, d):
    from ..sources import store

    place = store.scratch(spark, "sink_tables")
    for source in I.SOURCES:  # one after another: each replaces its own partition only
        store.write_issues(findings(spark, d).where(F.col("source") == source), place)
    return store.read_issues(spark, place).groupBy("source").agg(F.count("*").alias("n"), F.sum("off").cast("bigint").alias("offsets"), F.count("conf").alias("sure"))


@query("report_index")
def _(spark, d):
    from ..operators import report

    unreadable = _opened(spark, d).where("error IS NOT NULL")
    return spark.createDataFrame([("index.html", report.index_page(density(spark, d), unreadable))], "name string, html string")


#: Requests that were asked for in batches of 50; of some, no answer came at all.
_ASKED = "SELECT 'c' || n AS cid, n // 50 AS batch FROM range(0, (SELECT max(user_id) + 100 FROM events)) AS t(n)"


@query("batch_status", f"""WITH {_RESULTS}, rows AS ({_ASKED}),
        best AS (SELECT cid, max(CASE WHEN error IS NULL THEN 1 ELSE 0 END) AS fine FROM results GROUP BY cid)
        SELECT batch, count(*) AS n, min(cid) AS first_cid, max(cid) AS last_cid, count(*) FILTER (fine = 1) AS answered, count(*) FILTER (fine = 0) AS failed, count(*) FILTER (fine IS NULL) AS open, count(*) FILTER (fine IS NULL) = 0 AS collected
        FROM rows LEFT JOIN best USING (cid) GROUP BY batch""")
def _(spark, d):
    asked = spark.range(table(spark, d, "events").agg(F.max("user_id")).first()[0] + 100)
    rows = asked.select(F.concat(F.lit("c"), "id").alias("cid"), F.floor(F.col("id") / 50).alias("batch"))
    return review.batch_status(review.batches(rows), results(spark, d), rows)


# handed over, asked after and fetched, by a client without a network
@query("llm_batches", f"""{_MESSAGES} SELECT 'batch-c' || lpad(CAST(min(nth) AS VARCHAR), 7, '0') AS id, count(*) AS n, 'any' AS model, true AS collected, 'ended' AS state, count(*) AS ok, CAST(0 AS BIGINT) AS failed FROM requests GROUP BY nth // 50""")
def _(spark, d):
    from ..operators import reviewers
    from ..sources import store

    folder = store.scratch(spark, "llm_batches")
    client = reviewers.OfflineClient(f"{folder}/offline")
    reviewers.submit(requests(spark, d, per_batch=50), folder, client, "any", 0)
    reviewers.collect(spark, folder, client)
    return reviewers.status(spark, folder, client).select("id", "n", "model", "collected", "state", "ok", "failed")
