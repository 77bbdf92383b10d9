"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

import re

from ..functions import chars as C
from ..operators.typography import RULES
from .persianized import _sql_text, blocks_sql

ZW = "chr(8204)"
MARKS = f"[{C.members(C.MARKS)}]"


def n_of(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def arabic(text: str = "t") -> str:
    return f"""({n_of(text, C.LETTER)} > 0 AND ({n_of(text, MARKS)} / greatest({n_of(text, C.LETTER)}, 1) > 0.12 OR {n_of(text, C.TEH_MARBUTA)} >= 2))"""


def gated(text: str = "t") -> str:
    return f"(regexp_matches({text}, '{C.LETTER}') AND NOT {arabic(text)})"


def norm(word: str) -> str:
    """norm_word for the projection, whose one presentation form is U+FEFB."""
    old, new = "".join(C.TO_PERSIAN), "".join(C.TO_PERSIAN.values())
    bare = f"regexp_replace(translate(replace({word}, 'ﻻ', 'لا'), '{old}', '{new}'), '[{C.members(C.MARKS)}{C.STRETCH}]', '', 'g')"
    return f"trim(regexp_replace({bare}, '\\x{{200C}}{{2,}}', {ZW}, 'g'), {ZW})"


BLOCKS = blocks_sql()
GATED = f"{BLOCKS}, gated AS MATERIALIZED (SELECT * FROM blocks WHERE {gated()})"
_RUNS = f"unnest(regexp_extract_all(t, '{C.WORD_RUN}'))"
COUNTS = f"""{BLOCKS},
        runs AS (SELECT book, {norm(f"trim(run, {ZW})")} AS norm FROM (SELECT book, {_RUNS} AS run FROM blocks WHERE NOT {arabic()})),
        counts AS MATERIALIZED (SELECT book, norm, count(*) AS n FROM runs WHERE norm <> '' GROUP BY book, norm)"""
STATS = f"""{COUNTS},
        stats AS MATERIALIZED (SELECT norm AS word, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM counts GROUP BY norm),
        known AS MATERIALIZED (
            SELECT DISTINCT word FROM (
                SELECT {norm(f"trim(run, {ZW})")} AS word
                FROM (SELECT unnest(regexp_extract_all({_sql_text()}, '{C.WORD_RUN}')) AS run FROM benchmark)) WHERE word <> '')"""
VARIANTS = f"""{STATS},
        forms AS (SELECT word, tf, replace(word, {ZW}, '') AS base FROM stats),
        best AS (SELECT base, max(tf) AS most, count(*) AS forms FROM forms GROUP BY base HAVING count(*) > 1 AND max(tf) >= 20),
        leaders AS (SELECT f.base, most, min(word) AS sugg FROM forms f JOIN best USING (base) WHERE tf = most GROUP BY f.base, most),
        variants AS MATERIALIZED (
            SELECT word, sugg, 'zwnj_variant' AS kind, tf, most AS sugg_tf, round(least(0.95, most / (most + tf)), 2) AS conf
            FROM forms JOIN leaders USING (base) WHERE word <> sugg AND most >= 5 * tf AND word NOT IN (SELECT word FROM known))"""
#: DuckDB measures edits in bytes, so letters are first given one byte each.
_ONE_BYTE = "translate({0}, 'ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیةءآأؤئإ‌', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN')"
_EDITS = f"levenshtein({_ONE_BYTE.format('w')}, {_ONE_BYTE.format('c')})"


def one_edit(a: str, b: str) -> str:
    return f"damerau_levenshtein({_ONE_BYTE.format(a)}, {_ONE_BYTE.format(b)}) = 1"


_INFLECTION = """(((contains(w, zw) OR contains(c, zw)) AND replace(w, zw, '') = replace(c, zw, ''))
            OR ({EDITS} = 1 AND CASE WHEN length(w) = length(c)
                THEN (p + 1 = length(w) AND contains('{E}', substr(w, p + 1, 1)) AND contains('{E}', substr(c, p + 1, 1)))
                  OR (p = 0 AND contains('{S}', substr(w, 1, 1)) AND contains('{S}', substr(c, 1, 1)))
                ELSE substr(longer, p + 1, 1) = zw OR (p + 1 = length(longer) AND contains('{E}', substr(longer, p + 1, 1)))
                  OR (p = 0 AND contains('{S}', substr(longer, 1, 1))) END))""".replace("{E}", C.ENDING_LETTERS).replace("{S}", C.LEADING_LETTERS).replace("{EDITS}", _EDITS)
#: Pairs (w, c) with p (their common prefix) and longer.
PAIR_COLUMNS = f"""*, {ZW} AS zw, CASE WHEN length(w) >= length(c) THEN w ELSE c END AS longer,
            len(list_filter(range(1, least(length(w), length(c)) + 1), lambda k: left(w, k) = left(c, k))) AS p"""
INFLECTION = _INFLECTION
TYPOS = f"""{VARIANTS},
        rare AS (
            SELECT word, tf FROM stats WHERE tf <= 3 AND df <= 2 AND length(replace(word, {ZW}, '')) >= 4
              AND word NOT IN (SELECT word FROM known) AND word NOT IN (SELECT word FROM variants)),
        frequent AS (SELECT word, tf FROM stats WHERE tf >= 30 AND length(word) >= 3),
        near AS (
            SELECT {PAIR_COLUMNS} FROM (
                SELECT r.word AS w, r.tf, f.word AS c, f.tf AS c_tf FROM rare r JOIN frequent f
                ON abs(length(r.word) - length(f.word)) <= 1 AND f.tf >= 40 * r.tf AND r.word <> f.word AND {one_edit('r.word', 'f.word')})),
        typos AS MATERIALIZED (
            SELECT w AS word, c AS sugg, 'corpus_typo' AS kind, tf, c_tf AS sugg_tf, round(least(0.95, 0.45 + log10(c_tf / tf) / 6), 2) AS conf
            FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY c_tf DESC, c) AS nth FROM near WHERE NOT {INFLECTION}) WHERE nth = 1)"""
FLAGGED = f"{TYPOS}, flagged AS MATERIALIZED (SELECT * FROM variants UNION ALL SELECT * FROM typos)"
#: Words with their places: a match begins after all gaps and matches before it.
TOKENS = f"""pieces AS (
            SELECT book, file, file_pos, i, regexp_extract_all(t, '{C.WORD_RUN}') AS ms, string_split_regex(t, '{C.WORD_RUN}') AS gs FROM blocks),
        places AS (
            SELECT book, file, file_pos, i, ms[k] AS run, CAST(length(array_to_string(gs[1:k], '')) + length(array_to_string(ms[1:k - 1], '')) AS INTEGER) AS began
            FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM pieces)),
        cut AS (
            SELECT *, began + length(run) - length(ltrim(run, {ZW})) AS s, trim(run, {ZW}) AS raw FROM places),
        tokens AS (
            SELECT book, file, file_pos, i, CAST(s AS INTEGER) AS s, CAST(s + length(raw) AS INTEGER) AS e, raw, {norm('raw')} AS norm FROM cut WHERE raw <> '')"""


_ENDS_PL = f"regexp_matches(before, '{C.LETTER}$')"
_NO_WORD_BEFORE = f"NOT regexp_matches(before, '[{C.L}\\x{{200C}}]$')"
_NO_WORD_AFTER = f"NOT regexp_matches(after, '^[{C.L}\\x{{200C}}]')"
_BEGINS_PL = f"regexp_matches(after, '^{C.LETTER}')"
_S = C.SPACE
_NEAR = "regexp_replace(before, '(?s)^.*?(.{0,2})$', '\\1') || ' ' || left(after, 2)"
_REPEATED = "از به در که را با این آن تا برای یک".split()


def _persian(x: str) -> str:
    return f"regexp_matches({x}, '{C.LETTER}') AND NOT regexp_matches({x}, '[A-Za-z]')"



#: A rule for RE2, which knows no lookaround: what it consumes, what must hold besides, and what it puts in place.
#: ``before`` is the text up to the match, back to the one before it; ``m`` the match; ``after`` the text behind it,
#: through the next match.
SPLIT = {
    "bom": ("\\x{FEFF}", "true", "''"),
    "presentation_forms": (f"[{C.members(C.PRESENTATION)}]+", "true", "replace(m, 'ﻻ', 'لا')"),
    "arabic_yeh": ("[\\x{064A}\\x{0649}]", "true", "'ی'"),
    "arabic_kaf": ("\\x{0643}", "true", "'ک'"),
    "other_heh": ("[\\x{06BE}\\x{06D5}]", "true", "'ه'"),
    "arabic_digits": ("[\\x{0660}-\\x{0669}]", "true", f"translate(m, '{C.ARABIC_DIGITS}', '{C.PERSIAN_DIGITS}')"),
    "latin_comma": (f"{_S}*,", _ENDS_PL, "'،'"),
    "latin_question": (f"{_S}*\\?", _ENDS_PL, "'؟'"),
    "latin_semicolon": (f"{_S}*;", _ENDS_PL, "'؛'"),
    "space_before_punct": (f"{_S}+", f"{_ENDS_PL} AND regexp_matches(after, '^([\\x{{060C}}\\x{{061B}}\\x{{061F}}!:]|\\.([^.]|$))')", "''"),
    "space_after_punct": ("[\\x{060C}\\x{061B}\\x{061F}!]", _BEGINS_PL, "m || ' '"),
    "zwnj_duplicate": ("\\x{200C}{2,}", "true", ZW),
    "zwnj_dangling": ("\\x{200C}+", f"length(m) = 1 AND NOT ({_ENDS_PL} AND {_BEGINS_PL})", "''"),
    "zwnj_mi": (f"ن?می{_S}", f"{_NO_WORD_BEFORE} AND regexp_matches(after, '^{C.LETTER}+[میدت]([^{C.L}\\x{{200C}}]|$)')", f"left(m, length(m) - 1) || {ZW}"),
    "zwnj_ha": (f"{_S}(?:هایمان|هایتان|هایشان|هایی|هایم|هایت|هایش|های|ها)", f"{_ENDS_PL} AND {_NO_WORD_AFTER}", f"{ZW} || substr(m, 2)"),
    "zwnj_mi_other": (f"ن?می{_S}", f"{_NO_WORD_BEFORE} AND regexp_matches(after, '^{C.LETTER}{{2}}')", f"left(m, length(m) - 1) || {ZW}"),
    "zwnj_tar": (f"{_S}(?:ترین|تر)", f"{_ENDS_PL} AND {_NO_WORD_AFTER}", f"{ZW} || substr(m, 2)"),
    "zwnj_after_heh": (f"{_S}(?:ایم|اید|اند|ام|ای)", f"regexp_matches(before, '{C.LETTER}ه$') AND {_NO_WORD_AFTER}", f"{ZW} || substr(m, 2)"),
    "repeated_word": ("(?:" + "|".join(f"{w}{_S}+{w}" for w in _REPEATED) + ")", f"{_NO_WORD_BEFORE} AND {_NO_WORD_AFTER}", f"regexp_extract(m, '^{C.LETTER}+')"),
    "period_no_space": ("\\.", f"{_ENDS_PL} AND {_BEGINS_PL}", "'. '"),
    "tatweel": ("\\x{0640}+", "true", "''"),
    "latin_digits": ("[0-9]+", _persian(f"({_NEAR})"), f"translate(m, '0123456789', '{C.PERSIAN_DIGITS}')"),
    "latin_quotes": ('"[^"\\n]{1,300}"', _persian("m"), "'«' || substr(m, 2, length(m) - 2) || '»'"),
}


def _places(rows: str, text: str, core: str, keep: str = "book") -> str:
    """Every match of ``core`` in the texts of ``rows``: the columns ``keep``, off, before, m and after."""
    return f"""(SELECT {keep}, CAST(length(array_to_string(gs[1:k], '')) + length(array_to_string(ms[1:k - 1], '')) AS INTEGER) AS off, ms[k] AS m, coalesce(ms[k - 1], '') || gs[k] AS before, gs[k + 1] || coalesce(ms[k + 1], '') AS after
            FROM (SELECT {keep}, ms, gs, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT {keep}, regexp_extract_all({text}, '{core}') AS ms, string_split_regex({text}, '{core}') AS gs FROM {rows})))"""


def rule_count(rule: str) -> str:
    core, holds, _ = SPLIT[rule]
    if rule == "zwnj_dangling":  # a longer run before a letter gives two hits: all but its last, and that
        hits = f"SELECT book, unnest(range(CASE WHEN NOT {_BEGINS_PL} THEN 1 WHEN length(m) > 1 THEN 2 WHEN {_ENDS_PL} THEN 0 ELSE 1 END)) AS m FROM {_places('gated', 't', core)}"
    elif holds == "true":
        return f"""WITH {GATED}
        SELECT book, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT book FROM blocks) b
        LEFT JOIN (SELECT book, {n_of('t', core)} AS n FROM gated) g USING (book) GROUP BY book"""
    else:
        hits = f"SELECT book, m FROM {_places('gated', 't', core)} WHERE {holds}"
    return f"""WITH {GATED}, hits AS ({hits})
        SELECT book, count(h.m) AS n FROM (SELECT DISTINCT book FROM blocks) b LEFT JOIN hits h USING (book) GROUP BY book"""


RULE_SQL = {rule: rule_count(rule) for rule in SPLIT}
_BLOCK = "book, file, file_pos, i"


def found_sql() -> str:
    """All hits as common table expressions, ``found``: rules take their places one after another."""
    single, raw = ("arabic_yeh", "arabic_kaf", "other_heh", "arabic_digits"), ("bom", "presentation_forms", "arabic_yeh", "arabic_kaf", "other_heh", "arabic_digits")
    old, now = "".join(C.TO_PERSIAN) + C.ARABIC_DIGITS, "".join(C.TO_PERSIAN.values()) + C.PERSIAN_DIGITS
    parts = [f"worked AS MATERIALIZED (SELECT *, translate(t, '{old}', '{now}') AS w FROM gated)"]
    taken = None
    for n, (rule, (core, holds, put)) in enumerate(SPLIT.items()):
        hits = f"SELECT {_BLOCK}, off, CAST(length(m) AS INTEGER) AS len, {put} AS sugg, '{rule}' AS rule, {n} AS nth FROM {_places('worked', 't' if rule in raw else 'w', core, _BLOCK)} WHERE {holds} AND {put} <> m"
        if rule in single or taken is None:
            parts.append(f"kept{n} AS MATERIALIZED ({hits})")
        else:
            parts.append(f"kept{n} AS MATERIALIZED (SELECT h.* FROM ({hits}) h WHERE NOT EXISTS (SELECT 1 FROM {taken} p WHERE p.book = h.book AND p.file = h.file AND p.i = h.i AND p.off < h.off + h.len AND h.off < p.off + p.len))")
        if rule not in single:
            parts.append(f"taken{n} AS MATERIALIZED (SELECT * FROM kept{n}" + (f" UNION ALL SELECT * FROM {taken})" if taken else ")"))
            taken = f"taken{n}"
    every = " UNION ALL ".join(f"SELECT * FROM kept{n}" for n in range(len(SPLIT)))
    told = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (r.id, r.severity, r.category, r.message_fa, r.message_en)) + ")" for r in RULES)
    parts.append(f"""found AS MATERIALIZED (
            SELECT h.book, h.file, h.file_pos, h.i, off, len, substr(t, off + 1, len) AS orig, sugg, rule, severity, category, msg_fa, msg_en
            FROM ({every}) h JOIN gated g ON g.book = h.book AND g.file = h.file AND g.i = h.i JOIN (VALUES {told}) AS r(rule, severity, category, msg_fa, msg_en) USING (rule))""")
    return f"{GATED}, " + ", ".join(parts)


def fixed_sql() -> str:
    """Blocks after all safe rules, one after another, as ``fixed``: x, and what each rule changed (c1, c2, ...)."""
    parts, rules = [f"fixed0 AS MATERIALIZED (SELECT {_BLOCK}, t AS x, {gated()} AS ok FROM blocks)"], [r for r in RULES if r.severity == "safe"]
    names = {"before": "(coalesce(ms[k - 1], '') || gs[k])", "m": "ms[k]", "after": "(gs[k + 1] || coalesce(ms[k + 1], ''))"}
    at_k = lambda sql: re.sub(r"(?<![\w'])(before|after|m)(?![\w'])", lambda x: names[x[1]], sql)
    counts = ""
    for n, rule in enumerate(rules, 1):
        core, holds, put = SPLIT[rule.id]
        parts.append(f"cut{n} AS MATERIALIZED (SELECT *, regexp_extract_all(x, '{core}') AS ms, string_split_regex(x, '{core}') AS gs FROM fixed{n - 1})")
        parts.append(f"held{n} AS MATERIALIZED (SELECT *, list_transform(range(1, len(ms) + 1), lambda k: ok AND {at_k(f'({holds}) AND {put} <> m')}) AS hs FROM cut{n})")
        parts.append(f"""fixed{n} AS MATERIALIZED (
            SELECT {_BLOCK}, ok, array_to_string(list_transform(range(1, len(gs) + 1), lambda k: gs[k] || coalesce(CASE WHEN hs[k] THEN {at_k(put)} ELSE ms[k] END, '')), '') AS x{counts}, len(list_filter(hs, lambda h: h)) AS c{n} FROM held{n})""")
        counts += f", c{n}"
    told = ", ".join(f"CASE WHEN c{n} > 0 THEN '{r.id}=' || c{n} END" for n, r in enumerate(rules, 1))
    return f"{BLOCKS}, {', '.join(parts)}, fixed AS (SELECT *, concat_ws(',', {told}) AS fixes FROM fixed{len(rules)})"


#: Findings made up from events, with every source, severity and category, and with spans that meet.
FINDINGS = """findings AS MATERIALIZED (
            SELECT 'b' || (user_id % 40) AS book, 'f' || (event_id % 5) AS f, CAST(event_id % 4 AS INTEGER) AS i, CAST((event_id // 7) % 9 * 5 AS INTEGER) AS off, CAST(2 + (event_id // 3) % 2 AS INTEGER) AS len,
                   CASE event_id % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'spelling' ELSE 'grammar' END AS source,
                   CASE WHEN event_id % 3 = 0 AND event_id % 4 < 2 THEN 'safe' WHEN event_id % 12 = 6 THEN 'style' ELSE 'review' END AS severity,
                   CASE event_id % 5 WHEN 0 THEN 'grammar' WHEN 1 THEN 'spelling' WHEN 2 THEN 'style' ELSE 'typography' END AS category,
                   'r' || (event_id % 6) AS rule, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(event_id % 100 / 100, 2) END AS conf, event_id AS seq
            FROM events)"""
DEDUP = f"""{FINDINGS},
        runs AS (
            SELECT *, list_position(['rules', 'spelling', 'grammar'], source) AS rank,
                   count(*) FILTER (severity = 'safe') OVER (PARTITION BY book, f, i, off, len ORDER BY list_position(['rules', 'spelling', 'grammar'], source), seq ROWS UNBOUNDED PRECEDING) AS run
            FROM findings),
        deduped AS MATERIALIZED (
            SELECT book, f, i, off, len, string_agg(source, '+' ORDER BY rank, seq) AS source, arg_min(severity, rank * CAST(1000000000 AS BIGINT) + seq) AS severity, arg_min(category, rank * CAST(1000000000 AS BIGINT) + seq) AS category,
                   arg_min(rule, rank * CAST(1000000000 AS BIGINT) + seq) AS rule, arg_min({{'c': conf}}, rank * CAST(1000000000 AS BIGINT) + seq).c AS conf, arg_min(seq, rank * CAST(1000000000 AS BIGINT) + seq) AS seq
            FROM runs GROUP BY book, f, i, off, len, run)"""
