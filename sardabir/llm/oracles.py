"""DuckDB SQL for the results of this package's queries, where SQL can express them."""

#: Word lists (A-Z lower-cased, cut at U+0020 and U+0009 to U+000D) and five-word shingles of a table's texts.
_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"""
_SHINGLES = """CASE WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END"""

ORACLE_SQL = {
    "op4_decontamination": f"""
        WITH items AS (
            SELECT item_id, list_distinct({_SHINGLES}) AS grams, least(len(words), 5) AS size
            FROM (SELECT item_id, {_WORDS.replace("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "lower(coalesce(text, ''))")} AS words FROM benchmark)
            WHERE len(words) > 0),
        wanted AS (SELECT item_id, size, len(grams) AS n_item, unnest(grams) AS gram FROM items),
        texts AS (SELECT doc_id, {_WORDS.replace("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "lower(coalesce(text, ''))")} AS words FROM documents),
        sizes AS (SELECT DISTINCT size FROM items),
        had AS (
            SELECT DISTINCT doc_id, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS gram
            FROM texts, sizes)
        SELECT doc_id, item_id, n_item, count(*) AS n_found, count(*) / n_item AS containment
        FROM had JOIN wanted USING (size, gram) GROUP BY doc_id, item_id, n_item HAVING count(*) * 1000 >= n_item * 800""",
    "op6_minhash_neardup": f"""
        WITH RECURSIVE sets AS (
            SELECT doc_id, list_distinct({_SHINGLES}) AS grams FROM (SELECT doc_id, {_WORDS} AS words FROM documents)),
        sized AS MATERIALIZED (SELECT doc_id, len(grams) AS n, md5(array_to_string(list_sort(grams), chr(10))) AS digest, grams FROM sets),
        classes AS MATERIALIZED (SELECT min(doc_id) AS class_id, digest, any_value(n) AS n, any_value(grams) AS grams FROM sized WHERE n > 0 GROUP BY digest),
        grams AS MATERIALIZED (SELECT class_id, n, unnest(grams) AS gram FROM classes),
        links AS MATERIALIZED (
            SELECT a.class_id AS a, b.class_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.class_id <> b.class_id
            GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (
            SELECT class_id AS a, class_id AS b FROM classes
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
        FROM (SELECT doc_id, n, digest FROM sized) s LEFT JOIN (SELECT class_id, digest FROM classes) c USING (digest) LEFT JOIN least ON a = class_id""",
    "op3_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        told AS (
            SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
                   length(regexp_replace(text, '(<|\[)(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g')) AS text_chars,
                   length(regexp_replace(role, '(<|\[)(\\*)(/?(s>|INST\]))', '\1\\\2\3', 'g')) AS role_chars,
                   row_number() OVER w AS nth
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(text_chars + 13 + CASE WHEN opens THEN role_chars + 7 ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM told GROUP BY conv_id""",
}
