"""DuckDB SQL for the queries of this subpackage that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::UBIGINT[] WHEN len(w) < 4 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: hash(array_to_string(w[i : i + 3], ' ')))) END AS g FROM words),
each AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM grams),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS p, any_value(b.n) AS q, count(*) AS c FROM each a JOIN each b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared WHERE 100 * c >= 85 * (p + q - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT edges.y, reach.other FROM reach JOIN edges ON edges.x = reach.doc_id)
SELECT doc_id, any_value(len(g)) AS n_shingles, min(other) AS component_id FROM reach JOIN grams USING (doc_id) GROUP BY doc_id"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, '{WORD}') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, size, hash(array_to_string(w[i : i + size - 1], ' ')) AS h
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (SELECT doc_id, size, i, hash(array_to_string(w[i : i + size - 1], ' ')) AS h
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT DISTINCT doc_id, item, i, size FROM runs JOIN windows USING (size, h)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

CONTROL = r"[\[<]\\*/?(s>|INST\]|OUT\]|ROLE\]|BODY\]|TURN\])"


def escaped(x: str) -> str:
    """Length of a text once its control strings are escaped, one character each."""
    return f"length({x}) + len(regexp_extract_all({x}, '{CONTROL}'))"


CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(k)),
o AS (SELECT *, row_number() OVER turns AS k, lag(role) OVER turns AS before FROM t WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (SELECT *, {escaped("text")} AS chars,
  CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + {escaped("role")} END AS frame FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + CASE WHEN before IS DISTINCT FROM role THEN frame ELSE 6 END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

GAP = r"[\x20\x09-\x0D]"
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, k, line, regexp_replace(line, '{GAP}', '', 'g') AS bare FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (SELECT doc_id, k, line, length(bare) AS chars, length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS symbols,
  len(string_split_regex(trim(line, ' '), '{GAP}+')) AS words, length(line) - length(translate(line, '|»›•·', '')) AS separators FROM lines),
good AS (SELECT *, symbols <= 0.2::DOUBLE * chars AND NOT (separators >= 2 AND separators > 0.5::DOUBLE * words) AND NOT (words <= 25 AND regexp_matches(lower(line), '{{BOILERPLATE}}')) AS fine FROM judged),
by_line AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (NOT fine) AS n_lines_removed, coalesce(sum(chars) FILTER (fine), 0)::BIGINT AS kept_chars FROM good GROUP BY doc_id),
runs AS (SELECT doc_id, i, hash(array_to_string(w[i : i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM twice) GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(kept_chars, 0) AS kept_chars
  FROM d LEFT JOIN by_line USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars >= 0.5::DOUBLE * word_chars AS kept FROM base"""


def sql() -> dict[str, str]:
    from .quality import BOILERPLATE

    return {"op1_chat_formatting": CHAT, "op3_ngram_jaccard_join": JACCARD, "op6_quality_rules": QUALITY.replace("{BOILERPLATE}", BOILERPLATE), "op7_decontamination": DECONTAMINATION}
