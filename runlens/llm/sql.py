"""The queries of this folder that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from runlens.llm import cells, chat, jaccard, negatives, quality, spelling, substrings

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{WORD}')"


def _windows(size: int) -> str:
    """Windows of ``size`` words of ``n`` (doc_id, ws, n_words), at places from 1."""
    return (
        f"SELECT doc_id, i, array_to_string(ws[i:i + {size - 1}], ' ') AS t FROM "
        f"(SELECT doc_id, ws, unnest(range(1, n_words - {size - 2})) AS i FROM n WHERE n_words >= {size})"
    )


N = f"n AS (SELECT *, len(ws) AS n_words FROM (SELECT doc_id, text, {_words('text')} AS ws FROM documents))"

OP2 = f"""WITH {N}, win AS ({_windows(quality.REPEAT_WINDOW)}),
twice AS (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, list(i) AS places FROM win GROUP BY doc_id, t HAVING count(*) > 1)),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, {quality.REPEAT_WINDOW}) r(k) GROUP BY doc_id),
f AS (SELECT n.doc_id, n_words, length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls, coalesce(again.n, 0) AS n_repeat_words,
  length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) AS calls,
  len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS loud,
  len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) AS same
 FROM n LEFT JOIN again ON again.doc_id = n.doc_id),
b AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > n_words OR 10 * calls > 3 * n_words OR 10 * loud > 3 * n_words OR 10 * same > 3 * n_words
  OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR (n_lines > 4 AND 10 * n_dup_lines > 4 * n_lines)) AS kept FROM b"""

OP3 = """
WITH records AS (
    SELECT page_id, page_id // 1000 AS file,
        strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
            || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
            || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10))
            + strlen(coalesce(html, '')) + 4 AS length
    FROM pages
), placed AS (
    SELECT *, sum(length) OVER (PARTITION BY file ORDER BY page_id) - length AS start FROM records
)
SELECT file, CAST(start AS BIGINT) AS record_offset, length, page_id,
    CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS kind
FROM placed WHERE page_id % 101 = 7 OR page_id % 97 = 5 OR page_id % 89 = 3
"""

OP4 = f"""WITH {N}, win AS ({_windows(substrings.WINDOW)}), first AS (SELECT t, min(doc_id) AS f FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN first USING (t), range(0, {substrings.WINDOW}) r(k) WHERE f < doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM n),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT n.doc_id, n_words, coalesce(removed.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM n LEFT JOIN kept ON kept.doc_id = n.doc_id LEFT JOIN removed ON removed.doc_id = n.doc_id"""

OP5 = f"""WITH RECURSIVE n AS (SELECT *, len(ws) AS n_words FROM (
  SELECT doc_id, {_words(f"translate(text, '{UPPER}', '{LOWER}')")} AS ws FROM documents)),
win AS ({_windows(jaccard.SHINGLE)}),
s AS (SELECT DISTINCT doc_id, t FROM win UNION ALL
  SELECT doc_id, array_to_string(ws, ' ') FROM n WHERE n_words BETWEEN 1 AND {jaccard.SHINGLE - 1}),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * o >= {jaccard.PERCENT} * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT n.doc_id, coalesce(z.n, 0) AS n_shingles, r.m AS component_id FROM n LEFT JOIN z ON z.doc_id = n.doc_id
JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = n.doc_id"""

_CONTROL = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = "replace(replace({}, '&', '&amp;'), '<|', '&lt;|')"
_MARKS = len(chat.START) + 1 + len(chat.END)

OP8 = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}')),
k AS (SELECT *, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_ \\t\\n\\x0B\\f\\r]')) + 4 AS tokens, {_MARKS}
  + length(replace({_ESCAPED.format('role')}, chr(10), '&#10;')) + length({_ESCAPED.format('text')}) AS chars FROM c),
o AS (SELECT *, row_number() OVER w AS place, sum(tokens) OVER w AS ends FROM k
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, place = 1 AND role = '{chat.SYSTEM}' AS is_system FROM o),
m AS (SELECT conv_id, coalesce(max(tokens) FILTER (WHERE is_system), 0) AS held, max(chars) FILTER (WHERE is_system) AS system_chars
  FROM y GROUP BY conv_id),
g AS (SELECT y.*, m.system_chars, greatest({chat.BUDGET - chat.HISTORY} - held, {chat.HISTORY}, 1) AS room,
  ends - tokens - held AS begins FROM y JOIN m ON m.conv_id IS NOT DISTINCT FROM y.conv_id),
h AS (SELECT *, begins // (room * {chat.STRETCH}) AS stretch,
  row_number() OVER (PARTITION BY conv_id, begins // (room * {chat.STRETCH}) ORDER BY place) AS nth FROM g WHERE NOT is_system),
walk AS (SELECT conv_id, stretch, nth, tokens - CASE WHEN stretch = 0 THEN {chat.HISTORY} ELSE 0 END AS filled, 0 AS nth_window FROM h WHERE nth = 1
  UNION ALL SELECT h.conv_id, h.stretch, h.nth, CASE WHEN w.filled + h.tokens > h.room THEN h.tokens ELSE w.filled + h.tokens END,
    w.nth_window + CASE WHEN w.filled + h.tokens > h.room THEN 1 ELSE 0 END
  FROM walk w JOIN h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.stretch = w.stretch AND h.nth = w.nth + 1),
own AS (SELECT h.*, h.stretch * {chat.NUMBERS} + w.nth_window AS win FROM h
  JOIN walk w ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.stretch = w.stretch AND h.nth = w.nth),
s AS (SELECT conv_id, win, lead(win) OVER (PARTITION BY conv_id ORDER BY win) AS next_win,
  lead(opens) OVER (PARTITION BY conv_id ORDER BY win) AS next_opens
  FROM (SELECT conv_id, win, min(begins) AS opens FROM own GROUP BY conv_id, win)),
shown AS (SELECT conv_id, 0 AS win, chars, system_chars FROM g WHERE is_system
  UNION ALL SELECT conv_id, win, chars, system_chars FROM own
  UNION ALL SELECT own.conv_id, s.next_win, chars, system_chars FROM own
    JOIN s ON s.conv_id IS NOT DISTINCT FROM own.conv_id AND s.win = own.win WHERE s.next_opens - own.begins <= {chat.HISTORY}),
v AS (SELECT conv_id, win, sum(chars) + CASE WHEN win > 0 THEN coalesce(max(system_chars), 0) ELSE 0 END AS chars
  FROM shown GROUP BY conv_id, win),
f AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(count(*) AS INT) AS n_windows FROM v GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = '{chat.LEARNED}'), '') AS loss FROM y GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_windows
FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id"""

_ROWS = f"""rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor({negatives.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP11 = f"""WITH {_ROWS}, a AS (SELECT * FROM rows WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
 FROM a JOIN rows r ON r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {negatives.LOW_PERCENT} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH_PERCENT} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= {negatives.NEGATIVES}"""

OP13 = f"""WITH RECURSIVE u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
 WHERE list_cosine_similarity(a.v, b.v) >= {cells.THRESHOLD}),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""

_RUN = f"[A-Za-z\\u00C0-\\u00FF]{{{spelling.LEAST_LENGTH},}}".replace("\\u00C0", "À").replace("\\u00FF", "ÿ")
_BYTES = "flatten(list_transform(string_split(b, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))"
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, i))"

OP12 = f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
runs AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_RUN}')) AS run FROM documents)),
each AS (SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS b FROM runs GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce({_BYTES}, lambda r, x: xor(r >> 8, t[1 + (xor(r, x) & 255)]), 4294967295), 4294967295) AS h FROM each, crc),
w AS (SELECT CASE WHEN h % {spelling.ONE_IN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, length(word) + 1) r(i)),
near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
 UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM near GROUP BY word),
f AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.FORM_TIMES} * words.n THEN form END AS form,
  CASE WHEN form_n >= {spelling.FORM_TIMES} * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
root AS (SELECT walk.word, walk.at FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root.at, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN root USING (word)"""
