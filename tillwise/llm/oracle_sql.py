"""DuckDB statements that give the rows of the registered queries."""

from __future__ import annotations

from tillwise.llm import licenses as L
from tillwise.llm.quality_rules import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP1_QUALITY_RULES = rf"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT rid, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] AS g
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM base)),
hits AS (
  SELECT rid, unnest([i, i+1, i+2]) AS p
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM hits GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(regexp_extract_all(t, '!')) AS bangs,
         len(regexp_extract_all(t, '\p{{Lu}}')) AS capitals,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(w, lambda x: lower(trim(x, '.,;:!?"''()')) IN ({_STOPS}))) AS stops,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN rep USING (rid)),
f AS (
  SELECT doc_id, n_words, word_chars, n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         greatest(n_words, 1) AS nw, greatest(word_chars, 1) AS nc, bangs, capitals, stops,
         greatest(len(lines), 1) AS nl
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 50
       AND word_chars / nw BETWEEN 2.0 AND 12.0
       AND n_symbols / nc <= 0.05
       AND bangs / nw <= 0.3
       AND capitals / nc <= 0.3
       AND stops / nw >= 0.05
       AND n_dup_lines / nl <= 0.4 AS kept
FROM f
"""

OP10_CHAT_FORMATTING = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                   (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (
  SELECT *, length('<|im_start|>') + length(regexp_replace(role, '<(~*)\|', '<\1~|', 'g')) + length('<|im_sep|>')
            + length(regexp_replace(text, '<(~*)\|', '<\1~|', 'g')) + length('<|im_end|>') + 1 AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP3_NEAREST_NEIGHBOURS = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 20
"""


def _canonical_sql(text: str) -> str:
    plain = f"lower(coalesce({text}, ''))"
    for line in (L.COPYRIGHT_LINE, L.RESERVED_LINE):
        plain = f"regexp_replace({plain}, '{line}', '', 'g')"
    for other, usual in L.SPELLINGS.items():
        plain = f"replace({plain}, '{other}', '{usual}')"
    return f"trim(regexp_replace({plain}, '{L.PUNCTUATION}', ' ', 'g'), ' ')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP9_LICENSE_SCANS = f"""
WITH known AS (
  SELECT sha256({_canonical_sql('text')}) AS digest, min(license) AS license
  FROM (VALUES {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in L.KNOWN)}) AS k(license, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, sha256({_canonical_sql('text')}) AS digest FROM documents),
l AS (
  SELECT rid, sha256({_canonical_sql('line')}) AS line_digest
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
n AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
      FROM l JOIN known ON line_digest = digest GROUP BY rid)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices
FROM d LEFT JOIN known USING (digest) LEFT JOIN n USING (rid)
"""

OP11_HARD_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.x) = len(b.x)),
p AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same
  AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""

# CRC-32 from its generator polynomial; DuckDB has no such function
_CRC32 = """
crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(
    [n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps)
"""

OP12_CONVERSATION_REPAIR = f"""
WITH RECURSIVE {_CRC32},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(
             string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
             lambda c: CAST(ord(c) AS BIGINT))),
           lambda crc32, b: xor(steps[(xor(crc32, b) & 255) + 1], crc32 >> 8))) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault,
         coalesce(lag(role[1]) OVER (PARTITION BY c ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS misfit
  FROM placed),
r AS (
  SELECT c, i, role, text, role[1] AS a, max(i) OVER (PARTITION BY c) - i AS later,
         CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS stay
  FROM faulty),
-- least cost of row i and all after it, from: nothing yet (n), a system row (s), a user row (u), an assistant row (a)
back AS (
  SELECT c, max(i) + 1 AS i, 0::BIGINT AS n, 10::BIGINT AS s, 5::BIGINT AS u, 0::BIGINT AS a FROM r GROUP BY c
  UNION ALL
  SELECT c, i, least(n0, 5 + u1), least(s0, 5 + u1), u1, least(a0, 5 + u0)
  FROM (
    SELECT *, least(u0, 5 + a0) AS u1
    FROM (
      SELECT r.c, r.i,
             least(2 + b.n, stay + 1 + b.u, CASE r.a WHEN 's' THEN stay + b.s WHEN 'u' THEN stay + b.u END) AS n0,
             least(2 + b.s, stay + 1 + b.u, CASE r.a WHEN 'u' THEN stay + b.u END) AS s0,
             least(2 + b.u, stay + 1 + b.a, CASE r.a WHEN 'a' THEN stay + b.a END) AS u0,
             least(2 + b.a, stay + 1 + b.u, CASE r.a WHEN 'u' THEN stay + b.u END) AS a0
      FROM back b JOIN r ON r.c = b.c AND r.i = b.i - 1))),
costs AS (SELECT b.*, r.a AS initial, r.stay, r.role, r.text FROM back b LEFT JOIN r USING (c, i)),
-- the edits from the front: state, letters and repaired lines so far
walk AS (
  SELECT c, 1::BIGINT AS i, 'n' AS state, '' AS audit, []::VARCHAR[] AS lines, true AS going FROM costs WHERE i = 1
  UNION ALL
  SELECT c, CASE WHEN edit IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
         CASE edit WHEN 'K' THEN initial WHEN 'D' THEN state WHEN '' THEN state ELSE added END, audit || edit,
         CASE WHEN edit = 'K' THEN list_append(lines, role || ':' || text)
              WHEN edit IN ('R', 'I') THEN list_append(
                lines, CASE added WHEN 'u' THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END)
              ELSE lines END, edit <> ''
  FROM (
    SELECT w.*, k.initial, k.role, k.text, CASE state WHEN 'u' THEN 'a' ELSE 'u' END AS added,
           CASE state WHEN 'n' THEN k.n WHEN 's' THEN k.s WHEN 'u' THEN k.u ELSE k.a END AS least_cost,
           CASE WHEN k.initial IS NULL AND state IN ('n', 'a') THEN ''
                WHEN k.initial IS NOT NULL AND least_cost =
                  2 + CASE state WHEN 'n' THEN x.n WHEN 's' THEN x.s WHEN 'u' THEN x.u ELSE x.a END THEN 'D'
                WHEN least_cost = 5 + CASE state WHEN 'u' THEN k.a ELSE k.u END THEN 'I'
                WHEN (state || k.initial IN ('ns', 'nu', 'su', 'ua', 'au')) AND least_cost =
                  k.stay + CASE k.initial WHEN 's' THEN x.s WHEN 'u' THEN x.u ELSE x.a END THEN 'K'
                ELSE 'R' END AS edit
    FROM walk w JOIN costs k ON k.c = w.c AND k.i = w.i LEFT JOIN costs x ON x.c = w.c AND x.i = w.i + 1
    WHERE going)),
told AS (
  SELECT conv_id, c, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (misfit) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM faulty GROUP BY ALL),
done AS (
  SELECT told.*, b.n AS cost, w.audit, sha256(array_to_string(w.lines, chr(10))) AS repaired_sha256
  FROM told JOIN back b ON b.c = told.c AND b.i = 1 JOIN walk w ON w.c = told.c AND NOT w.going)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""
