"""DuckDB statements of the training-data queries that SQL can express."""

from __future__ import annotations

from netsift.llm.line_rules import BOILERPLATE, ENDS

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP4 = rf"""
WITH d AS (SELECT doc_id, source, {WORDS} AS size FROM documents),
h AS (SELECT *, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 10))::BIGINT AS h FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0 * source_size AS lim,
        [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
        1.5 * sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, row_number() OVER o AS place,
        coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS busy
      FROM w WINDOW o AS (ORDER BY lim / weight, encode(source) NULLS LAST)),
l AS (SELECT *, (total - given)::DOUBLE / busy AS level FROM f),
one AS (SELECT arg_min(level, place) AS level FROM l WHERE level * weight <= lim),
t AS (SELECT l.source, l.source_size, least(l.lim::DOUBLE, coalesce(one.level * l.weight, l.lim::DOUBLE)) AS target FROM l, one),
q AS (SELECT h.doc_id, h.size, t.source_size, t.target,
        coalesce(sum(h.size) OVER (PARTITION BY h.source ORDER BY h.h, h.doc_id, h.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (greatest(0, least(size, floor(target + 1e-6) - ahead))
   + greatest(0, least(size, floor(target + 1e-6) - source_size - ahead)))::BIGINT AS taken
FROM q
"""

OP5 = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
        role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(k) AS k FROM t WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT t.conv_id, t.k, t.text FROM t JOIN last USING (conv_id, k)),
place AS (SELECT *, row_number() OVER (ORDER BY conv_id) AS rn, count(*) OVER () AS n FROM reply),
pair AS (SELECT a.conv_id, a.k AS last, b.text AS reply, b.conv_id IS NOT NULL AS paired FROM place a
  LEFT JOIN place b ON b.rn = CASE WHEN a.rn % 2 = 0 OR a.rn = a.n THEN a.rn - 1 ELSE a.rn + 1 END),
side AS (
  SELECT t.conv_id, 'chosen' AS side, k, role, text FROM t JOIN pair USING (conv_id)
  UNION ALL
  SELECT t.conv_id, 'rejected', k, role, CASE WHEN k = last THEN reply ELSE text END FROM t JOIN pair USING (conv_id) WHERE k <= last AND paired),
differs AS (SELECT c.conv_id, min(c.k) AS k FROM side c LEFT JOIN side r ON r.side = 'rejected' AND r.conv_id = c.conv_id AND r.k = c.k
  WHERE c.side = 'chosen' AND (r.k IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text) GROUP BY c.conv_id),
shown AS (SELECT s.*, coalesce(s.k < d.k, true) AS common,
    '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body
  FROM side s LEFT JOIN differs d USING (conv_id)),
made AS (SELECT conv_id, side, common, k, head || body AS r,
    repeat('0', length(head)) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, length(body)) AS m FROM shown),
flat AS (SELECT conv_id,
  count(*) FILTER (common AND side = 'chosen') AS n_prompt_turns,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (common AND side = 'chosen'), '') AS prompt,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (NOT common AND side = 'chosen'), '') AS chosen,
  coalesce(string_agg(m, '' ORDER BY k) FILTER (NOT common AND side = 'chosen'), '') AS chosen_mask,
  coalesce(string_agg(r, '' ORDER BY k) FILTER (NOT common AND side = 'rejected'), '') AS rejected,
  coalesce(string_agg(m, '' ORDER BY k) FILTER (NOT common AND side = 'rejected'), '') AS rejected_mask
  FROM made GROUP BY conv_id)
SELECT *, chosen <> rejected AND contains(chosen_mask, '1') AND contains(rejected_mask, '1') AS usable FROM flat
"""

# The pages hold no canonical or refresh tags, and the plain form of an address has its host and path,
# so no decision comes from an alias here; tests cover those that do.
OP9 = r"""
WITH p AS (SELECT page_id,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT host, path, max({'n': length(rh || rp), 'allow': rv = 'allow', 'rule': rh || rp}) AS b
  FROM (SELECT DISTINCT host, path FROM q) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, host, path, b.rule AS rule, CASE WHEN b.allow IS NULL OR b.allow THEN 'allow' ELSE 'block' END AS verdict
FROM q LEFT JOIN best USING (host, path)
"""

# All pairs in double precision, components by repeated steps to the smallest reachable id.
OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
n AS (SELECT vec_id, list_transform(x, lambda c: c / norm) AS x FROM u WHERE norm > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c USING (vec_id)
"""

_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_MARKS = "len(s) - len(translate(s, '#*$%&|<>', ''))"
_SHORT = " OR ".join(f"contains(lower(s), '{x}')" for x in BOILERPLATE)
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, c IS NOT NULL AND count(*) OVER (PARTITION BY r, a, b, c) > 1 AS hit FROM g),
rep AS (SELECT r, count(*) FILTER (near) AS n_repeat_words
  FROM (SELECT r, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM h) GROUP BY r),
l AS (SELECT r, line, count(*) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS s
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) GROUP BY ALL),
j AS (SELECT r, k, n, s <> '' AND (len(regexp_extract_all(s, '{_SPACE}[|»›·>]{_SPACE}|{_SPACE}\|$')) >= 2
    OR (n < 30 AND ({_SHORT})) OR {_MARKS} > 0.3::DOUBLE * n OR (n < 30 AND NOT contains('{ENDS.replace("'", "''")}', right(s, 1)))) AS bad FROM l WHERE n > 0),
x AS (SELECT r, sum(k - 1) AS dups, coalesce(sum(k) FILTER (bad), 0) AS gone, coalesce(sum(k * n) FILTER (bad), 0) AS lost FROM j GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0)::BIGINT AS lines_removed, coalesce(lost, 0)::BIGINT AS words_lost
  FROM w LEFT JOIN rep USING (r) LEFT JOIN x USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_lost <= 0.4::DOUBLE * n_words AS kept FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_neardup": OP2, "op10_quality_rules": OP10, "op4_source_mix": OP4, "op5_preference_format": OP5, "op9_url_filter": OP9}
