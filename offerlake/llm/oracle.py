"""DuckDB SQL of the registered corpus queries, written from their definitions."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM starts),
least AS (SELECT k, min(doc_id) AS first_doc FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT win.doc_id, unnest(range(win.i, win.i + 13)) AS pos
  FROM win JOIN least ON win.k = least.k WHERE least.first_doc < win.doc_id),
positions AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS t, count(*) AS n
  FROM positions p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos
  GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
  CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

BACKOFF = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
t AS (SELECT r, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (
  SELECT r, i, c, lag(c) OVER p AS b, lag(c, 2) OVER p AS a FROM t WINDOW p AS (PARTITION BY r ORDER BY i)),
n AS (SELECT count(*) AS n FROM t),
u AS (SELECT c, count(*) AS n FROM g GROUP BY c),
ud AS (SELECT r, c, count(*) AS n FROM g GROUP BY r, c),
v AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
vd AS (SELECT r, b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY r, b, c),
x AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
xd AS (SELECT r, a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY r, a, b, c),
held AS (
  SELECT g.r, g.i, u.n - ud.n AS c1, v.n - vd.n AS c2, x.n - xd.n AS c3, ub.n - ubd.n AS b1, vb.n - vbd.n AS b2,
    (SELECT n FROM n) - len(d.w) AS rest
  FROM g JOIN d USING (r) JOIN u ON u.c = g.c JOIN ud ON ud.r = g.r AND ud.c = g.c
  LEFT JOIN v ON v.b = g.b AND v.c = g.c LEFT JOIN vd ON vd.r = g.r AND vd.b = g.b AND vd.c = g.c
  LEFT JOIN x ON x.a = g.a AND x.b = g.b AND x.c = g.c LEFT JOIN xd ON xd.r = g.r AND xd.a = g.a AND xd.b = g.b AND xd.c = g.c
  LEFT JOIN u ub ON ub.c = g.b LEFT JOIN ud ubd ON ubd.r = g.r AND ubd.c = g.b
  LEFT JOIN v vb ON vb.b = g.a AND vb.c = g.b LEFT JOIN vd vbd ON vbd.r = g.r AND vbd.b = g.a AND vbd.c = g.b),
lev AS (
  SELECT *, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS lev, least(i - 1, 2) AS ctx FROM held),
s AS (
  SELECT r, lev, ln(CASE lev WHEN 3 THEN c3 / b2 WHEN 2 THEN c2 / b1 WHEN 1 THEN c1 / rest ELSE 1.0::DOUBLE / (rest + 1) END)
    + (ctx - greatest(lev - 1, 0)) * ln(0.4::DOUBLE) AS l FROM lev),
per AS (
  SELECT r, sum(l) AS l, count(*) FILTER (WHERE lev = 3) AS n3, count(*) FILTER (WHERE lev = 2) AS n2,
    count(*) FILTER (WHERE lev = 1) AS n1, count(*) FILTER (WHERE lev = 0) AS n0 FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(per.l / len(w), 6) AS mean_log_score, coalesce(n3, 0) AS n_trigram,
  coalesce(n2, 0) AS n_bigram, coalesce(n1, 0) AS n_unigram, coalesce(n0, 0) AS n_unseen
FROM d LEFT JOIN per USING (r)
"""

CHAT = """
WITH t AS (
  SELECT conv_id, floor(turn / 64.0)::BIGINT AS piece, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body
  FROM conversations),
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, piece ORDER BY turn NULLS FIRST, role, body) - 1) // 256 AS part,
    count(*) OVER (PARTITION BY conv_id, piece) AS n
  FROM t),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
pieces AS (SELECT DISTINCT conv_id, piece, part FROM numbered),
views AS (
  SELECT p.conv_id, p.piece, p.part, s.perspective FROM pieces p LEFT JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
placed_turns AS (
  SELECT conv_id, piece, part, turn, role, body, false AS context FROM numbered
  UNION ALL
  SELECT conv_id, piece + 1, 0, turn, role, body, true FROM numbered WHERE n <= 256 AND turn - 64 * piece >= 56),
seg AS (
  SELECT v.*, t.context,
    row_number() OVER (PARTITION BY v.conv_id, v.piece, v.part, v.perspective ORDER BY t.turn NULLS FIRST, t.role, t.body) AS k,
    coalesce(t.role = v.perspective, false) AND NOT t.context AS mine,
    '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = v.perspective THEN 'assistant'
      ELSE 'user name=' || t.role END || chr(10) AS head,
    t.body || '<|im_end|>' AS body
  FROM views v JOIN placed_turns t ON t.conv_id IS NOT DISTINCT FROM v.conv_id AND t.piece IS NOT DISTINCT FROM v.piece AND t.part = v.part),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, piece, part, perspective ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
  FROM seg)
SELECT conv_id, piece, part, perspective, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(body) AS BIGINT), ',' ORDER BY k) FILTER (WHERE mine), '') AS train_spans,
  count(*) FILTER (WHERE mine) AS n_trained, count(*) FILTER (WHERE NOT context) AS n_turns, count(*) FILTER (WHERE context) AS n_context
FROM placed GROUP BY conv_id, piece, part, perspective
"""

STOP = "'" + "','".join((
    "the of and to in a is that it was for on with as be at by this are or der die und den von zu das mit sich des auf ist im dem "
    "nicht ein eine de la le les et un une du est pour que dans sur pas qui par el los las y en una se del por con no para su al como"
).split()) + "'"

RULES = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l0 FROM documents),
e AS (
  SELECT *, [x FOR x IN l0 IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM d),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM starts),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (
    SELECT win.doc_id, unnest(range(win.i, win.i + 8)) AS pos
    FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.k = twice.k) GROUP BY doc_id),
m AS (
  SELECT e.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len([x FOR x IN w IF lower(x) IN ({STOP})])::BIGINT AS n_stop_words
  FROM e LEFT JOIN rep ON e.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND n_symbols / greatest(n_words, 1) <= 0.1
    AND 2 * n_dup_lines <= n_lines AND (n_words < 200 OR n_stop_words / greatest(n_words, 1) >= 0.01) AS kept,
  n_lines, n_stop_words
FROM b
"""

TRIE = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, xor(4294967295, list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda state, b: list_reduce(range(8), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)), xor(state, b)),
    CAST(4294967295 AS BIGINT))) % 4 AS h
  FROM own),
seq AS (
  SELECT c.conv_id, 0 AS late, o.i, o.role, o.text FROM c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, o.i, o.role, o.text FROM c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY late, i) AS depth FROM seq),
path AS (
  SELECT conv_id, depth, text, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM placed
  UNION ALL SELECT conv_id, 0, '', [] FROM c),
node AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(text) AS text FROM path GROUP BY depth, key),
member AS (SELECT p.conv_id AS member, p.depth, n.conv_id FROM path p JOIN node n ON p.depth = n.depth AND p.key = n.key),
ends AS (
  SELECT conv_id, depth, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS ids
  FROM member m JOIN (SELECT conv_id AS member, max(depth) AS depth FROM path GROUP BY conv_id) USING (member, depth) GROUP BY conv_id, depth),
parent AS (
  SELECT n.conv_id, n.depth, n.n_convs, n.text, m.conv_id AS parent_conv_id
  FROM node n LEFT JOIN member m ON m.member = n.conv_id AND m.depth = n.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parent WHERE depth > 0 GROUP BY ALL),
full_node AS (
  SELECT p.*, coalesce(k.n_children, 0) AS n_children,
    (p.n_convs - 1) * len(regexp_extract_all(p.text, '[^\\x20\\x09-\\x0D]+')) AS tokens
  FROM parent p LEFT JOIN kids k ON k.conv_id = p.conv_id AND k.depth = p.depth),
sub AS (
  SELECT a.conv_id, a.depth, sum((f.n_children = 0)::INT) AS n_leaves, sum(f.tokens) AS saved_tokens
  FROM full_node f JOIN member a ON a.member = f.conv_id AND a.depth <= f.depth GROUP BY a.conv_id, a.depth)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_node f JOIN sub s ON s.conv_id = f.conv_id AND s.depth = f.depth
LEFT JOIN ends e ON e.conv_id = f.conv_id AND e.depth = f.depth
"""


def _nearest(k: int) -> str:
    """Each part's (distance, entry) against the codebook of round k."""
    return f"""
a{k} AS (
  SELECT x.vec_id, x.label, x.p, x.v, min({{'d': list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS m
  FROM part x JOIN b{k} b ON x.p = b.p GROUP BY x.vec_id, x.label, x.p, x.v)"""


def _moved(k: int) -> str:
    """The codebook of round k + 1."""
    return f"""
s{k} AS (
  SELECT p, m.e AS e, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT p, m, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{k}) GROUP BY ALL),
u{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{k} GROUP BY p, e),
b{k + 1} AS (SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM b{k} b LEFT JOIN u{k} u ON u.p = b.p AND u.e = b.e)"""


CODES = f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (
  SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM whole, range(16) t(p)),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole ORDER BY vec_id LIMIT 64),
b0 AS (SELECT x.p, s.e, x.v FROM seed s JOIN part x ON x.vec_id = s.vec_id),
{_nearest(0)},{_moved(0)},{_nearest(1)},{_moved(1)},{_nearest(2)},
row_code AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id, label),
book AS (
  SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM row_code, book
"""

SQL = {"op1_backoff_scores": BACKOFF, "op2_substring_dedup": SUBSTRING, "op3_chat_perspectives": CHAT, "op10_quality_rules": RULES,
       "op11_prefix_trie": TRIE, "op12_vector_codes": CODES}
