"""The operators that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from .license_scan import PART, SHARE, SHINGLE, TEMPLATES, WHOLE, WINDOW

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ROWS = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

OP1 = f"""
WITH template AS (SELECT i, license_id, w, len(w) AS words, greatest(8, len(w) // 8) AS slack FROM (SELECT i, license_id, {_TOKENS.format('t')} AS w FROM (VALUES {_ROWS}) v(i, license_id, t))),
win AS (SELECT i, license_id, CAST(NULL AS BIGINT) AS o, w, words AS m, least({SHINGLE}, words) AS n, {SHARE} AS least FROM template WHERE words <= {WHOLE}
UNION ALL SELECT i, license_id, o, w[o + 1 : o + {WINDOW}], {WINDOW}, {SHINGLE}, {PART} FROM template, unnest(range(0, words - {WINDOW} + 1, {WINDOW - SHINGLE + 1})) u(o) WHERE words > {WHOLE}),
ns AS (SELECT DISTINCT i, license_id, o, m, n, least, array_to_string(w[p : p + n - 1], ' ') AS s FROM win, unnest(range(1, m - n + 2)) u(p)),
sizes AS (SELECT i, coalesce(o, -1) AS o, count(*) AS size FROM ns GROUP BY ALL),
d AS (SELECT doc_id, row_number() OVER () AS row, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT DISTINCT n FROM ns),
ds AS (SELECT doc_id, row, len(w) AS len, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM d, k, unnest(range(1, greatest(len(w) - n + 2, 1))) u(p)),
hit AS (SELECT doc_id, row, len, i, license_id, coalesce(o, -1) AS o, m, n, least, p, s FROM ds JOIN ns USING (n, s)),
found AS (SELECT doc_id, row, i, license_id, o, m, least, len, first, count(DISTINCT s) AS found FROM hit, unnest(range(greatest(p - (m - n), 1), p + 1)) u(first) WHERE first <= len - m + 1 GROUP BY ALL),
kept AS (SELECT *, CAST(found AS DOUBLE) / size AS containment FROM found JOIN sizes USING (i, o) WHERE CAST(found AS DOUBLE) / size >= least),
place AS (SELECT DISTINCT doc_id, row, len, i, kept.license_id, CAST(floor((first - 1 - o)::DOUBLE / slack) AS BIGINT) AS q, slack, words FROM kept JOIN template USING (i) WHERE o >= 0),
stretch AS (SELECT *, greatest((q - 1) * slack + 1, 1) AS a, least(len, (q + 2) * slack + words) AS e FROM place),
whole AS (SELECT DISTINCT i, array_to_string(w[p : p + {SHINGLE - 1}], ' ') AS s FROM template, unnest(range(1, words - {SHINGLE} + 2)) u(p) WHERE words > {WHOLE}),
held AS (SELECT doc_id, row, i, license_id, a, e, count(DISTINCT s) AS found FROM stretch JOIN ds USING (doc_id, row) JOIN whole USING (i, s) WHERE n = {SHINGLE} AND p >= a AND p + {SHINGLE - 1} <= e GROUP BY ALL),
good AS (SELECT doc_id, license_id, containment, first, m FROM kept WHERE o < 0
UNION ALL SELECT doc_id, license_id, CAST(found AS DOUBLE) / size, a, e - a + 1 FROM held JOIN (SELECT i, count(*) AS size FROM whole GROUP BY i) USING (i) WHERE CAST(found AS DOUBLE) / size >= {SHARE})
SELECT doc_id, license_id, containment, CAST(first - 1 AS INT) AS first_word, CAST(m AS INT) AS n_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, license_id ORDER BY containment DESC, first, m DESC) AS r FROM good) WHERE r = 1
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], chr(1)) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) u(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

OP4 = """
WITH RECURSIVE r AS (SELECT conv_id, turn, role, text, md5(coalesce(text, '')) AS digest, count(*) AS n FROM conversations GROUP BY ALL),
k AS (SELECT *, CASE WHEN digest = min(digest) OVER (PARTITION BY conv_id, turn, role) THEN '' ELSE '~' || digest END AS other FROM r),
u AS (SELECT conv_id, turn, text, n, 'c' || conv_id || '-' || turn || other AS id, CASE WHEN turn >= 2 THEN 'c' || conv_id || '-' || (turn - 2) END AS after FROM k WHERE role = 'user'),
a AS (SELECT conv_id, turn, text, n, 'c' || conv_id || '-' || (turn - 1) || other AS id FROM k WHERE role = 'assistant'),
dep(conv_id, id, depth) AS (SELECT conv_id, id, 0 FROM u WHERE after IS NULL OR NOT EXISTS (FROM u AS p WHERE p.conv_id = u.conv_id AND p.id = u.after) UNION ALL SELECT u.conv_id, u.id, dep.depth + 1 FROM u JOIN dep ON u.conv_id = dep.conv_id AND u.after = dep.id),
c AS (SELECT u.conv_id, u.turn, u.text, u.n, a.text AS result, a.n IS NOT NULL AS answered, depth, u.id, after FROM u JOIN dep USING (conv_id, id) LEFT JOIN a USING (conv_id, id)),
lines AS (
SELECT conv_id, turn, id AS call_id, 'answer' AS tool, depth::BIGINT AS depth, CASE WHEN after IS NOT NULL AND depth = 0 THEN 'dangling' WHEN answered THEN 'linked' ELSE 'unanswered' END AS status, n AS repeats, coalesce(length(text) > 0, FALSE) AS valid,
CASE WHEN text IS NULL THEN '$.prompt: not string' WHEN text = '' THEN '$.prompt: length' ELSE '' END AS errors,
CAST(CASE WHEN after IS NULL THEN to_json({'arguments': {'prompt': text, 'turn': turn}, 'depth': depth, 'id': id, 'result': result, 'tool': 'answer'})
ELSE to_json({'after': after, 'arguments': {'prompt': text, 'turn': turn}, 'depth': depth, 'id': id, 'result': result, 'tool': 'answer'}) END AS VARCHAR) AS json FROM c
UNION ALL SELECT conv_id, turn, id, NULL, NULL, 'orphan', n, FALSE, '$: no call', CAST(to_json({'content': text, 'role': 'tool', 'tool_call_id': id}) AS VARCHAR) FROM a WHERE NOT EXISTS (FROM u WHERE u.conv_id = a.conv_id AND u.id = a.id)
UNION ALL SELECT conv_id, turn, id, NULL, NULL, 'message', n, TRUE, '', CAST(to_json({'content': text, 'id': id, 'role': role}) AS VARCHAR) FROM (SELECT *, 'm' || conv_id || '-' || turn || '-' || coalesce(role, '') || other AS id FROM k WHERE role IS NULL OR role NOT IN ('user', 'assistant')))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(depth, 0), turn, call_id) AS line, * EXCLUDE (conv_id, turn) FROM lines
"""

ORACLES = {"op1_license_scan": OP1, "op4_chat_format": OP4, "op6_minhash_near_dedup": OP6, "op8_embedding_near_dedup": OP8}
