"""DuckDB SQL for the corpus queries that SQL can express, by brute force."""

from __future__ import annotations

from collections.abc import Sequence


def components(edges: str, nodes: str, key: str) -> str:
    """CTEs ``v``, ``r`` and ``roots`` over the edges (a < b) of a CTE, for all rows of another."""
    return f"""
v AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
r(node, root) AS (SELECT {key}, {key} FROM {nodes} UNION SELECT v.b, r.root FROM r JOIN v ON v.a = r.node),
roots AS (SELECT node, min(root) AS root FROM r GROUP BY node)"""


CANONICAL = r"""
u AS (SELECT page_id, url, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
c AS (SELECT page_id, md5(html) AS digest, 'day-' || (page_id % 28) AS day,
  regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '')
  || regexp_replace(regexp_replace(regexp_replace('&' || regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', ''), '^(.)', '?\1') AS canonical FROM u)"""

OP1 = f"""
WITH {CANONICAL},
full_ AS (SELECT canonical, 'r' || page_id AS response_id, page_id * 10 AS ts, digest, day FROM c),
again AS (SELECT 'v' || page_id AS record_id, canonical, page_id * 10 + page_id % 100 * 1000 + 5 AS ts, page_id, digest AS own, day AS own_day FROM c),
best AS (SELECT a.*, f.response_id, f.digest, f.day, row_number() OVER (PARTITION BY record_id ORDER BY f.ts DESC, f.response_id DESC) AS k FROM again a LEFT JOIN full_ f ON f.canonical = a.canonical AND f.ts < a.ts),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN page_id % 7 = 0 THEN CASE WHEN own_day = day THEN 'resolved' ELSE 'mismatch' END
  WHEN page_id % 5 = 0 THEN 'mismatch' WHEN own = digest THEN 'resolved' ELSE 'mismatch' END AS status FROM best WHERE k = 1)
SELECT record_id, canonical, response_id, status, CASE WHEN status = 'resolved' THEN 'cache-control:max-age=600,content-type:text/html,date:' || day || ',expires:never' END AS headers,
  CASE WHEN status = 'resolved' THEN digest END AS payload_digest FROM s"""

OP4 = f"""
WITH RECURSIVE e0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e0 x JOIN e0 y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93),{components("e", "e0", "vec_id")}
SELECT vec_id, (SELECT count(*) FROM v WHERE v.a = vec_id) AS n_links, root AS component_id, root = vec_id AS kept FROM e0 JOIN roots ON node = vec_id"""

OP7 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),{components("e", "w", "doc_id")}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, root AS component_id, root = w.doc_id AS kept FROM w JOIN roots ON node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

OP9 = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


OP11 = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
asked AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
tf AS (SELECT doc_id, t, count(*) AS tf FROM terms WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY t),
s AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // whole.terms))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN w USING (t) JOIN lengths USING (doc_id), whole GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


OP12 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, k, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k, length(text)) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS leader, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda r, i: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, o.pos, 0 AS own, k, size FROM c JOIN o ON o.conv_id = c.leader AND o.pos <= c.h UNION ALL SELECT c.conv_id, o.pos, 1, k, size FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
r AS (SELECT conv_id, k, size, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d FROM b),
p AS (SELECT conv_id, d, size, md5(array_to_string(array_agg(k) OVER (PARTITION BY conv_id ORDER BY d), ',')) AS key FROM r UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
q AS (SELECT conv_id, d, size, key, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (SELECT d, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends FROM q GROUP BY d, key),
kids AS (SELECT up AS key, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT q.key, sum((n.n - 1) * n.size)::BIGINT AS saved, count(*) FILTER (WHERE kids IS NULL) AS leaves FROM n LEFT JOIN kids USING (key) JOIN q ON q.conv_id = n.conv_id AND q.d <= n.d GROUP BY q.key)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n u ON u.key = n.up LEFT JOIN kids ON kids.key = n.key JOIN s ON s.key = n.key"""


def op8(rules: Sequence[tuple[str, str, str]], advertising: str) -> str:
    fits = " UNION ALL ".join(
        f"SELECT page_id, '{h}{p}' AS rule, '{a}' AS verdict FROM u WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for a, h, p in rules
    )
    return rf"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
f AS ({fits}), b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '{advertising}') THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN b USING (page_id)"""
