"""DuckDB SQL of the registered operator queries, where SQL can express them."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op9_decontamination"] = r"""
WITH ascii_lower AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM ascii_lower),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
placed AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM dw, sizes WHERE len(w) >= n),
found AS (SELECT a.r, a.p, a.n, win.item_id FROM (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM placed) a JOIN win USING (n, g)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

ORACLES["op2_url_rules"] = r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?#]*(\?[^#]*)', 1) AS query, row_number() OVER () AS r FROM cut),
rules(rule, h, p, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts, rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
patterns(regex, n, verdict) AS (VALUES
    ('/login(?:[^A-Za-z0-9_%-]|$)', 7, 'block'), ('/signup(?:[^A-Za-z0-9_%-]|$)', 8, 'block'), ('/cart(?:[^A-Za-z0-9_%-]|$)', 6, 'block'),
    ('/checkout(?:[^A-Za-z0-9_%-]|$)', 10, 'block'), ('/wp-login\.php', 13, 'block'), ('/cgi-bin/', 9, 'block'),
    ('^(?:[^/?]*\.)?doubleclick\.net(?:[^A-Za-z0-9_%-]|$)', 18, 'block'), ('^(?:[^/?]*\.)?xxx/', 6, 'block'),
    ('(?:^|[^A-Za-z0-9_%-])casino(?:[^A-Za-z0-9_%-]|$)', 8, 'block'), ('(?:^|[^A-Za-z0-9_%-])porn(?:[^A-Za-z0-9_%-]|$)', 6, 'block'),
    ('(?:^|[^A-Za-z0-9_%-])torrent(?:[^A-Za-z0-9_%-]|$)', 9, 'block'), ('\.exe$', 5, 'block'), ('\.zip$', 5, 'block'), ('\.apk$', 5, 'block'),
    ('(?:^|[^A-Za-z0-9_%-])sessionid(?:[^A-Za-z0-9_%-]|$)', 11, 'block'), ('(?:^|[^A-Za-z0-9_%-])print(?:[^A-Za-z0-9_%-]|$)1$', 9, 'block'),
    ('^(?:[^/?]*\.)?wikipedia\.org/wiki/', 21, 'allow')),
other AS (SELECT r, arg_max(patterns.verdict, n) AS verdict FROM parts, patterns WHERE regexp_matches(host || path || query, regex) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(best.verdict, other.verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (r) LEFT JOIN other USING (r)
"""

ORACLES["op10_pivots"] = """
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
    FROM x q JOIN x d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM pairs QUALIFY rank <= 5
"""

ORACLES["op3_suffix_dedup"] = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS MATERIALIZED (SELECT doc_id, p, md5_number(b[p + 1:p + 50]) AS w FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS p FROM d)),
first AS MATERIALIZED (SELECT w, min(doc_id) AS m FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, p, lag(p, 1, -100) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM s JOIN first USING (w) WHERE m < doc_id),
runs AS (SELECT doc_id, p, sum((p - q > 50)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM gone),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z, row_number() OVER (PARTITION BY doc_id ORDER BY min(p)) AS k FROM runs GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM spans),
kept AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last,
    string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS head FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(head, '') || hex(b[coalesce(last, 0) + 1:]))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op6_bottom_k"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT b, m FROM reach JOIN links ON a = id),
comp AS (SELECT id, min(m) AS m FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, doc_id = m AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp ON id = doc_id
"""

#: Unsigned crc32 of the decimal id ``{id}``, bit by bit.
CRC32 = """xor(list_reduce([4294967295] || list_transform(range(1, length({id}::VARCHAR) + 1), lambda k: ascii(({id}::VARCHAR)[k])::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [k::BIGINT for k in range(8)], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

ORACLES["op11_periodic_runs"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, @CRC AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sized AS (SELECT *, h // 10 AS g, len(w) AS n FROM d),
tails AS (SELECT *, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM sized),
words AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
    ELSE w END AS w FROM tails),
windows AS MATERIALIZED (SELECT r, i, md5_number(array_to_string(w[i + 1:i + 8], ' ')) AS g FROM (SELECT r, w, unnest(range(0, n - 7)) AS i FROM words)),
pairs AS (SELECT x.r, y.i - x.i AS q, x.i FROM windows x JOIN windows y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
islands AS (SELECT r, q, min(i) AS s, count(*) + 7 + q AS l FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs) GROUP BY r, q, k),
runs AS MATERIALIZED (SELECT r, s, l, min(q) AS q FROM islands WHERE l >= greatest(24, 3 * q) GROUP BY r, s, l),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
best AS (SELECT r, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS w, unnest(range(0, n)) AS i FROM words) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
    sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM words LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
""".replace("@CRC", CRC32.format(id="doc_id"))

ORACLES["op12_prefix_trie"] = r"""
WITH t AS MATERIALIZED (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(length(role) || ':' || role || text)) - 1 AS p
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT DISTINCT conv_id, @CRC % 6 AS h FROM t),
rebuilt AS (SELECT c.conv_id, t.p, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.p < c.h
    UNION ALL SELECT t.conv_id, t.p, t.role, t.text FROM convs c JOIN t USING (conv_id) WHERE t.p >= c.h),
turns AS (SELECT conv_id, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, md5(length(role) || ':' || role || text) AS k FROM rebuilt),
lists AS (SELECT conv_id, coalesce(list(k ORDER BY d) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(size ORDER BY d) FILTER (k IS NOT NULL), []) AS sizes
    FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
prefixes AS MATERIALIZED (SELECT conv_id, len(ks) AS n, d, md5(array_to_string(ks[1:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(ks[1:d - 1], ',')) END AS above,
    CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM lists)),
nodes AS MATERIALIZED (SELECT node, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM prefixes GROUP BY node, d),
children AS (SELECT above AS node, count(*) AS c FROM nodes WHERE d > 0 GROUP BY above),
sums AS (SELECT p.node, p.d, sum(u.saved) AS saved, count(*) FILTER (children.node IS NULL) AS leaves
    FROM nodes u LEFT JOIN children USING (node) JOIN prefixes p ON p.conv_id = u.conv_id AND p.d <= u.d GROUP BY p.node, p.d)
SELECT v.conv_id, v.d::BIGINT AS depth, a.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(c, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
    sums.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM nodes v LEFT JOIN children USING (node) JOIN sums ON sums.node = v.node AND sums.d = v.d LEFT JOIN nodes a ON a.node = v.above AND a.d = v.d - 1
""".replace("@CRC", CRC32.format(id="conv_id"))
