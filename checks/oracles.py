"""DuckDB SQL for the registered queries. Written from the semantics, not from the Spark plans."""

from __future__ import annotations

from msgscreen.functions import lexicons
from msgscreen.operators import context

ORACLES: dict[str, str] = {}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _norm(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '\\s+', ' ', 'g'))"


def _words(column: str) -> str:
    return f"list_filter(string_split({_norm(column)}, ' '), lambda w: w <> '')"


# --- lexical -------------------------------------------------------------------------

INDEX = f"""
toks AS MATERIALIZED (SELECT doc_id, unnest({_words('text')}) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
dl AS MATERIALIZED (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY 1),
cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, cs),
avg_raw AS (SELECT avg(raw) AS avg_idf FROM raw),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg_idf ELSE raw END AS idf FROM raw, avg_raw)
"""


def _bm25(queries: str, name: str = "lex", k: int = 20) -> str:
    return f"""
{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (
    SELECT query_id, unnest({_words('text')}) AS term FROM ({queries})) GROUP BY ALL),
{name}_s AS (SELECT query_id, doc_id,
    round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
    FROM {name}_q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), cs GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank
    FROM {name}_s QUALIFY rank <= {k})
"""


BENCH = "SELECT item_id AS query_id, text FROM benchmark"

ORACLES["bm25_postings_stats"] = f"""WITH {INDEX}
SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf, max(dl)::BIGINT AS longest FROM tf JOIN dl USING (doc_id) GROUP BY term"""
ORACLES["bm25_corpus_stats"] = f"""WITH {INDEX}
SELECT n, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM cs, avg_raw"""
TOPK = f"WITH {INDEX}, {_bm25(BENCH)} SELECT query_id, doc_id, rank, score FROM lex"
ORACLES["bm25_topk"] = TOPK
ORACLES["bm25_topk_joined"] = TOPK
ORACLES["bm25_topk_blocked"] = TOPK
ORACLES["bm25_pruned"] = TOPK
ORACLES["bm25_incremental"] = TOPK
ORACLES["bm25_incremental_idf"] = f"""SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 6) AS idf
FROM (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw
    FROM (SELECT DISTINCT doc_id, unnest({_words('text')}) AS term FROM documents) GROUP BY term)"""
ORACLES["bm25_idf"] = ORACLES["bm25_incremental_idf"]
ORACLES["bm25_compacted_stats"] = ORACLES["bm25_postings_stats"]
ORACLES["bm25_topk_padded"] = f"""WITH {INDEX},
qs AS ({BENCH} UNION ALL SELECT page_id + 1000000, url FROM pages),
{_bm25('SELECT * FROM qs')},
low AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 40),
pairs AS (SELECT query_id, doc_id FROM qs CROSS JOIN low),
fill AS (SELECT query_id, doc_id, 0.0::DOUBLE AS score FROM pairs ANTI JOIN lex USING (query_id, doc_id)),
both_lists AS (SELECT query_id, doc_id, score FROM lex UNION ALL SELECT * FROM fill)
SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank
FROM both_lists QUALIFY rank <= 20"""

# --- dense ---------------------------------------------------------------------------


def _vectors(name: str, source: str, id_col: str) -> str:
    """Sparse form of the hashed unit vectors of a text column."""
    return f"""
{name}_b AS (SELECT {id_col}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS pos FROM (
    SELECT {id_col}, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS t FROM ({source}))),
{name}_c AS (SELECT {id_col}, pos, count(*)::DOUBLE AS c FROM {name}_b GROUP BY ALL),
{name}_v AS (SELECT {id_col}, pos, (c / sqrt(sum(c * c) OVER (PARTITION BY {id_col})))::FLOAT AS v FROM {name}_c)
"""


DOC_VECTORS = _vectors("dv", "SELECT doc_id, text FROM documents", "doc_id")


def _dense(queries: str, name: str = "den", docs: str = "dv_v", doc_id: str = "doc_id", k: int = 20) -> str:
    return f"""
{_vectors(name + 'q', queries, 'query_id')},
{name}_s AS (SELECT query_id, {doc_id}, round(sum(q.v::DOUBLE * d.v::DOUBLE), 6) AS score
    FROM {name}q_v q JOIN {docs} d USING (pos) GROUP BY ALL),
{name} AS (SELECT query_id, {doc_id}, score,
    (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {doc_id}))::INT AS rank FROM {name}_s QUALIFY rank <= {k})
"""


DENSE = f"WITH {DOC_VECTORS}, {_dense(BENCH)} SELECT query_id, doc_id, rank, score FROM den"
ORACLES["dense_topk"] = DENSE
ORACLES["dense_topk_blocked"] = DENSE
ORACLES["dense_topk_stored"] = DENSE
ORACLES["embed_documents"] = f"WITH {DOC_VECTORS} SELECT doc_id, pos, round(v::DOUBLE, 6) AS value FROM dv_v"
ORACLES["l2_normalise"] = """
WITH x AS (SELECT vec_id, unnest(embedding) * label AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x::FLOAT::DOUBLE * x::FLOAT::DOUBLE)) AS norm FROM x GROUP BY 1)
SELECT vec_id, pos, round((CASE WHEN norm = 0 THEN x::FLOAT ELSE (x::FLOAT::DOUBLE / norm)::FLOAT END)::DOUBLE, 6) + 0.0 AS value
FROM x JOIN n USING (vec_id)"""

KNN = """
pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
    round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id),
knn AS (SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank
    FROM pairs QUALIFY rank <= 5)
"""
ORACLES["knn_leave_one_out"] = f"WITH {KNN} SELECT * FROM knn"
ORACLES["dense_topk_pruned"] = ORACLES["knn_leave_one_out"]
ORACLES["dense_topk_ann_every_cell"] = ORACLES["knn_leave_one_out"]
BY_LABEL = f"""{KNN},
cent AS (SELECT (row_number() OVER (ORDER BY label::VARCHAR)) AS cell, embedding FROM (
    SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)),
near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])
    - 2 * list_inner_product(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), cell) AS r FROM embeddings e, cent c),
probed AS (SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM pairs
    JOIN near d ON d.vec_id = doc_id AND d.r = 1 JOIN near q ON q.vec_id = query_id AND q.r <= 3 AND q.cell = d.cell QUALIFY rank <= 5)
"""
ORACLES["dense_topk_ann_by_label"] = f"WITH {BY_LABEL} SELECT * FROM probed"
ORACLES["ann_recall"] = f"""WITH {BY_LABEL}, r AS (SELECT query_id, count(p.doc_id) / count(*) AS recall
    FROM knn LEFT JOIN probed p USING (query_id, doc_id) GROUP BY query_id)
SELECT round(avg(recall), 6) AS recall, count(*) AS queries FROM r"""
ORACLES["index_size"] = """SELECT label::VARCHAR AS label, count(*) AS n, max(len(embedding)) AS dim,
round(sum(len(embedding)) * 4 / 1048576.0, 2) AS index_size_mb FROM embeddings GROUP BY label"""

# --- fusion --------------------------------------------------------------------------

ORACLES["rrf_fuse"] = """
WITH a AS (SELECT source AS query_id, doc_id, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id))::INT AS rank FROM documents QUALIFY rank <= 20),
b AS (SELECT source AS query_id, doc_id, (row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)))::INT AS rank FROM documents QUALIFY rank <= 20),
f AS (SELECT query_id, doc_id, a.rank AS ra, b.rank AS rb,
    coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS s FROM a FULL JOIN b USING (query_id, doc_id))
SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, ra NULLS LAST, rb NULLS LAST))::INT AS rank,
    round(s, 9)::DOUBLE AS rrf_score, 'hybrid_rrf' AS source FROM f QUALIFY rank <= 10"""

HYBRID = f"""
{INDEX}, qs AS (SELECT query_id, {_norm('text')} AS text FROM ({BENCH})),
{_bm25('SELECT * FROM qs')}, {DOC_VECTORS}, {_dense('SELECT * FROM qs')},
fused AS (SELECT query_id, doc_id, den.rank AS rd, lex.rank AS rl,
    coalesce(1.0::DOUBLE / (60 + den.rank), 0) + coalesce(1.0::DOUBLE / (60 + lex.rank), 0) AS s
    FROM den FULL JOIN lex USING (query_id, doc_id)),
hybrid AS (SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, rd NULLS LAST, rl NULLS LAST))::INT AS rank,
    round(s, 9) AS rrf_score, 'hybrid_rrf' AS source FROM fused QUALIFY rank <= 5)
"""
ORACLES["hybrid_search"] = f"WITH {HYBRID} SELECT * FROM hybrid"

CORPUS = """
corpus AS (SELECT d.doc_id, d.text, d.lang AS language, d.source AS channel,
    CASE l.quality WHEN 0 THEN 'phishing' WHEN 1 THEN 'legitimate' END AS label,
    CASE l.toxic WHEN 1 THEN 'threat' WHEN 0 THEN 'none' END AS attack_type,
    CASE l.quality WHEN 0 THEN 'critical' WHEN 1 THEN 'low' END AS risk_level
    FROM documents d LEFT JOIN labels l USING (doc_id))
"""
ORACLES["similar_cases"] = f"""WITH {HYBRID}, {CORPUS}
SELECT query_id, count(*) OVER (PARTITION BY query_id) AS retrieved_examples, (rank - 1)::BIGINT AS pos,
    CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS preview, text,
    label, language, attack_type, risk_level, channel FROM hybrid JOIN corpus USING (doc_id)"""


ORACLES["gather_cases"] = f"""WITH {HYBRID}, {CORPUS}
SELECT query_id, rank, doc_id, text, label, language, attack_type, risk_level, channel FROM hybrid JOIN corpus USING (doc_id)"""


def _layout(gap: str) -> str:
    lead = "\n" if gap == " " else "\n\n"
    fields = [("Text", "text"), ("Label", "label"), ("Language", "language"), ("Attack Type", "attack_type"), ("Risk Level", "risk_level")]
    body = " || ".join(f"'{lead}{title}:{gap}' || coalesce({column}, 'None')" for title, column in fields)
    return f"""
blocks AS (SELECT query_id, string_agg('\nExample ' || rank || {body} || '\n', '\n' ORDER BY rank) AS context
    FROM hybrid JOIN corpus USING (doc_id) GROUP BY query_id)"""


ORACLES["context_block"] = f"WITH {HYBRID}, {CORPUS}, {_layout(' ')} SELECT * FROM blocks"
ORACLES["context_block_spaced"] = "WITH {}, {}, {} SELECT * FROM blocks".format(HYBRID, CORPUS, _layout("\n"))

# --- text and URLs -------------------------------------------------------------------

ORACLES["normalise_text"] = f"""SELECT doc_id, {_norm('text')} AS norm_text, len({_words('text')}) AS n_tokens FROM documents"""
ORACLES["load_corpus"] = f"""WITH {CORPUS}
SELECT doc_id, text, {_norm('text')} AS norm_text, label, language, attack_type, risk_level, channel FROM corpus WHERE doc_id % 7 <> 0"""
ORACLES["corpus_header_rows"] = f"""WITH {CORPUS}
SELECT doc_id, label, language, channel, {_norm('text')} AS norm_text FROM corpus"""
ORACLES["validate_messages"] = """
WITH m AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations
    UNION ALL SELECT conv_id, turn + 1000, left(md5(text), (turn % 7)::INT) FROM conversations)
SELECT conv_id, turn, text, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 5 THEN 'too_short' END AS error FROM m"""

URLS = """
urls AS (
SELECT page_id, 0::BIGINT AS variant, url FROM pages
UNION ALL SELECT page_id, 1, regexp_replace(url, '\\.example\\.[a-z]+', '-secure-login.xyz', 'g') FROM pages
UNION ALL SELECT page_id, 2, regexp_replace(url, '^https?://', 'www.') FROM pages
UNION ALL SELECT page_id, 3, regexp_replace(url, '^https?://', 'HTTPS://User@') FROM pages
UNION ALL SELECT page_id, 4, regexp_replace(url, '\\.example\\.[a-z]+', '.paypal.verify-account.tk:8080', 'g') FROM pages
UNION ALL SELECT page_id, 5, 'http://192.168.' || page_id % 300 || '.1/login;v=' || page_id FROM pages
UNION ALL SELECT page_id, 6, 'https://example.org/a;x=1/b;y=' || page_id || '?urgent-verification#won' FROM pages
UNION ALL SELECT page_id, 7, 'host-' || page_id || '.live/free/prize' FROM pages)
"""
# RE2 classes are ASCII unless named; the texts hold Latin letters beyond ASCII.
_W = "\\pL\\pN_\\-"


def _is_url(column: str, strict: bool = False) -> str:
    host = f"^[{_W}]+(\\.[{_W}]+)*\\.[a-z]{{2,}}(:\\d+)?([/?#]\\S*)?$" if strict else f"^[{_W}]+\\.[a-z]{{2,}}"
    text = f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"
    return (f"({text} LIKE 'http://%' OR {text} LIKE 'https://%' OR {text} LIKE 'www.%' "
            f"OR regexp_matches({text}, '{host}'))")


ORACLES["url_detect"] = f"""WITH {URLS}, every AS (SELECT * FROM urls UNION ALL SELECT conv_id, turn + 100, text FROM conversations)
SELECT page_id, variant, {_is_url('url')} AS is_url, {_is_url('url', True)} AS is_url_strict FROM every"""


def _features(words, tlds, assume: bool = False, name: str = "feat") -> str:
    cleaned = "CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://') THEN url ELSE 'http://' || url END" if assume else "url"
    split = "^(?:([a-zA-Z][a-zA-Z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)"
    return f"""
{name}_c AS (SELECT page_id, variant, url, {cleaned} AS c FROM urls),
{name}_p AS (SELECT page_id, variant, url, lower(regexp_extract(c, '{split}', 1)) AS scheme,
    regexp_extract(c, '{split}', 2) AS domain, regexp_extract(c, '{split}', 3) AS raw_path FROM {name}_c),
{name}_l AS (SELECT *, string_split(domain, '.') AS l,
    CASE WHEN list_contains({_list(lexicons.PARAM_SCHEMES)}, scheme) THEN regexp_replace(raw_path, ';[^/]*$', '') ELSE raw_path END AS path
    FROM {name}_p),
{name} AS (SELECT page_id, variant, url, scheme, domain, path,
    CASE WHEN len(l) > 2 THEN array_to_string(l[1:len(l) - 2], '.') ELSE '' END AS subdomain,
    length(url) AS url_length, regexp_matches(domain, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') AS has_ip, contains(url, '@') AS has_at,
    length(domain) - length(replace(domain, '-', '')) AS dash_count, greatest(len(l) - 2, 0) AS subdomain_count,
    scheme = 'https' AS is_https, list_contains({_list(tlds)}, '.' || l[-1]) AS suspicious_tld,
    list_filter({_list(words)}, lambda w: contains(lower(url), w)) AS hits FROM {name}_l)
"""


FEATURE_COLUMNS = """page_id, variant, url_length, dash_count, subdomain_count, domain, subdomain, path, scheme, has_ip, has_at,
is_https, suspicious_tld, array_to_string(hits, ',') AS words"""
FULL = _features(lexicons.WORDS, lexicons.TLDS)
ORACLES["url_features"] = f"WITH {URLS}, {FULL} SELECT {FEATURE_COLUMNS} FROM feat"
ORACLES["url_features_strict"] = (
    f"WITH {URLS}, {_features(list(dict.fromkeys(lexicons.WORDS)), lexicons.TLDS, True)} SELECT {FEATURE_COLUMNS} FROM feat"
)
ORACLES["url_features_small_lists"] = (
    f"WITH {URLS}, {_features(lexicons.SMALL_WORDS, lexicons.SMALL_TLDS)} SELECT {FEATURE_COLUMNS} FROM feat"
)


def _feature_text(lang: str) -> str:
    t = {k: v.replace("'", "''") for k, v in lexicons.FEATURE_TEXT[lang].items()}

    def flag(name: str) -> str:
        return f"'{t[name]}' || CASE WHEN {name} THEN '{t['yes']}' ELSE '{t['no']}' END"

    lines = [
        f"'{t['url']}' || url", f"'{t['domain']}' || domain",
        f"'{t['subdomain']}' || CASE WHEN subdomain = '' THEN '{t['none']}' ELSE subdomain END",
        f"'{t['path']}' || CASE WHEN path = '' THEN '/' ELSE path END", f"'{t['scheme']}' || upper(scheme)",
        f"'{t['url_length']}' || url_length || '{t['url_length_unit']}'", flag("has_ip"), flag("has_at"),
        f"'{t['dash_count']}' || dash_count", f"'{t['subdomain_count']}' || subdomain_count", flag("is_https"),
        flag("suspicious_tld"),
        f"'{t['suspicious_words']}' || CASE WHEN len(hits) = 0 THEN '{t['none']}' ELSE array_to_string(hits, ', ') END",
    ]
    return "concat_ws('\n', " + ", ".join(lines) + ")"


ORACLES["url_features_text"] = f"""WITH {URLS}, {FULL}
SELECT page_id, variant, {_feature_text('en')} AS en, {_feature_text('fr')} AS fr FROM feat"""
ORACLES["lexicon_hits"] = f"WITH {URLS}, {FULL} SELECT word, count(*) AS n FROM (SELECT unnest(hits) AS word FROM feat) GROUP BY word"
ORACLES["long_lexicon_hits"] = f"""WITH {URLS}, words AS (SELECT DISTINCT unnest({_words('text')}) AS word FROM benchmark),
texts AS (SELECT page_id, variant, lower(url) AS t FROM urls UNION ALL SELECT item_id, 100, lower(text) FROM benchmark)
SELECT page_id, variant, count(*) AS n, sum(length(word))::BIGINT AS letters, min(word) AS first FROM texts JOIN words ON contains(t, word) GROUP BY ALL"""
ORACLES["route_messages"] = f"""WITH {URLS}, m AS (
SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'
UNION ALL SELECT page_id * 10 + variant + 100000000, url FROM urls),
s AS (SELECT query_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM m),
routed AS (SELECT query_id, text AS url, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 5 THEN 'too_short' END AS error,
    {_is_url('text')} AND length(text) >= 5 AS is_url FROM s),
{FULL.replace('FROM urls', 'FROM routed').replace('page_id, variant', 'query_id')},
texts AS (SELECT query_id, {_feature_text('en')} AS feature_text FROM feat)
SELECT r.query_id, error, CASE WHEN error IS NULL THEN CASE WHEN is_url THEN 'url' ELSE 'message' END END AS channel, is_url,
    CASE WHEN is_url THEN feature_text WHEN error IS NULL THEN url END AS search_text
FROM routed r JOIN texts USING (query_id)"""

# --- profile -------------------------------------------------------------------------

ORACLES["corpus_profile"] = f"""WITH {CORPUS}
SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM corpus
UNION ALL SELECT 'label', v, count(doc_id) FROM (VALUES ('phishing'), ('legitimate')) x(v) LEFT JOIN corpus ON label = v GROUP BY v
UNION ALL SELECT 'channel', channel, count(*) FROM corpus WHERE channel IS NOT NULL GROUP BY channel
UNION ALL SELECT 'language', v, count(doc_id) FROM (VALUES ('en'), ('ar'), ('fr')) x(v) LEFT JOIN corpus ON language = v GROUP BY v
UNION ALL SELECT 'attack_type', attack_type, count(*) FROM corpus WHERE attack_type IS NOT NULL GROUP BY attack_type"""
ORACLES["channel_counts"] = f"WITH {CORPUS} SELECT channel AS value, count(*) AS n FROM corpus WHERE channel IS NOT NULL GROUP BY 1"
ORACLES["attack_counts"] = f"WITH {CORPUS} SELECT attack_type AS value, count(*) AS n FROM corpus WHERE attack_type IS NOT NULL GROUP BY 1"
ORACLES["language_counts"] = f"""WITH {CORPUS}
SELECT name AS language, count(doc_id) AS n FROM (VALUES ('en', 'English'), ('ar', 'Arabic'), ('fr', 'French')) x(v, name)
LEFT JOIN corpus ON language = v GROUP BY name"""
ORACLES["label_distribution"] = f"WITH {CORPUS} SELECT label, count(*) AS n FROM corpus WHERE label IS NOT NULL GROUP BY 1"
ORACLES["languages"] = f"WITH {CORPUS} SELECT DISTINCT language FROM corpus WHERE label IS NOT NULL"

# --- verdicts ------------------------------------------------------------------------

RESPONSES = f"""{CORPUS},
responses AS (SELECT doc_id AS query_id, 'model_a' AS model, language, label AS truth, (doc_id % 100) / 100.0 AS seconds,
CASE substr(md5(doc_id || ':r'), 1, 1)
WHEN '0' THEN NULL WHEN '1' THEN '' WHEN '2' THEN 'no json here ' || doc_id
WHEN '3' THEN '<think>{{"label":"x"}}</think>\n```json\n{{"label":"Phishing","confidence":"high","risk_score":85}}\n```'
WHEN '4' THEN 'Sure: {{"label":"legit","confidence":1.7,"risk_score":"12"}} ok'
WHEN '5' THEN '{{"confidence":0.29,"risk_score":"75.9"}}'
WHEN '6' THEN '{{"label":"phishing","confidence":"0.8","risk_score":40.9}}'
WHEN '7' THEN '{{"label":"phishing","confidence": }}'
WHEN '8' THEN '{{"label":"''legitimate''","confidence":true,"risk_score":null}}'
ELSE '{{"label":"' || coalesce(label, 'unsure') || '","confidence":0.' || lpad((doc_id * 5 % 1000)::VARCHAR, 3, '0')
  || ',"risk_score":' || doc_id % 101 || ',"language":"' || language || '","attack_type":"none","explanation":"case ' || doc_id
  || '","suspicious_elements":["e' || doc_id || '","x"],"recommendation":"wait"}}' END AS raw FROM corpus),
spoken AS (SELECT *, regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g') AS said FROM responses),
found AS (SELECT *, coalesce(nullif(regexp_extract(said, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1), ''),
    nullif(regexp_extract(said, '(?s)\\{{.*\\}}', 0), '')) AS fenced,
    nullif(regexp_extract(raw, '(?s)\\{{.*\\}}', 0), '') AS greedy FROM spoken)
"""
ORACLES["verdict_extract"] = f"""WITH {RESPONSES}
SELECT query_id, fenced, greedy, coalesce(fenced, trim(said)) AS fallback FROM found"""


def _parsed(json: str = "fenced", missing: str = "no_json") -> str:
    return f"""
parsed AS (SELECT *, CASE WHEN json IS NULL OR json = '' THEN '{missing}' WHEN NOT json_valid(json) THEN 'json_parse' END AS error_type
    FROM (SELECT *, CASE WHEN length(raw) > 0 THEN {json} END AS json FROM found)),
fields AS (SELECT *, CASE WHEN error_type IS NULL THEN json END AS j FROM parsed),
typed AS (SELECT *, j ->> '$.label' AS raw_label,
    coalesce(json_type(j, '$.confidence'), 'NULL') AS ct, j ->> '$.confidence' AS cv,
    coalesce(json_type(j, '$.risk_score'), 'NULL') AS rt, j ->> '$.risk_score' AS rv FROM fields),
valued AS (SELECT *,
    CASE WHEN error_type IS NOT NULL THEN 'error'
         WHEN contains(lower(coalesce(raw_label, 'unknown')), 'phishing') THEN 'phishing'
         WHEN contains(lower(coalesce(raw_label, 'unknown')), 'legitimate') THEN 'legitimate' ELSE 'unknown' END AS label,
    CASE WHEN error_type IS NOT NULL THEN 0.0 WHEN ct = 'VARCHAR' THEN CASE lower(cv) WHEN 'low' THEN 0.3 WHEN 'medium' THEN 0.6 WHEN 'high' THEN 0.9 ELSE 0.0 END
         WHEN ct = 'BOOLEAN' THEN CASE cv WHEN 'true' THEN 1.0 ELSE 0.0 END
         WHEN ct = 'NULL' THEN 0.0 ELSE greatest(0.0, least(1.0, cv::DOUBLE)) END::DOUBLE AS conf,
    CASE WHEN error_type IS NOT NULL THEN 0 WHEN rt = 'VARCHAR' THEN CASE WHEN regexp_matches(trim(rv), '^[+-]?\\d+$') THEN trim(rv)::BIGINT ELSE 0 END
         WHEN rt = 'NULL' THEN 0 ELSE trunc(rv::DOUBLE)::BIGINT END AS risk FROM typed),
exact AS (SELECT *, (conf * 1152921504606846976.0::DOUBLE)::HUGEINT * 100 AS m FROM valued),
halves AS (SELECT *, m // 1152921504606846976::HUGEINT AS whole, m % 1152921504606846976::HUGEINT AS rest FROM exact),
verdicts AS (SELECT *, (whole + CASE WHEN rest > 576460752303423488 OR (rest = 576460752303423488 AND whole % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 100.0 AS confidence,
    CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 40 THEN 'medium' ELSE 'low' END AS risk_level FROM halves)
"""


ORACLES["verdict_normalise"] = f"""WITH {RESPONSES}, {_parsed()}
SELECT query_id, error_type, label, label AS classification, confidence, trunc(confidence * 100)::BIGINT AS confidence_pct,
    risk AS risk_score, risk_level,
    coalesce(j ->> '$.attack_type', '') AS attack_type,
    CASE WHEN error_type IS NOT NULL THEN 'Analysis failed: ' || error_type ELSE coalesce(j ->> '$.explanation', '') END AS explanation,
    coalesce(j ->> '$.language', '') AS answer_language,
    CASE WHEN error_type IS NOT NULL THEN 'Please try again.' ELSE coalesce(j ->> '$.recommendation', '') END AS recommendations,
    label <> 'legitimate' OR risk BETWEEN 0 AND 30 AS risk_consistent,
    coalesce(array_to_string(j ->> '$.suspicious_elements[*]', ','), '') AS elements FROM verdicts"""
ORACLES["verdict_two_way"] = f"""WITH {RESPONSES}, {_parsed()}
SELECT query_id, CASE label WHEN 'unknown' THEN 'legitimate' ELSE label END AS label, round(conf, 6) AS confidence FROM verdicts"""
ORACLES["risk_bands"] = f"""WITH {RESPONSES}, {_parsed()}
SELECT risk_level, label, count(*) AS n, sum(risk)::BIGINT AS risk FROM verdicts GROUP BY ALL"""
FALLBACK = _parsed("coalesce(fenced, trim(said))", "json_parse")
ORACLES["verdict_errors"] = f"""WITH {RESPONSES}, {FALLBACK}
SELECT error_type, count(*) AS n FROM verdicts WHERE error_type IS NOT NULL GROUP BY 1"""
ORACLES["prediction_rows"] = f"""WITH {RESPONSES}, {FALLBACK}
SELECT model, truth AS true_label, label AS pred_label, confidence, risk AS risk_score, coalesce(j ->> '$.attack_type', '') AS attack_type,
    CASE WHEN error_type IS NOT NULL THEN 'Please try again.' ELSE coalesce(j ->> '$.recommendation', '') END AS recommendation,
    CASE WHEN error_type IS NOT NULL THEN 'Analysis failed: ' || error_type ELSE coalesce(j ->> '$.explanation', '') END AS explanation,
    '[' || coalesce(array_to_string(list_transform(j ->> '$.suspicious_elements[*]', lambda e: '''' || e || ''''), ', '), '') || ']' AS suspicious,
    (query_id % 100) / 100.0::DOUBLE AS response_time, language FROM verdicts"""

# --- samples and retrieval metrics -----------------------------------------------------

ORACLES["sample_simple"] = "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100"
ORACLES["sample_stratified"] = f"""WITH {CORPUS}
SELECT doc_id, label FROM corpus WHERE label IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) <= 50"""

ORACLES["sample_threshold"] = ORACLES["sample_stratified"].replace("<= 50", "<= 300")
ORACLES["sample_head"] = f"SELECT * FROM ({ORACLES['sample_stratified']}) ORDER BY doc_id LIMIT 100"


def _metrics(name: str, queries: str, embedding: str) -> str:
    return f"""
{name}_v AS (SELECT vec_id, label, {embedding} AS e FROM embeddings),
{name}_q AS ({queries}),
{name}_p AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, v.label AS ql, d.label AS dl, round(list_inner_product(v.e, d.e), 6) AS score
    FROM {name}_q q JOIN {name}_v v USING (vec_id) JOIN {name}_v d ON q.vec_id <> d.vec_id),
{name}_r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS rank FROM {name}_p QUALIFY rank <= 5),
{name}_n AS (SELECT label, count(*) AS n_rel FROM embeddings GROUP BY 1),
{name}_a AS (SELECT query_id, any_value(n_rel) AS n_rel, count(*) AS top, count(*) FILTER (ql = dl) AS found,
    min(rank) FILTER (ql = dl) AS first, coalesce(sum(1.0 / log2(rank + 1)) FILTER (ql = dl), 0) AS dcg
    FROM {name}_r JOIN {name}_n ON ql = label GROUP BY query_id),
{name} AS (SELECT query_id, found / top AS precision, found / n_rel AS recall, (found > 0)::INT::DOUBLE AS hit,
    coalesce(1.0 / first, 0)::DOUBLE AS rr,
    dcg / list_sum(list_transform(range(1, least(n_rel, 5) + 1), lambda i: 1.0 / log2(i + 1))) AS ndcg FROM {name}_a)
"""


PLAIN = "embedding::DOUBLE[]"
ORACLES["retrieval_metrics"] = f"""WITH {_metrics('m', 'SELECT vec_id FROM embeddings', PLAIN)}
SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, hit, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM m"""
SAMPLE = "SELECT vec_id FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 100"
HALF = ("list_transform(embedding[1:32], lambda x: (x::DOUBLE / sqrt(list_sum(list_transform(embedding[1:32], "
        "lambda y: y::DOUBLE * y::DOUBLE))))::FLOAT)::DOUBLE[]")


def _mean(name: str, model: str, dim: int) -> str:
    parts = ", ".join(
        f"round_even(round(avg({a}), 12), 4) AS {b}"
        for a, b in [("precision", "precision"), ("recall", "recall"), ("hit", "hit_rate"), ("rr", "mrr"), ("ndcg", "ndcg")]
    )
    return f"""SELECT '{model}' AS model, (SELECT count(*) FROM embeddings) AS n, {dim}::BIGINT AS dim,
    round((SELECT count(*) FROM embeddings) * {dim} * 4 / 1048576.0, 2) AS index_size_mb, count(*) AS queries, {parts} FROM {name}"""


ORACLES["retrieval_benchmark"] = f"""WITH {_metrics('f', SAMPLE, PLAIN)}, {_metrics('h', SAMPLE, HALF)}
{_mean('f', 'full', 64)} UNION ALL {_mean('h', 'half', 32)}"""

# --- classification metrics ------------------------------------------------------------

PREDICTIONS = f"""{CORPUS},
digest AS (SELECT doc_id, model, label, language, md5(doc_id || ':' || model) AS h
    FROM corpus, (VALUES ('model_a'), ('model_b'), ('model_c')) m(model) WHERE label IS NOT NULL),
predictions AS (SELECT doc_id, model, language, label AS t,
    CASE WHEN h[1] = '0' THEN 'error' WHEN h[1] = '1' THEN 'unknown'
         WHEN h[1] >= '9' THEN CASE label WHEN 'phishing' THEN 'legitimate' ELSE 'phishing' END ELSE label END AS p,
    ('0x' || substr(h, 2, 2))::INT / 100.0 AS seconds FROM digest)
"""


def _rates(keys: str, name: str) -> str:
    return f"""
{name}_v AS (SELECT * FROM predictions WHERE p IN ('phishing', 'legitimate')),
{name}_c AS (SELECT {keys}, c AS class, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t <> c AND p = c) AS fp,
    count(*) FILTER (t = c AND p <> c) AS fn FROM {name}_v, (VALUES ('phishing'), ('legitimate')) x(c)
    GROUP BY ALL HAVING tp + fp + fn > 0),
{name}_k AS (SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM {name}_c)
"""


def _even(expr: str, digits: int = 4) -> str:
    return f"round_even(round(({expr})::DOUBLE, 12), {digits})"


ORACLES["confusion_matrix"] = f"""WITH {PREDICTIONS}, grid AS (SELECT a.c AS t, b.c AS p, m FROM
    (VALUES ('phishing'), ('legitimate')) a(c), (VALUES ('phishing'), ('legitimate')) b(c), (SELECT DISTINCT model AS m FROM predictions) x)
SELECT g.m AS model, g.t AS true_label, g.p AS pred_label, count(doc_id) AS n FROM grid g
LEFT JOIN predictions q ON q.model = g.m AND q.t = g.t AND q.p = g.p GROUP BY ALL"""
ORACLES["classification_summary"] = f"""WITH {PREDICTIONS}, {_rates('model', 's')},
a AS (SELECT model, count(*) FILTER (p IN ('phishing', 'legitimate')) AS valid, count(*) FILTER (p NOT IN ('phishing', 'legitimate')) AS errors,
    count(*) FILTER (t = p) AS good, avg(seconds) FILTER (p IN ('phishing', 'legitimate')) AS sec FROM predictions GROUP BY 1),
r AS (SELECT model, max(precision) FILTER (class = 'phishing') AS pr, max(recall) FILTER (class = 'phishing') AS rc,
    max(f1) FILTER (class = 'phishing') AS fp, max(f1) FILTER (class = 'legitimate') AS fl, avg(f1) AS fm FROM s_k GROUP BY 1)
SELECT model, {_even('good / valid')} AS accuracy, {_even('pr')} AS precision, {_even('rc')} AS recall, {_even('fp')} AS f1_phishing,
    {_even('fl')} AS f1_legitimate, {_even('fm')} AS f1_macro, {_even('sec', 2)} AS avg_time, valid, errors FROM a JOIN r USING (model)"""
ORACLES["classification_by_language"] = f"""WITH {PREDICTIONS}, {_rates('model, language', 's')}
SELECT model, language, samples, accuracy, f1_macro FROM
(SELECT model, language, count(*) AS samples, {_even('avg((t = p)::INT)')} AS accuracy FROM s_v GROUP BY ALL)
JOIN (SELECT model, language, {_even('avg(f1)')} AS f1_macro FROM s_k GROUP BY ALL) USING (model, language)"""
ORACLES["classification_report"] = f"""WITH {PREDICTIONS}, {_rates('model', 's')}, every AS (
SELECT model, class, precision, recall, f1, support FROM s_k
UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s_k GROUP BY model
UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM s_k GROUP BY model
UNION ALL SELECT model, 'accuracy', NULL, NULL, avg((t = p)::INT), count(*) FROM s_v GROUP BY model)
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM every"""
ORACLES["prediction_crosstab"] = f"""WITH {PREDICTIONS}
SELECT model, count(*) FILTER (p = 'phishing') AS phishing, count(*) FILTER (p = 'legitimate') AS legitimate,
    count(*) FILTER (p = 'unknown') AS unknown, count(*) FILTER (p = 'error') AS error FROM predictions GROUP BY model"""

# --- knowledge base --------------------------------------------------------------------


def _chunks(source: str, name: str, columns: str) -> str:
    return f"""
{name}_f AS (SELECT {columns}, trim(replace(text, chr(10), ' '), e' \\t\\r') AS t FROM ({source})),
{name}_n AS (SELECT *, unnest(range(0, (length(t) + 499) // 500)) AS chunk_id FROM {name}_f),
{name} AS (SELECT {columns}, chunk_id, substring(t, chunk_id * 500 + 1, 500) AS chunk FROM {name}_n
    WHERE length(substring(t, chunk_id * 500 + 1, 500)) > 50)
"""


ORACLES["accepted_names"] = f"""WITH {URLS}, n AS (SELECT page_id, variant,
    string_split(url, '/')[-1] || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '' END AS name FROM urls)
SELECT page_id, variant, name, CASE WHEN name = '' THEN 'no_name' WHEN NOT ends_with(name, '.pdf') THEN 'not_pdf' END AS reject_reason FROM n"""
DOC_CHUNKS = _chunks("SELECT doc_id::VARCHAR AS source_name, text FROM documents", "ch", "source_name")
ORACLES["chunk_documents"] = f"WITH {DOC_CHUNKS} SELECT * FROM ch"
ORACLES["kb_ingest_stream"] = ORACLES["chunk_documents"]
ORACLES["assemble_pages"] = """SELECT 'conv' || conv_id || '.pdf' AS name, count(*) AS n_pages,
string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY ALL"""
HOST_PAGES = """SELECT name AS source_name, string_agg(html || chr(10), '' ORDER BY page_id) AS text FROM (
    SELECT regexp_extract(url, '^[a-z]+://[^/:?#]*\\.([a-z]+)', 1) || '.pdf' AS name, page_id, html FROM pages) GROUP BY name"""
ORACLES["chunk_pages"] = "WITH {} SELECT * FROM ch".format(_chunks(HOST_PAGES, "ch", "source_name"))
KB = f"""{_chunks("SELECT 'doc' || doc_id AS source_name, text FROM documents", 'ch', 'source_name')},
ck AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source_name, chunk_id) AS key FROM ch),
{_vectors('kv', 'SELECT key, chunk AS text FROM ck', 'key')},
{_dense(BENCH, 'kb', 'kv_v', 'key', 3)},
hits AS (SELECT query_id, rank, score, source_name, chunk_id, chunk FROM kb JOIN ck USING (key))
"""
ORACLES["kb_search"] = f"WITH {KB} SELECT * FROM hits"
ORACLES["kb_search_cells"] = ORACLES["kb_search"]
ORACLES["knowledge_block"] = f"""WITH {KB}
SELECT query_id, '\nPDF Knowledge:\n' || string_agg('\n    Document ' || rank || ':\n    ' || chunk || '\n\n    ', '' ORDER BY rank) AS knowledge
FROM hits GROUP BY query_id"""

REGISTRY = """
log AS (SELECT 'doc' || user_id || '.pdf' AS name, floor(value)::BIGINT AS pages, ts AS added_at, 'uploads/doc' || user_id || '.pdf' AS path,
    CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_id AS seq FROM events),
latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY name ORDER BY added_at DESC, seq DESC) = 1),
active AS (SELECT * FROM latest WHERE op <> 'delete')
"""
ORACLES["registry_latest"] = f"WITH {REGISTRY} SELECT * FROM latest"
ORACLES["registry_active"] = f"WITH {REGISTRY} SELECT * FROM active"
ORACLES["registry_listing"] = f"""WITH {REGISTRY}
SELECT name, pages, strftime(added_at, '%Y-%m-%d %H:%M:%S') AS added_date, path FROM active"""
ORACLES["registry_delete"] = f"""WITH {REGISTRY}
SELECT 'doc' || c_custkey || '.pdf' AS name, pages, TIMESTAMP '2025-01-01 00:00:00' AS added_at, path, 'delete' AS op, c_custkey AS seq,
    a.name IS NOT NULL AS found FROM customer LEFT JOIN active a ON a.name = 'doc' || c_custkey || '.pdf'"""
_PROFILE = ORACLES["corpus_profile"].removeprefix(f"WITH {CORPUS}")
ORACLES["registry_status"] = f"""WITH {REGISTRY}, {CORPUS}
SELECT 'documents' AS dimension, 'active' AS value, count(*) AS n FROM active UNION ALL {_PROFILE}"""
ORACLES["visible_chunks"] = f"""WITH {REGISTRY}, {_chunks("SELECT 'doc' || doc_id || '.pdf' AS source_name, text FROM documents", 'ch', 'source_name')}
SELECT source_name, chunk_id FROM ch WHERE source_name NOT IN (SELECT name FROM latest WHERE op = 'delete')"""

# --- history, prompts, screening ---------------------------------------------------------

ORACLES["history_recent"] = """
WITH h AS (SELECT ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'phishing' ELSE 'legitimate' END AS label,
    CASE event_type WHEN 'error' THEN 'critical' ELSE 'low' END AS risk_level, repeat(props || ' ', event_id % 12) AS text FROM events)
SELECT ts, seq, label, risk_level, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview FROM h"""
_HEAD, _REST = context.TEMPLATES["cases_only"].split("[[context]]")
_MIDDLE, _TAIL = _REST.split("[[message]]")
ORACLES["prompt_table"] = f"""WITH {HYBRID}, {CORPUS}, {_layout(' ')}
SELECT b.query_id, '{_HEAD}' || coalesce(context, '') || '{_MIDDLE}' || text || '{_TAIL}' AS prompt
FROM ({BENCH}) b LEFT JOIN blocks USING (query_id)"""
LINKS = f"""links AS (SELECT query_id + 1000000000 AS query_id, 'http://secure-' || query_id || '.paypal.verify-account.tk/login?won=' || query_id AS url FROM ({BENCH})),
{FULL.replace('FROM urls', 'FROM links').replace('page_id, variant', 'query_id')},
asked AS MATERIALIZED (SELECT query_id, CASE WHEN {_is_url('text')} THEN 'url' ELSE 'message' END AS channel, text AS search FROM ({BENCH})
    UNION ALL SELECT query_id, 'url', {_feature_text('en')} FROM feat)
"""
ASKED = "SELECT query_id, search AS text FROM asked"
_HEAD2, _REST2 = context.TEMPLATES["screen"].split("[[context]]")
_MIDDLE2, _TAIL2 = _REST2.split("[[message]]")
_KNOWN = ORACLES["knowledge_block"].removeprefix(f"WITH {KB}")
ORACLES["screen_messages"] = f"""WITH {LINKS}, {HYBRID.replace(BENCH, ASKED)}, {RESPONSES}, {_parsed()}, {_layout(' ')}, {KB.replace(BENCH, ASKED)},
known AS ({_KNOWN}),
cases AS (SELECT query_id, count(*) AS n, string_agg(coalesce(label, '-'), ',' ORDER BY rank) AS labels
    FROM hybrid JOIN corpus USING (doc_id) GROUP BY query_id)
SELECT b.query_id, channel, v.label, v.risk_level, trunc(v.confidence * 100)::BIGINT AS confidence_pct,
    CASE WHEN v.label = 'error' THEN 0 ELSE coalesce(c.n, 0) END AS retrieved_examples,
    CASE WHEN v.label = 'error' THEN '' ELSE coalesce(c.labels, '') END AS case_labels, search AS search_text, coalesce(knowledge, '') AS knowledge,
    '{_HEAD2}' || coalesce(context, '') || coalesce(knowledge, '') || '{_MIDDLE2}' || search || '{_TAIL2}' AS prompt
FROM asked b LEFT JOIN verdicts v ON v.query_id = b.query_id % 1000000000 LEFT JOIN cases c ON c.query_id = b.query_id
    LEFT JOIN blocks ON blocks.query_id = b.query_id LEFT JOIN known ON known.query_id = b.query_id"""
ORACLES["screen_stream"] = f"""WITH s AS (SELECT conv_id * 1000 + turn AS query_id,
    regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role = 'user')
SELECT query_id, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 5 THEN 'too_short' END AS error,
    CASE WHEN length(text) >= 5 THEN CASE WHEN {_is_url('text')} THEN 'url' ELSE 'message' END END AS channel,
    length(text) >= 5 AND {_is_url('text')} AS is_url, CASE WHEN length(text) >= 5 THEN text END AS search_text FROM s"""

# --- sinks read back ---------------------------------------------------------------------

ORACLES["kb_pages_stream"] = "WITH {} SELECT source_name, chunk_id, chunk FROM ch".format(_chunks("""
    SELECT 'conv' || conv_id || '.pdf' AS source_name, string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
    "ch", "source_name"))
ORACLES["kb_two_sources"] = """WITH {} SELECT source_name, chunk_id, chunk FROM ch""".format(_chunks("""
    SELECT doc_id::VARCHAR AS source_name, CASE WHEN doc_id % 3 <> 0 THEN text WHEN doc_id % 2 = 0 THEN 'gone'
        WHEN doc_id % 10 = 3 THEN 'zz again ' || text ELSE 'again ' || text END AS text
    FROM documents WHERE doc_id % 5 <> 0""", "ch", "source_name"))
ORACLES["registry_round_trip"] = ORACLES["registry_listing"]
ORACLES["retrieval_report_round_trip"] = ORACLES["retrieval_benchmark"]
ORACLES["registry_compacted"] = ORACLES["registry_listing"]
ORACLES["history_page"] = f"SELECT * FROM ({ORACLES['history_recent']}) ORDER BY ts DESC, seq DESC LIMIT 200"
ORACLES["embed_incremental"] = ORACLES["embed_documents"]
ORACLES["report_round_trip"] = ORACLES["classification_summary"]
ORACLES["history_append"] = ORACLES["history_recent"]
ORACLES["history_clear"] = f"SELECT * FROM ({ORACLES['history_recent']}) WHERE label = 'phishing'"
