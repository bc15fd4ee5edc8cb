"""The alerting queries as plain SQL over the given tables, written apart from the DataFrame code."""

from __future__ import annotations

from ..functions.text import INSTRUCTIONS, STOPWORDS

SPACE_RE = r"[\s\p{Z}\x{0b}\x{85}]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def uid(kind: int, n: str) -> str:
    return f"concat('00000000-0000-0000-{kind:04d}-', lpad(CAST({n} AS VARCHAR), 12, '0'))"


def derived(*keys: str) -> str:
    h = f"sha256(to_json([{', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}]))"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE_RE}', ' ', 'g'))"


V = "v AS (SELECT vec_id, CAST(floor(vec_id / 10) AS BIGINT) AS q10, label, CAST(embedding AS DOUBLE[]) AS emb, len(embedding) AS dims FROM embeddings)"
RULES = f"""rules AS (
  SELECT vec_id, q10, label, emb, dims, {uid(1, 'q10 % 3')} AS tenant_id, 'user-' || (q10 % 7) AS owner,
         CASE WHEN vec_id % 70 = 0 THEN 'v2' ELSE 'v1' END AS version, vec_id % 90 <> 0 AS enabled,
         CASE WHEN vec_id % 40 = 0 THEN {uid(2, 'label')} END AS only_source,
         CAST(CAST(0.20 + 0.01 * (q10 % 10) AS FLOAT) AS DOUBLE) AS threshold,
         {uid(3, 'q10')} AS rule_id, {uid(4, 'q10')} AS rule_revision_id, {uid(5, 'vec_id')} AS rule_embedding_id
  FROM v WHERE vec_id % 10 = 0)"""
PAGES = f"""pg AS (
  SELECT vec_id, q10, label, emb, dims, {uid(1, 'vec_id % 3')} AS tenant_id, {uid(2, 'label')} AS source_id,
         {uid(6, 'vec_id')} AS page_id, {uid(7, 'vec_id')} AS revision_id, {uid(8, 'vec_id')} AS embedding_id,
         sha256('content-' || vec_id) AS content_sha256
  FROM v WHERE vec_id % 10 <> 0)"""
KEY = "sha256(to_json([p.tenant_id, r.rule_id, r.rule_revision_id, p.revision_id, p.content_sha256, 'test-embedding-model', 'v1', CAST(p.dims AS VARCHAR), 'unit_length']))"
MATCHED = f"""pairs AS (
  SELECT p.revision_id, p.vec_id AS page_vec, r.q10 AS rule_no, r.rule_id, r.rule_embedding_id, r.threshold, {KEY} AS match_key,
         list_cosine_similarity(p.emb, r.emb) AS similarity
  FROM pg p JOIN rules r ON p.tenant_id = r.tenant_id AND r.version = 'v1' AND r.dims = p.dims AND r.enabled
       AND (r.only_source IS NULL OR r.only_source = p.source_id)),
matched AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY 1.0 - similarity, rule_embedding_id) AS rank
    FROM pairs WHERE NOT isnan(similarity) AND similarity >= threshold) WHERE rank <= 10)"""

REVERSE = f"""WITH {V}, {RULES}, {PAGES}, {MATCHED}
SELECT revision_id, rule_id AS alert_rule_id, rule_embedding_id AS alert_embedding_id, rank, round(similarity, 6) AS similarity, threshold, match_key
FROM matched"""

HITS = f"""hits AS (
  SELECT r.rule_embedding_id AS query_id, p.embedding_id, p.source_id, list_cosine_similarity(p.emb, r.emb) AS similarity
  FROM rules r JOIN pg p ON p.tenant_id = r.tenant_id AND r.version = 'v1' AND p.dims = r.dims),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1.0 - similarity, embedding_id) AS n, count(*) OVER (PARTITION BY query_id) AS total
  FROM hits WHERE similarity >= CAST(CAST(0.05 AS FLOAT) AS DOUBLE))"""


def search_page(page: int) -> str:
    low = 5 * (page - 1)
    return f"""WITH {V}, {RULES}, {PAGES}, {HITS}
SELECT query_id, n - {low} AS rank, embedding_id, source_id, round(similarity, 6) AS similarity, total > {low + 5} AS has_more
FROM ranked WHERE n > {low} AND n <= {low + 5}"""


HISTORICAL = f"""WITH {V}, {RULES}, {PAGES}, found AS (
  SELECT r.rule_id, p.embedding_id, r.threshold, list_cosine_similarity(p.emb, r.emb) AS similarity
  FROM rules r JOIN pg p ON p.tenant_id = r.tenant_id AND r.version = 'v1' AND r.enabled AND p.dims = r.dims
       AND (r.only_source IS NULL OR r.only_source = p.source_id))
SELECT * FROM (
  SELECT rule_id AS alert_rule_id, embedding_id, row_number() OVER (PARTITION BY rule_id ORDER BY 1.0 - similarity, embedding_id) AS rank,
         round(similarity, 6) AS similarity, threshold
  FROM found WHERE similarity >= threshold) WHERE rank <= 5"""

FETCHES = f"""n AS (SELECT count(*) AS n FROM documents),
twice AS (
  SELECT doc_id AS seq, doc_id, text FROM documents UNION ALL SELECT doc_id + n AS seq, doc_id, text FROM documents, n),
f AS (
  SELECT seq, sha256({collapse('text')}) AS content_sha256, {uid(1, '0')} AS tenant_id, {uid(2, '(doc_id % (n // 5)) % 7')} AS source_id,
         'https://docs.example.com/p/' || (doc_id % (n // 5)) AS canonical_url, make_timestamp(seq * 60000000) AS fetched_at
  FROM twice, n),
a AS (SELECT *, {derived("'page'", 'tenant_id', 'source_id', 'canonical_url')} AS page_id FROM f),
arr AS (SELECT *, {derived("'revision'", 'tenant_id', 'page_id', 'content_sha256')} AS revision_id FROM a)"""

CHAIN = f"""WITH {FETCHES}
SELECT seq, page_id, revision_id, content_sha256, row_number() OVER (PARTITION BY page_id, content_sha256 ORDER BY seq) = 1 AS changed,
       lag(revision_id) OVER (PARTITION BY page_id ORDER BY seq) AS pointer_before
FROM arr"""

CURRENT = f"""WITH {FETCHES}
SELECT page_id, any_value(canonical_url) AS canonical_url, arg_max(revision_id, seq) AS latest_revision_id, arg_min(fetched_at, seq) AS first_seen_at,
       arg_max(fetched_at, seq) AS last_seen_at
FROM arr GROUP BY page_id"""

URLS = r"""WITH u AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
c AS (
  SELECT *, CASE WHEN host <> 'example.com' AND NOT ends_with(host, '.example.com') THEN 'host_not_allowed'
                 WHEN NOT (path IN ('/en', '/de') OR starts_with(path, '/en/') OR starts_with(path, '/de/')) THEN 'path_not_allowed' END AS reject_reason
  FROM u)
SELECT page_id, CASE WHEN reject_reason IS NULL THEN regexp_replace(url, '#.*$', '') END AS canonical, reject_reason FROM c"""

TOKENS = rf"""q AS (SELECT conv_id, turn, {collapse('text')} AS t FROM conversations WHERE role = 'user'),
raw AS (SELECT conv_id, turn, t, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS k FROM q),
tok0 AS (SELECT conv_id, turn, k, regexp_replace(w, '^[^\p{{L}}\p{{N}}_-]+|[^\p{{L}}\p{{N}}_-]+$', '', 'g') AS w FROM raw),
tok AS (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS i, translate(w, {AZ}) AS low FROM tok0 WHERE w <> ''),
kw AS (
  SELECT conv_id, turn, low AS text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(i)) AS n FROM tok
  WHERE length(low) >= 3 AND low NOT IN ({', '.join(f"'{s}'" for s in STOPWORDS)}) GROUP BY conv_id, turn, low),
cand AS (
  SELECT *, regexp_matches(w, '(?s)^\p{{Lu}}.*\p{{Ll}}') AND NOT (i = 1 AND low IN ({', '.join(f"'{s}'" for s in INSTRUCTIONS)})) AS c FROM tok),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, c ORDER BY i) AS run FROM cand),
ent0 AS (SELECT conv_id, turn, run, min(i) AS i, string_agg(w, ' ' ORDER BY i) AS text FROM runs WHERE c GROUP BY conv_id, turn, run),
ent1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, translate(text, {AZ}) ORDER BY i) AS again FROM ent0),
ent AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM ent1 WHERE again = 1)"""

KEYWORDS = f"""WITH {TOKENS}
SELECT q.conv_id, q.turn, coalesce(string_agg(kw.text, ' ' ORDER BY n), '') AS keywords
FROM q LEFT JOIN kw ON q.conv_id = kw.conv_id AND q.turn = kw.turn AND n <= 24 GROUP BY ALL"""
ENTITIES = f"""WITH {TOKENS}
SELECT q.conv_id, q.turn, coalesce(string_agg(ent.text, '|' ORDER BY n), '') AS entities
FROM q LEFT JOIN ent ON q.conv_id = ent.conv_id AND q.turn = ent.turn AND n <= 12 GROUP BY ALL"""
INPUT_ROWS = f"""{TOKENS},
parts AS (
  SELECT conv_id, turn, 1 AS part, 1 AS n, 'query' AS kind, t AS text, 1.2 AS weight FROM q
  UNION ALL SELECT conv_id, turn, 2, n, 'keyword', text, 0.6 FROM kw WHERE n <= 24
  UNION ALL SELECT conv_id, turn, 3, n, 'entity', text, 0.9 FROM ent WHERE n <= 12),
inputs AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY part, n) - 1 AS ordinal
  FROM parts p JOIN q ON p.conv_id = q.conv_id AND p.turn = q.turn WHERE length(t) BETWEEN 3 AND 700)"""
INPUTS = f"WITH {INPUT_ROWS} SELECT conv_id, turn, ordinal, kind, text, sha256(text) AS text_sha256, CAST(weight AS DOUBLE) AS weight FROM inputs"
REPORT = f"""WITH {INPUT_ROWS}
SELECT conv_id, kind, count(*) AS inputs, min(ordinal) AS first_ordinal, sum(length(text)) AS characters,
       round(sum(CAST(CAST(weight AS FLOAT) AS DOUBLE)), 6) AS weight
FROM inputs GROUP BY conv_id, kind"""

CENTROID = f"""WITH {V},
x AS (
  SELECT q10 AS set_id, vec_id % 10 AS o, 0.5 + 0.125 * (vec_id % 10) AS w, unnest(emb) AS e, generate_subscripts(emb, 1) - 1 AS place,
         sqrt(list_inner_product(emb, emb)) AS len FROM v),
m AS (SELECT set_id, place, sum(e / len * w) / sum(w) AS mean FROM x GROUP BY set_id, place),
l AS (SELECT set_id, sqrt(sum(mean * mean)) AS len FROM m GROUP BY set_id)
SELECT m.set_id, 'ok' AS status, m.place, round(CAST(CAST(mean / len AS FLOAT) AS DOUBLE), 5) AS value FROM m JOIN l ON m.set_id = l.set_id"""

SCOPE = f"""WITH {V}, {RULES}, asked AS (
  SELECT rule_id, only_source, CASE q10 % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [{uid(2, 'label')}]
         ELSE [{uid(2, 'label')}, {uid(2, '(label + 1) % 10')}] END AS req FROM rules)
SELECT rule_id AS alert_rule_id, only_source IS NULL OR len(req) = 0 OR req = [only_source] AS admitted,
       CASE WHEN only_source IS NULL THEN array_to_string(list_sort(req), ',') WHEN len(req) = 0 OR req = [only_source] THEN only_source END AS sources
FROM asked"""

LISTING = f"""WITH {V}, {RULES}, principals AS (SELECT DISTINCT tenant_id, owner AS subject FROM rules)
SELECT * FROM (
  SELECT r.tenant_id, subject, row_number() OVER (PARTITION BY r.tenant_id, subject ORDER BY r.vec_id DESC, rule_id) AS rank, rule_id AS alert_rule_id,
         owner AS owner_subject, 'rule ' || q10 AS name, enabled, round(threshold, 6) AS threshold
  FROM rules r JOIN principals p ON r.tenant_id = p.tenant_id AND (p.subject = r.owner OR p.subject = 'user-0')) WHERE rank <= 500"""

COUNTS = f"WITH {V}, {RULES} SELECT tenant_id, owner AS owner_subject, count(*) AS active_rules FROM rules WHERE enabled GROUP BY ALL"

CAP = f"""WITH firsts AS (
  SELECT {uid(1, 'user_id % 3')} AS tenant_id, 'user-' || user_id AS owner_subject, user_id || '-' || (event_id % 20) AS alert_rule_id, min((ts, event_id)) AS seq
  FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY ALL)
SELECT tenant_id, owner_subject, alert_rule_id, n AS nth, n <= 10 AS admitted FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, owner_subject ORDER BY seq, alert_rule_id) AS n FROM firsts)"""

UPSERT = f"""WITH {V}, {RULES}
SELECT vec_id AS seq, rule_id AS alert_rule_id, CASE WHEN NOT enabled THEN 'wrong_target' WHEN q10 % 2 = 0 THEN 'existing' ELSE 'created' END AS outcome FROM rules
UNION ALL SELECT vec_id + 1, rule_id, CASE WHEN NOT enabled THEN 'wrong_target' WHEN emb = list_reverse(emb) THEN 'existing' ELSE 'conflict' END FROM rules WHERE q10 % 5 = 0
UNION ALL SELECT vec_id + 2, rule_id, 'invalid_vector' FROM rules WHERE q10 % 11 = 0"""

DEDUP = f"""WITH {V}, {RULES}, {PAGES}, {MATCHED}
SELECT match_key AS canonical_match_key, revision_id, rule_id AS alert_rule_id,
       CASE WHEN rule_no % 2 = 1 THEN 'inserted' WHEN rule_no % 4 = 0 THEN 'conflict' ELSE 'existing' END AS outcome
FROM matched"""

CANDIDATE_COUNTS = f"""WITH {V}, {RULES}, {PAGES}, {MATCHED}
SELECT p.tenant_id, 'reverse_alert_stream' AS match_mode, count(*) AS candidates, count(DISTINCT m.revision_id) AS revisions
FROM matched m JOIN pg p ON m.revision_id = p.revision_id GROUP BY p.tenant_id"""

MATCH_KEY = f"""WITH {V}, {PAGES}
SELECT revision_id, sha256(to_json([tenant_id, {uid(3, 'q10')}, {uid(4, 'q10')}, revision_id, content_sha256, 'test-embedding-model', 'v1', CAST(dims AS VARCHAR), 'unit_length'])) AS match_key
FROM pg"""

VISIBILITY = """WITH users AS (SELECT DISTINCT user_id FROM events)
SELECT 'user-' || u.user_id AS subject, event_id, event_type FROM events e JOIN users u ON e.user_id % 3 = u.user_id % 3
WHERE u.user_id % 50 = 0 OR (u.user_id = e.user_id AND event_type <> 'error')"""

IMMUTABLE = f"""WITH {V}, {RULES}
SELECT rule_revision_id AS id, CASE WHEN q10 % 11 = 0 THEN 'deleted' ELSE 'mutated' END AS change,
       CASE WHEN q10 % 11 = 0 THEN '' WHEN q10 % 26 = 0 THEN 'name,similarity_threshold' ELSE 'similarity_threshold' END AS columns
FROM rules WHERE q10 % 11 = 0 OR q10 % 13 = 0"""

INTEGRITY = f"""WITH {V}, {PAGES}, gone AS (SELECT {uid(9, '0')} AS none)
SELECT 'reference' AS kind, 'page_revisions.page_id' AS name, to_json([tenant_id, page_id]) AS key, 1 + CAST(vec_id % 23 = 0 AS INT) AS rows FROM pg WHERE vec_id % 17 = 0
UNION ALL SELECT 'reference', 'page_embeddings.revision_id', to_json([tenant_id, none]), count(*) FROM pg, gone WHERE vec_id % 29 = 0 GROUP BY tenant_id, none
UNION ALL SELECT 'duplicate', 'page_revisions', to_json([tenant_id, page_id, content_sha256]), 2 FROM pg WHERE vec_id % 23 = 0
UNION ALL SELECT 'duplicate', 'page_embeddings', to_json([tenant_id, none, 'test-embedding-model', 'v1', CAST(dims AS VARCHAR), 'unit_length']), count(*)
FROM pg, gone WHERE vec_id % 29 = 0 GROUP BY tenant_id, none, dims HAVING count(*) > 1"""

INPUT_AUDIT = """SELECT * FROM (
  SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'kind' END, CASE WHEN doc_id % 128 > 95 THEN 'ordinal' END,
         CASE WHEN length(text) NOT BETWEEN 1 AND 700 THEN 'text' END, CASE WHEN doc_id % 10 IN (0, 8, 9) THEN 'weight' END) AS errors
  FROM documents) WHERE errors <> ''"""

FRONTIER = f"""WITH q AS (
  SELECT page_id, url, regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS host, regexp_replace(url, '#.*$', '') AS canonical_url, page_id % 5 AS depth,
         ['pending', 'failed', 'fetched', 'leased'][page_id % 4 + 1] AS status, page_id % 3 AS priority, (page_id % 10) * 3600 AS due FROM pages),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, canonical_url ORDER BY depth, priority, page_id) AS k FROM q) WHERE k = 1),
ready AS (SELECT * FROM one WHERE status IN ('pending', 'failed') AND due <= 21600 AND depth <= 3 AND NOT ends_with(host, '.net'))
SELECT * FROM (
  SELECT {derived("'source'", 'host')} AS source_id, canonical_url, row_number() OVER (PARTITION BY host ORDER BY due, priority, page_id, canonical_url) AS turn,
         priority, status FROM ready) WHERE turn <= 5"""

VIEWS = rf"""WITH clean AS (SELECT page_id, url, regexp_replace(html, '(?is)<(?:script\b.*?</script|style\b.*?</style)\s*>|<!--.*?-->', ' ', 'g') AS h FROM pages),
marked AS (
  SELECT page_id, 'title' AS kind, regexp_extract(h, '(?is)<title\b[^>]*>(.*?)</title', 1) AS t, 1.5 AS weight FROM clean
  UNION ALL SELECT page_id, 'heading', unnest(regexp_extract_all(h, '(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]', 1)), 1.2 FROM clean),
plain AS (
  SELECT page_id, kind, weight, {collapse("replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')")} AS text FROM marked),
words AS (
  SELECT page_id, unnest(regexp_split_to_array(translate(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), {AZ}), '[^a-z0-9]+')) AS text FROM pages)
SELECT DISTINCT page_id, kind, left(text, 700) AS text, CAST(weight AS DOUBLE) AS weight FROM plain WHERE text <> ''
UNION ALL SELECT DISTINCT page_id, 'url_signal', text, 0.5 FROM words WHERE length(text) >= 2 AND NOT regexp_full_match(text, '\d+')"""

CLAIMS = f"""WITH u AS (SELECT DISTINCT user_id AS n FROM events)
SELECT {uid(1, 'n % 3')} AS tenant_id, CAST(n AS VARCHAR) AS subject, CASE WHEN n % 50 = 0 THEN 'admin,member' ELSE 'editor,member' END AS roles,
       n % 50 = 0 AS is_tenant_admin FROM u WHERE n % 50 = 0 OR n % 3 = 0"""

#: SHA-256 of the big-endian bits of a vector's floats.
VECTOR_SHA = """bits AS (
  SELECT vec_id, sha256(string_agg(CAST(CAST(CASE WHEN x = 0 THEN 0 ELSE x END AS FLOAT) AS BIT)::VARCHAR, '' ORDER BY i)::BIT::BLOB) AS sha
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id)"""

CAP_LOG = f"""WITH RECURSIVE log AS (
  SELECT {uid(1, 'user_id % 3')} AS tenant_id, 'user-' || user_id AS owner_subject, user_id || '-' || (event_id % 20) AS rule, epoch_us(ts) AS seq, event_type <> 'error' AS enable
  FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, owner_subject ORDER BY seq, rule) AS n FROM log),
fold AS (
  SELECT tenant_id, owner_subject, 0 AS n, CAST([] AS VARCHAR[]) AS active, '' AS rule, CAST(0 AS BIGINT) AS seq, FALSE AS enable, FALSE AS admitted
  FROM (SELECT DISTINCT tenant_id, owner_subject FROM log)
  UNION ALL
  SELECT l.tenant_id, l.owner_subject, l.n,
         CASE WHEN NOT l.enable THEN [x FOR x IN f.active IF x <> l.rule]
              WHEN list_contains(f.active, l.rule) OR len(f.active) >= 10 THEN f.active ELSE list_append(f.active, l.rule) END,
         l.rule, l.seq, l.enable, NOT l.enable OR list_contains(f.active, l.rule) OR len(f.active) < 10
  FROM fold f JOIN numbered l ON l.tenant_id = f.tenant_id AND l.owner_subject = f.owner_subject AND l.n = f.n + 1)
SELECT tenant_id, owner_subject, rule AS alert_rule_id, seq, enable, admitted FROM fold WHERE n > 0"""

QUERY_VECTORS = f"""WITH {INPUT_ROWS},
w AS (SELECT conv_id, turn, ordinal, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS weight, unnest(string_split(translate(text, {AZ}), ' ')) AS word FROM inputs),
h AS (SELECT *, CAST('0x' || substr(md5(word), 1, 8) AS UBIGINT) AS h FROM w),
x AS (SELECT conv_id, turn, ordinal, weight, h % 32 AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM h GROUP BY ALL),
len AS (SELECT conv_id, turn, ordinal, weight, sum(x * x) AS sq FROM x GROUP BY ALL),
u AS (
  SELECT l.conv_id, l.turn, p.place, l.weight, CASE WHEN sq = 0 THEN 1 / sqrt(32) ELSE coalesce(x.x, 0) / sqrt(sq) END AS u
  FROM len l CROSS JOIN (SELECT unnest(range(32)) AS place) p
  LEFT JOIN x ON x.conv_id = l.conv_id AND x.turn = l.turn AND x.ordinal = l.ordinal AND x.place = p.place),
m AS (SELECT conv_id, turn, place, sum(u * weight) / sum(weight) AS m, count(*) AS inputs FROM u GROUP BY ALL),
c AS (SELECT conv_id, turn, any_value(inputs) AS inputs, sqrt(sum(m * m)) AS len, sum(m) FILTER (WHERE place = 0) AS first, sum(m) FILTER (WHERE place = 31) AS last FROM m GROUP BY ALL)
SELECT conv_id || '-' || turn AS query_id, 'ok' AS status, inputs, 1.0 AS length, round(CAST(CAST(first / len AS FLOAT) AS DOUBLE), 5) AS first,
       round(CAST(CAST(last / len AS FLOAT) AS DOUBLE), 5) AS last FROM c"""

STREAMED = f"""WITH {V}, {RULES}, {PAGES}, {MATCHED}
SELECT p.tenant_id, rule_id AS alert_rule_id, rule_embedding_id AS alert_embedding_id, round(similarity, 6) AS similarity, threshold
FROM matched m JOIN pg p ON m.revision_id = p.revision_id"""

ORACLES: dict[str, str] = {
    "reverse_match_topk": REVERSE,
    "reverse_match_blocks": REVERSE,
    "reverse_match_pruned": REVERSE,
    "reverse_match_joined": REVERSE,
    "similarity_search": search_page(1),
    "similarity_search_page2": search_page(2),
    "historical_match": HISTORICAL,
    "page_revision_chain": CHAIN,
    "page_current": CURRENT,
    "url_policy": URLS,
    "content_hash": f"SELECT doc_id, sha256({collapse('text')}) AS content_sha256 FROM documents",
    "query_keywords": KEYWORDS,
    "query_entities": ENTITIES,
    "query_inputs": INPUTS,
    "query_input_report": REPORT,
    "weighted_centroid": CENTROID,
    "source_scope": SCOPE,
    "rule_listing_by_principal": LISTING,
    "active_rule_counts": COUNTS,
    "active_rule_cap": CAP,
    "active_rule_cap_with_disable": CAP_LOG,
    "rule_embedding_upsert": UPSERT,
    "candidate_dedup": DEDUP,
    "candidate_counts": CANDIDATE_COUNTS,
    "match_keys": MATCH_KEY,
    "event_visibility": VISIBILITY,
    "immutability_audit": IMMUTABLE, "immutability_by_digest": IMMUTABLE,
    "integrity_audit": INTEGRITY,
    "input_audit": INPUT_AUDIT,
    "frontier_due": FRONTIER,
    "page_views": VIEWS,
    "embedding_sha256": f"WITH {VECTOR_SHA} SELECT vec_id, sha AS embedding_sha256 FROM bits",
    "query_vectors": QUERY_VECTORS,
    "vector_text": "SELECT vec_id, TRUE AS same, len(embedding) AS dimensions FROM embeddings",
    "principal_claims": CLAIMS,
    "streaming_reverse_match": STREAMED,
    "streaming_reverse_match_merged": STREAMED,
}
