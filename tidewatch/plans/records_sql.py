"""The records queries as plain SQL over the given tables, written apart from the DataFrame code."""

from __future__ import annotations

from .alerting_sql import FETCHES, HITS, INPUT_ROWS, MATCHED, PAGES, RULES, VECTOR_SHA, V, derived, uid

SUBMITTED = f"""s AS (
  SELECT event_id AS n, {uid(1, 'user_id % 3')} AS tenant_id, 'user-' || user_id AS owner, CAST(event_id % 4 AS VARCHAR) AS ref,
         concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'name' END, CASE WHEN event_id % 17 = 0 THEN 'query_text' END,
                   CASE WHEN event_id % 12 = 11 THEN 'similarity_threshold' END, CASE WHEN event_id % 23 = 0 OR event_id % 29 = 0 THEN 'delivery_channels' END,
                   CASE WHEN event_id % 19 = 0 THEN 'invalid_rule_filter' END) AS errors
  FROM events WHERE event_type IN ('signup', 'purchase'))"""

REVISIONS = f"""WITH {SUBMITTED}, g AS (SELECT *, {derived("'rule'", 'tenant_id', 'owner', 'ref')} AS rule_id FROM s WHERE errors = ''),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n) AS k, count(*) OVER (PARTITION BY rule_id) AS last FROM g)
SELECT rule_id AS alert_rule_id, {derived("'rule_revision'", 'rule_id', 'k')} AS revision_id, k AS revision_number, 'rule ' || (n % 4) AS name,
       'watch topic ' || (n % 5) AS query_text, 'test-embedding-model' AS embedding_model, round(CAST(CAST((n % 12) / 10 AS FLOAT) AS DOUBLE), 6) AS threshold,
       CASE WHEN n % 7 = 0 THEN 'source:' || {uid(2, 'n % 10')} ELSE '' END AS filters, 'email,in_app' AS channels, TRUE AS enabled, k = last AS is_active
FROM r"""
REJECTED = f"WITH {SUBMITTED} SELECT n AS seq, tenant_id, errors FROM s WHERE errors <> ''"

SOURCES = f"""WITH p AS (SELECT page_id AS n, {uid(1, 'page_id % 2')} AS tenant_id, regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS host FROM pages),
c AS (
  SELECT *, CASE WHEN n % 11 = 0 THEN 'host_not_allowed' WHEN n % 9 = 0 THEN 'name' WHEN n % 7 = 0 THEN 'crawl_interval_seconds' WHEN n % 13 = 0 THEN 'obey_robots' END AS reason FROM p),
taken AS (SELECT DISTINCT {uid(1, '0')} AS tenant_id, host FROM p WHERE n % 40 = 0),
t AS (
  SELECT c.*, t.host IS NOT NULL AS taken, row_number() OVER (PARTITION BY c.tenant_id, c.host, c.n % 11 = 0, reason IS NULL ORDER BY n) AS turn
  FROM c LEFT JOIN taken t ON c.tenant_id = t.tenant_id AND c.host = t.host),
o AS (
  SELECT *, 'https://' || host || '/' AS root, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN NOT taken AND turn = 1 THEN 'created' ELSE 'conflict' END AS outcome FROM t)
SELECT n AS seq, CASE WHEN outcome <> 'rejected' THEN {derived("'source'", 'tenant_id', 'root')} END AS source_id,
       CASE WHEN n % 11 = 0 THEN 'https://' || host || ':443/#top' ELSE root END AS root_url, outcome, reason FROM o"""

REQUESTS = f"""WITH {V}, {PAGES}, f AS (
  SELECT vec_id AS n, CASE WHEN vec_id % 29 = 0 AND source_id <> {uid(2, '99')} THEN 'source_mismatch' WHEN label = 8 THEN 'unknown_source' WHEN label = 9 THEN 'source_disabled'
         WHEN vec_id % 31 = 0 THEN 'http_status' WHEN vec_id % 37 = 0 THEN 'max_candidates' WHEN vec_id % 41 = 0 THEN 'content_type' WHEN vec_id % 43 = 0 THEN 'fetched_at'
         WHEN vec_id % 47 = 0 THEN 'embedding_model' WHEN vec_id % 53 = 0 THEN 'embedding_version' WHEN vec_id % 59 = 0 THEN 'embedding_dimensions'
         WHEN vec_id % 61 = 0 THEN 'embedding_values' WHEN vec_id % 67 = 0 THEN 'host_not_allowed' END AS reject_reason FROM pg)
SELECT n AS seq, reject_reason FROM f WHERE reject_reason IS NOT NULL"""

CANDIDATES = """WITH c AS (
  SELECT vec_id AS n, CASE WHEN vec_id % 3 = 0 THEN 'reverse' WHEN vec_id % 50 = 0 THEN 'guess' ELSE 'historical' END AS mode FROM embeddings)
SELECT * FROM (
  SELECT n, concat_ws(',', CASE WHEN mode = 'guess' THEN 'match_mode' END, CASE WHEN n % 7 = 6 THEN 'status' END, CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN 'similarity' END,
         CASE WHEN n % 17 = 0 THEN 'threshold' END, CASE WHEN n % 19 = 0 THEN 'canonical_match_key' END,
         CASE WHEN mode = 'historical' AND n % 5 = 0 THEN 'shape' WHEN mode <> 'historical' AND (n % 4 = 0 OR n % 9 = 0 OR n % 15 = 0) THEN 'shape' END,
         CASE WHEN n % 2 = 0 AND n >= 100 THEN 'alert_rule_revision_id' END) AS errors FROM c) WHERE errors <> ''"""

PROVIDER = """WITH v AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS set_id, vec_id FROM embeddings),
e AS (
  SELECT set_id, 'missing' AS e FROM v WHERE vec_id % 90 = 4
  UNION SELECT set_id, 'repeated' FROM v WHERE vec_id % 130 = 6 AND vec_id % 90 <> 4
  UNION SELECT set_id, 'unasked' FROM v WHERE vec_id % 170 = 7 AND vec_id % 90 <> 4
  UNION SELECT set_id, 'other_model' FROM v WHERE vec_id % 70 = 3 AND vec_id % 90 <> 4
  UNION SELECT set_id, 'invalid_vector' FROM v WHERE vec_id % 110 = 5 AND vec_id % 90 <> 4)
SELECT set_id, string_agg(e, ',' ORDER BY e) AS errors FROM e GROUP BY set_id"""

FOUND = f"""found AS (
  SELECT r.rule_id, r.rule_revision_id, p.tenant_id, p.revision_id, p.vec_id, p.content_sha256, p.embedding_id, p.dims, greatest(0.27, r.threshold) AS threshold,
         list_cosine_similarity(p.emb, r.emb) AS similarity
  FROM rules r JOIN pg p ON p.tenant_id = r.tenant_id AND r.version = 'v1' AND r.enabled AND p.dims = r.dims
       AND (r.only_source IS NULL OR r.only_source = p.source_id)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY 1.0 - similarity, embedding_id) AS rank FROM found
  WHERE similarity >= CAST(CAST(threshold AS FLOAT) AS DOUBLE))"""
HISTORICAL = f"""WITH {V}, {RULES}, {PAGES}, {FOUND}
SELECT sha256(to_json([tenant_id, rule_id, rule_revision_id, revision_id, content_sha256, 'test-embedding-model', 'v1', CAST(dims AS VARCHAR), 'unit_length'])) AS canonical_match_key,
       rule_id AS alert_rule_id, embedding_id, 'historical_page_search' AS match_mode, 'pending' AS status, round(threshold, 6) AS threshold, round(similarity, 6) AS similarity,
       revision_id AS told_revision, 'https://pages.example.com/' || vec_id AS told_url, dims AS told_dimensions
FROM best WHERE rank <= 5"""

EXPLAINED = f"""WITH {V}, {RULES}, {PAGES}, {MATCHED}, {VECTOR_SHA}
SELECT match_key AS canonical_match_key, 'reverse_alert_stream' AS told_mode, round(similarity, 6) AS told_similarity, sha AS told_vector, 'false' AS told_persisted,
       'unit_length' AS told_normalization
FROM matched m JOIN bits b ON b.vec_id = m.page_vec"""

GATES = f"""WITH {V}, {RULES}
SELECT rule_id AS alert_rule_id,
       CASE WHEN NOT enabled THEN 'rule_disabled' WHEN q10 % 5 = 0 THEN 'model_mismatch' WHEN q10 % 8 = 0 THEN 'invalid_rule_filter'
            WHEN only_source IS NOT NULL AND q10 % 3 <> 0 AND {uid(2, 'label + q10 % 2')} <> only_source THEN 'outside_rule_scope' END AS refused
FROM rules"""

ENVELOPES = f"""SELECT {uid(1, 'user_id % 3')} AS tenant_id, CASE WHEN event_type = 'signup' THEN 'owner_or_admins' ELSE 'admins' END AS audience,
       CASE WHEN event_type = 'signup' THEN 'user-' || user_id END AS owner_subject, CASE WHEN event_type = 'signup' THEN 'alert_rule.created' ELSE 'source.created' END AS event_type,
       event_id AS occurred, CASE WHEN event_type = 'signup' THEN 'alert_rule.created' ELSE 'source.created' END AS told_type, {uid(1, 'user_id % 3')} AS told_tenant, event_id AS told_id
FROM events WHERE event_type IN ('signup', 'error')"""
FAN_OUT = """WITH users AS (SELECT DISTINCT user_id FROM events)
SELECT 'user-' || u.user_id AS subject, CASE WHEN event_type = 'signup' THEN 'alert_rule.created' ELSE 'source.created' END AS event_type, event_id
FROM events e JOIN users u ON e.user_id % 3 = u.user_id % 3
WHERE event_type IN ('signup', 'error') AND (u.user_id % 50 = 0 OR (u.user_id = e.user_id AND event_type = 'signup'))"""

INPUT_SETS = f"""WITH {INPUT_ROWS}, texts AS (
  SELECT c.conv_id, c.turn, {uid(1, 'c.conv_id % 3')} AS tenant_id, c.conv_id || '-' || c.turn AS subject, sha256(c.text) AS sha, n
  FROM conversations c JOIN (SELECT conv_id, turn, count(*) AS n FROM inputs GROUP BY ALL) i ON c.conv_id = i.conv_id AND c.turn = i.turn WHERE c.role = 'user')
SELECT {derived("'input_set'", 'tenant_id', "'alert_rule_revision'", 'subject', "'space-1'", "'query-views'", "'1'", 'sha')} AS input_set_id, tenant_id, subject AS subject_id,
       sha AS source_content_sha256, CAST(n AS INT) AS inputs, CAST(n AS INT) AS told_inputs FROM texts"""

NEWEST = f"""WITH {V}, {PAGES}, s AS (SELECT tenant_id, source_id, max(vec_id) AS seen FROM pg GROUP BY ALL),
a AS (
  SELECT tenant_id, 'page' AS kind, page_id AS id, vec_id AS seen FROM pg UNION ALL SELECT tenant_id, 'revision', revision_id, vec_id FROM pg
  UNION ALL SELECT tenant_id, 'source', source_id, seen FROM s)
SELECT * FROM (SELECT tenant_id, kind, row_number() OVER (PARTITION BY tenant_id, kind ORDER BY seen DESC, id) AS rank, id FROM a) WHERE rank <= 7"""

JSON = f"""WITH {V}, {RULES}
SELECT rule_revision_id AS revision_id, 'rule ' || q10 AS name, 'watch topic ' || q10 AS query_text, 1 AS revision_number, round(threshold, 6) AS threshold,
       coalesce('source:' || only_source, '') AS filters, enabled, vec_id * 60 AS created FROM rules"""

STORED = f"""WITH {V}, {PAGES}
SELECT {derived("'page_embedding'", 'tenant_id', 'revision_id', "'test-embedding-model'", "'v1'", 'dims', "'unit_length'")} AS embedding_id, revision_id,
       'test-embedding-model' AS model, 'v1' AS model_version, dims AS dimensions, 'unit_length' AS normalization, round(emb[1], 6) AS first_value
FROM pg WHERE vec_id % 7 <> 0"""

SYNTAX = f"""WITH f AS (SELECT vec_id, vec_id % 8 AS k, {uid(2, 'vec_id % 50')} AS u FROM embeddings),
e AS (SELECT *, CASE WHEN vec_id % 100 = 1 THEN 'too_many_rule_filters' WHEN k > 4 THEN 'invalid_rule_filter' END AS error FROM f)
SELECT vec_id, CASE WHEN error IS NULL THEN u END AS ids, CASE WHEN error IS NULL THEN 'source:' || u END AS normal, error FROM e"""

SPACES = """SELECT * FROM (
  SELECT vec_id AS n, concat_ws(',', CASE WHEN vec_id % 11 = 0 THEN 'provider' END, CASE WHEN vec_id % 13 = 0 THEN 'model' END, CASE WHEN vec_id % 19 = 0 THEN 'dimensions' END,
         CASE WHEN vec_id % 17 = 0 THEN 'model_version_control' END, CASE WHEN vec_id % 3 = 2 THEN 'normalization' END) AS errors FROM embeddings) WHERE errors <> ''"""

REVISION_ROWS = f"""WITH {FETCHES}, firsts AS (SELECT page_id, revision_id, min(seq) AS seq FROM arr GROUP BY ALL)
SELECT f.page_id, f.revision_id, CASE WHEN f.seq % 2 = 1 THEN 't' || f.seq END AS title, sha256(left(t.text, 600)) AS excerpt_sha256,
       CAST(length(left(t.text, 600)) AS INT) AS excerpt_chars FROM firsts f JOIN twice t ON f.seq = t.seq"""

AS_OF = f"""WITH {V}, {RULES}, {PAGES}, w AS (
  SELECT tenant_id, q10 % 3 AS topic, rule_revision_id, vec_id AS low, lead(vec_id) OVER (PARTITION BY tenant_id, q10 % 3 ORDER BY vec_id) AS high FROM rules)
SELECT revision_id, topic, w.rule_revision_id FROM pg JOIN w ON pg.tenant_id = w.tenant_id AND w.low <= vec_id AND (high IS NULL OR vec_id < high)"""

MULTI_VIEW = f"""WITH {V}, {RULES}, {PAGES}, {HITS}, weighted AS (
  SELECT 'q' || (r.q10 % 4) AS query_id, embedding_id, similarity, 0.5 + 0.25 * (r.q10 % 3) AS w FROM hits h JOIN rules r ON r.rule_embedding_id = h.query_id)
SELECT query_id, embedding_id, round(sum(similarity * w) / sum(w), 6) AS mean_score, round(max(similarity), 6) AS best_score FROM weighted GROUP BY ALL"""

SINGLE = f"""WITH {V}, {RULES}, {PAGES}, {HITS}
SELECT h.embedding_id, h.source_id, 'content ' || vec_id AS excerpt, round(similarity, 6) AS similarity, make_timestamp(vec_id * 60000000) AS fetched_at
FROM hits h JOIN pg p ON p.embedding_id = h.embedding_id WHERE query_id = {uid(5, '10')} AND h.source_id IN ({uid(2, '1')}, {uid(2, '2')})
ORDER BY 1.0 - similarity, h.embedding_id LIMIT 6"""

FEED = f"""WITH {V}, {PAGES}
SELECT vec_id AS seq, source_id, 'https://pages.example.com/' || vec_id AS final_url, CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 10 END AS max_candidates, dims AS dimensions,
       vec_id * 60 AS fetched FROM pg"""

TABLES = f"""WITH {V}, {PAGES}
SELECT 'pages' AS name, page_id AS id FROM pg WHERE vec_id % 3 = 1 UNION ALL SELECT 'page_embeddings', embedding_id FROM pg WHERE vec_id % 3 = 1"""

ORACLES: dict[str, str] = {
    "rule_revisions_created": REVISIONS, "rule_submissions_rejected": REJECTED, "source_creation": SOURCES, "page_requests_rejected": REQUESTS,
    "candidate_audit": CANDIDATES, "provider_output": PROVIDER, "historical_candidates": HISTORICAL, "score_explanations": EXPLAINED, "evaluation_gates": GATES,
    "event_envelopes": ENVELOPES, "event_fan_out": FAN_OUT, "query_input_sets": INPUT_SETS, "newest_listings": NEWEST, "json_rows": JSON,
    "page_vectors_stored": STORED, "filter_syntax": SYNTAX, "space_audit": SPACES, "revision_rows": REVISION_ROWS, "rules_as_of": AS_OF,
    "multi_view_search": MULTI_VIEW, "single_search": SINGLE, "feed_read": FEED, "tables_written": TABLES,
}
