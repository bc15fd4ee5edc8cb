"""The contract queries as plain SQL over the given tables, written apart from the DataFrame code."""

from __future__ import annotations

from .alerting_sql import MATCHED, PAGES, RULES, V, uid

STATED = "SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN 'refused' ELSE 'accepted' END AS outcome FROM embeddings WHERE vec_id % 10 <> 0"
EVENTS = f"""WITH {V}, {RULES}, {PAGES}, {MATCHED}
SELECT 'match.candidate' AS event_type, p.tenant_id, 'owner_or_admins' AS audience, r.owner AS owner_subject, m.revision_id, m.rule_id AS alert_rule_id, CAST(NULL AS BIGINT) AS candidates
FROM matched m JOIN pg p ON m.revision_id = p.revision_id JOIN rules r ON m.rule_id = r.rule_id
UNION ALL SELECT 'page.revision_indexed', tenant_id, 'admins', NULL, revision_id, NULL, NULL FROM pg
UNION ALL SELECT 'page.reverse_match_completed', p.tenant_id, 'admins', NULL, p.revision_id, NULL, count(m.revision_id)
FROM pg p LEFT JOIN matched m ON m.revision_id = p.revision_id GROUP BY p.tenant_id, p.revision_id"""
ORDER = """SELECT CAST(floor(vec_id / 10) AS BIGINT) AS set_id, CAST(row_number() OVER (PARTITION BY floor(vec_id / 10) ORDER BY vec_id DESC) - 1 AS INTEGER) AS position,
       CAST(9 - vec_id % 10 AS INTEGER) AS "index", round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM embeddings"""
INPUTS = f"""SELECT {uid(1, 'vec_id % 3')} AS tenant_id, {uid(12, 'vec_id')} AS input_id, 'm' AS model, 'v1' AS model_version, CAST(len(embedding) AS INTEGER) AS dimensions, 'l2' AS normalization,
       round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 13 <> 0"""

ORACLES = {"stated_hashes": STATED, "match_events": EVENTS, "provider_order": ORDER, "input_vectors_stored": INPUTS}
