"""The feed queries as plain SQL over the given tables, written apart from the DataFrame code."""

from __future__ import annotations

from .alerting_sql import ORACLES as ALERTING
from .alerting_sql import CHAIN, PAGES, V, derived

AGAIN = f"""WITH {V}, {PAGES}, m AS (SELECT max(vec_id) // 2 AS middle FROM pg)
SELECT vec_id AS seq, tenant_id, source_id, 'taken' AS outcome FROM pg
UNION ALL SELECT vec_id + 1000000, tenant_id, source_id, 'repeated' FROM pg, m WHERE vec_id <= middle AND vec_id % 3 = 0
UNION ALL SELECT vec_id + 2000000, tenant_id, source_id, 'late' FROM pg, m WHERE vec_id > middle AND vec_id % 5 = 0
UNION ALL SELECT vec_id + 3000000, tenant_id, source_id, 'repeated' FROM pg, m WHERE vec_id <= middle AND vec_id % 7 = 0"""

URLS = f"""WITH f AS (
  SELECT {derived("'source'", "regexp_extract(url, '^[^:]+://([^/?#]+)', 1)")} AS source_id, 'https://e.com/' || (page_id % 400) AS canonical_url, page_id AS n,
         page_id % 5 AS depth, page_id % 3 AS priority, page_id * 60 AS created FROM pages),
leased AS (SELECT DISTINCT source_id, canonical_url FROM f WHERE n % 3 = 0 AND canonical_url LIKE '%7'),
t AS (
  SELECT f.*, l.source_id IS NOT NULL AS leased, row_number() OVER (PARTITION BY f.source_id, f.canonical_url ORDER BY depth, priority, created) AS k
  FROM f LEFT JOIN leased l ON f.source_id = l.source_id AND f.canonical_url = l.canonical_url WHERE l.source_id IS NULL OR n % 3 = 0)
SELECT source_id, canonical_url, CASE WHEN leased THEN 'leased' ELSE 'pending' END AS status, CAST(depth AS INTEGER) AS depth, CAST(priority AS INTEGER) AS priority, created
FROM t WHERE k = 1"""

ORACLES = {
    "page_state_stream": CHAIN, "feed_deduplicated": AGAIN, "active_rule_cap_by_day": ALERTING["active_rule_cap_with_disable"], "frontier_upserts": URLS,
    "weighted_centroid_merged": ALERTING["weighted_centroid"],
}
