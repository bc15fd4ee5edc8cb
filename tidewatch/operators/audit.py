"""Audits: field checks, references, uniqueness and what must not change between snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import NORMALIZATIONS, is_finite
from ..sources.schemas import KEYS, REFERENCES

SHA_RE = r"^[0-9a-f]{64}$"
STATUSES = ("pending", "suppressed", "approved", "rejected", "delivered", "failed")
MODES = ("historical_page_search", "reverse_alert_stream")
KINDS = (
    "query", "keyword", "entity", "title", "heading", "summary", "sentence", "url_signal", "document",
)
SUBJECTS = ("page_revision", "alert_rule_revision")
DISCOVERY = ("manual", "sitemap", "rss", "atom", "external_index_candidates", "link")
QUEUE_STATUSES = ("pending", "leased", "fetched", "unchanged", "blocked", "failed", "dead_letter")


def _chars(c: str, low: int, high: int) -> Column:
    return F.char_length(c).between(low, high)


def _size(c: str, low: int, high: int) -> Column:
    return F.size(c).between(low, high)


def _space() -> dict[str, Column]:
    return {
        "model": F.octet_length("model").between(1, 256), "model_version": F.octet_length("model_version").between(1, 256),
        "dimensions": F.col("dimensions").between(1, 32768),
    }


def checks(table: str) -> dict[str, Column]:
    """Conditions that a row of a table keeps, by name."""
    col = F.col
    if table == "sources":
        return {
            "name": F.octet_length("name").between(1, 256), "allowed_hosts": _size("allowed_hosts", 1, 64),
            "allowed_path_prefixes": _size("allowed_path_prefixes", 1, 128), "discovery_modes": F.size("discovery_modes") >= 1,
            "crawl_interval_seconds": col("crawl_interval_seconds").between(60, 604800), "max_depth": col("max_depth").between(0, 16),
            "max_pages_per_run": col("max_pages_per_run").between(1, 10000), "obey_robots": col("obey_robots"),
        }
    if table == "embedding_spaces":
        # A control character would be written differently by different JSON writers, and so change match keys.
        plain = {f"{c}_control": ~col(c).rlike(r"[\x00-\x1f]") for c in ("model", "model_version")}
        return {
            "provider": F.octet_length("provider").between(1, 128), **_space(), **plain,
            "normalization": col("normalization").isin(*[n for n in NORMALIZATIONS if n != "none"]),
        }
    if table == "semantic_input_sets":
        return {
            "subject_kind": col("subject_kind").isin(*SUBJECTS), "source_content_sha256": col("source_content_sha256").rlike(SHA_RE),
            "extractor_name": _chars("extractor_name", 1, 120), "extractor_version": _chars("extractor_version", 1, 120),
            "provenance": F.startswith(F.trim("provenance"), F.lit("{")) & F.from_json("provenance", "map<string,string>").isNotNull(),
        }
    if table == "crawl_queue":
        return {
            "discovered_by": col("discovered_by").isin(*DISCOVERY), "depth": col("depth").between(0, 16),
            "status": col("status").isin(*QUEUE_STATUSES), "attempt_count": col("attempt_count") >= 0,
        }
    if table == "semantic_inputs":
        return {
            "kind": col("kind").isin(*KINDS), "ordinal": col("ordinal").between(0, 95), "text": _chars("text", 1, 700),
            "text_sha256": col("text_sha256").rlike(SHA_RE),
            "weight": is_finite(col("weight")) & col("weight").between(F.lit(0.1).cast("float"), F.lit(2.0).cast("float")),
        }
    if table == "page_embeddings":
        return {
            **_space(), "normalization": col("normalization").isin(*NORMALIZATIONS),
            "embedding": (F.size("embedding") == col("dimensions")) & F.forall("embedding", is_finite),
        }
    if table == "alert_rule_embeddings":
        return {**checks("page_embeddings"), "embedding_sha256": col("embedding_sha256").rlike(SHA_RE)}
    if table == "match_candidates":
        evidence = (
            col("alert_embedding_id").isNotNull() & col("page_embedding_sha256").rlike(SHA_RE) & _chars("page_embedding_model", 1, 256)
            & _chars("page_embedding_model_version", 1, 256) & col("page_embedding_dimensions").between(1, 65535)
            & col("page_embedding_normalization").isin(*NORMALIZATIONS)
        )
        return {
            "match_mode": col("match_mode").isin(*MODES), "status": col("status").isin(*STATUSES),
            "similarity": ~F.isnan("similarity") & col("similarity").between(-1, 1), "threshold": col("threshold").between(0, 1),
            "canonical_match_key": col("canonical_match_key").rlike(SHA_RE),
            "shape": F.when(col("match_mode") == MODES[0], col("embedding_id").isNotNull()).otherwise(evidence),
        }
    raise KeyError(table)


def errors_of(table: str, cutover: Column | None = None) -> Column:
    """Names of the conditions that a row breaks; a null field breaks its condition.

    With ``cutover``, candidates without a rule revision are refused only if they
    were created after it; older ones stay as they are.
    """
    named = dict(checks(table))
    if table == "match_candidates" and cutover is not None:
        named["alert_rule_revision_id"] = F.col("alert_rule_revision_id").isNotNull() | (F.col("created_at") < cutover)
    flags = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in named.items()]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def split_rows(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected with ``errors``)."""
    checked = df.withColumn("errors", errors_of(table))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def duplicates(df: DataFrame, table: str, keys: list[str] | None = None) -> DataFrame:
    """(table, key, rows): keys that occur more than once."""
    keys = keys or KEYS[table]
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1").select(
        F.lit(table).alias("table"), F.to_json(F.array(*[F.col(k).cast("string") for k in keys])).alias("key"), "rows"
    )


def dangling(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], name: str) -> DataFrame:
    """(reference, key, rows): values that the parent lacks. Null values refer to nothing."""
    p = parent.select(*[F.col(b).alias(a) for a, b in zip(columns, parent_columns, strict=True)]).distinct()
    some = child.dropna(subset=columns).join(p, columns, "left_anti")
    return some.groupBy(*columns).agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("reference"), F.to_json(F.array(*[F.col(k).cast("string") for k in columns])).alias("key"), "rows"
    )


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """All dangling references and duplicate keys among the given tables: (kind, name, key, rows)."""
    found = [
        dangling(tables[c], cc, tables[p], pc, f"{c}.{cc[-1]}").select(F.lit("reference").alias("kind"), F.col("reference").alias("name"), "key", "rows")
        for c, cc, p, pc in REFERENCES
        if c in tables and p in tables
    ]
    found += [
        duplicates(df, t).select(F.lit("duplicate").alias("kind"), F.col("table").alias("name"), "key", "rows") for t, df in tables.items() if t in KEYS
    ]
    return reduce(DataFrame.unionByName, found)


#: Columns that may change; all others are frozen once written.
MUTABLE = {"alert_rule_revisions": [], "alert_rule_embeddings": [], "match_candidates": ["status", "updated_at"]}
IDS = {"alert_rule_revisions": "revision_id", "alert_rule_embeddings": "alert_embedding_id", "match_candidates": "candidate_id"}


def immutability(before: DataFrame, after: DataFrame, table: str, key: str | None = None, mutable: list[str] | None = None) -> DataFrame:
    """(id, change, columns): rows that a later snapshot lacks or shows with other frozen values."""
    key = key or IDS[table]
    mutable = MUTABLE[table] if mutable is None else mutable
    frozen = [c for c in before.columns if c != key and c not in mutable]
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"), "left")
    changed = F.filter(
        F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), c) for c in frozen]), lambda x: x.isNotNull()
    )
    gone = F.col(f"a.{key}").isNull()
    return both.select(
        F.col(f"b.{key}").alias("id"), F.when(gone, "deleted").otherwise("mutated").alias("change"),
        F.when(gone, F.array().cast("array<string>")).otherwise(changed).alias("columns"),
    ).where((F.col("change") == "deleted") | (F.size("columns") > 0))


def stating_hash(rows: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): rows whose revision is their tenant's and carries the content hash that they state."""
    key = ["tenant_id", "revision_id", "content_sha256"]
    known = revisions.select(*key)
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")
