"""The crawl frontier: one row a URL, what is due, and newest-first listings of a bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import LISTING, newest

KEY = ["tenant_id", "source_id", "canonical_url"]
DUE = ("pending", "failed")


def merged(rows: DataFrame) -> DataFrame:
    """One row a canonical URL: the least depth, then the least priority number, then the oldest."""
    order = Window.partitionBy(*KEY).orderBy("depth", "priority", "created_at", "discovered_by")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def due(queue: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Rows to fetch now, with ``turn``: by due time, priority and age, at most a source's pages for one run.

    Only enabled sources run, and nothing deeper than they allow.
    """
    s = sources.where("enabled").select("tenant_id", "source_id", "max_pages_per_run", "max_depth")
    ready = queue.where(F.col("status").isin(*DUE) & (F.coalesce("next_attempt_at", F.col("created_at")) <= now)).join(s, ["tenant_id", "source_id"])
    ready = ready.where(F.col("depth") <= F.col("max_depth"))
    order = Window.partitionBy("tenant_id", "source_id").orderBy("next_attempt_at", "priority", "created_at", "canonical_url")
    return ready.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= F.col("max_pages_per_run"))


def newest_pages(pages: DataFrame, limit: int = LISTING) -> DataFrame:
    return newest(pages, ["tenant_id"], "last_seen_at", "page_id", limit)


def newest_revisions(revisions: DataFrame, limit: int = LISTING) -> DataFrame:
    return newest(revisions, ["tenant_id"], "fetched_at", "revision_id", limit)


def newest_candidates(candidates: DataFrame, limit: int = LISTING) -> DataFrame:
    return newest(candidates, ["tenant_id"], "created_at", "candidate_id", limit)
