"""Registered queries about what tables hold each other to, and what is told of matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import uuid_of
from ..operators import access, audit, views
from ..sources import derived
from . import alerting

SPACE = ["model", "model_version", "dimensions", "normalization"]


def stated_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Rows that state the hash of their revision: every seventh states another one, every eleventh is of another tenant."""
    p = derived.page_base(spark, d)
    stated = p.select(
        "vec_id", F.when(F.col("vec_id") % 11 == 0, uuid_of(1, F.lit(9))).otherwise(F.col("tenant_id")).alias("tenant_id"), "revision_id",
        F.when(F.col("vec_id") % 7 == 0, F.sha2("revision_id", 256)).otherwise(F.col("content_sha256")).alias("content_sha256"),
    )
    good, bad = audit.stating_hash(stated, derived.page_revisions(spark, d))
    show = lambda df, name: df.select("vec_id", F.lit(name).alias("outcome"))
    return show(good, "accepted").unionByName(show(bad, "refused"))


def match_events(spark: SparkSession, d: str) -> DataFrame:
    """What is told when pages are matched: each candidate to its owner and admins, each new revision and each page's end to admins."""
    found = alerting._matches(spark, d).select("tenant_id", "revision_id", "alert_rule_id")
    owners = derived.alert_rules(spark, d).select("tenant_id", "alert_rule_id", "owner_subject")
    pages = derived.page_base(spark, d).select("tenant_id", "revision_id")
    counts = found.groupBy("revision_id").agg(F.count("*").alias("candidates"))
    done = pages.join(counts, "revision_id", "left").select("tenant_id", "revision_id", F.coalesce("candidates", F.lit(0)).alias("candidates"))
    at = F.timestamp_seconds(F.lit(0))
    told = (
        access.envelope(found.join(owners, ["tenant_id", "alert_rule_id"]), "match.candidate", F.col("owner_subject"), at)
        .unionByName(access.envelope(pages, "page.revision_indexed", None, at)).unionByName(access.envelope(done, "page.reverse_match_completed", None, at))
    )
    field = lambda name: F.get_json_object("payload", f"$.data.{name}")
    return told.select(
        "event_type", "tenant_id", "audience", "owner_subject", field("revision_id").alias("revision_id"), field("alert_rule_id").alias("alert_rule_id"),
        field("candidates").cast("bigint").alias("candidates"),
    )


def provider_order(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as a provider gives them back, last ones first, put in the order of their index."""
    e = derived.table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("set_id"), (9 - F.col("vec_id") % 10).cast("int").alias("index"), "embedding"
    )
    return views.in_order(e).select("set_id", "position", "index", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


def input_vectors_stored(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of inputs, each sent twice, the second time reversed, some stored before and some without a length."""
    e = derived.table(spark, d, "embeddings")
    rows = e.select(
        F.col("vec_id").alias("seq"), uuid_of(1, F.col("vec_id") % 3).alias("tenant_id"), uuid_of(12, F.col("vec_id")).alias("input_id"), F.lit("m").alias("model"), F.lit("v1").alias("model_version"),
        F.lit("l2").alias("normalization"), F.size("embedding").alias("dimensions"),
        F.when(F.col("vec_id") % 13 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("embedding"), F.timestamp_seconds("vec_id").alias("generated_at"),
    )
    again = rows.withColumns({"seq": F.col("seq") + 1_000_000, "embedding": F.reverse("embedding")})
    stored = rows.where(F.col("seq") % 7 == 0).select("input_id", *SPACE)
    new = views.new_input_vectors(rows.unionByName(again), stored, "seq")
    return new.select("tenant_id", "input_id", *SPACE, F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stated_hashes, match_events, provider_order, input_vectors_stored)}
