"""Page revisions: change detection over a feed of fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import derived_uuid
from ..functions.text import content_sha256
from ..functions.urls import with_canonical_url

PAGE = ["tenant_id", "source_id", "canonical_url"]


def fetch_errors() -> Column:
    """Reasons, in order, why a fetch is refused; an empty array if it is not."""
    e = F.col("embedding")
    checks = {
        "http_status": ~F.col("http_status").between(200, 399),
        "max_candidates": ~F.col("max_candidates").between(1, 500),
        "content_type": F.coalesce(F.col("content_type"), F.lit("")) == "",
        "fetched_at": F.col("fetched_at").isNull(),
        "embedding_model": ~F.char_length(e["model"]).between(1, 256),
        "embedding_version": ~F.char_length(e["model_version"]).between(1, 256),
        "embedding_dimensions": (F.size(e["values"]) != e["dimensions"]) | ~e["dimensions"].between(1, 65535),
        "embedding_values": ~F.forall(e["values"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
    }
    flags = F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items()])
    return F.filter(flags, lambda x: x.isNotNull())


def classified(fetches: DataFrame, sources: DataFrame) -> DataFrame:
    """Fetches with canonical URLs and ``reject_reason``, which is null for good ones.

    A fetch is refused if its source is unknown in its tenant or disabled, if
    either of its URLs is outside the source's policy, or if a field is. Where the
    feed has route_source_id, the source that the request was sent for, it is
    refused first of all if it names another one itself.
    """
    s = sources.select(
        "tenant_id", "source_id", "allowed_hosts", "include_subdomains", "allowed_path_prefixes", F.col("enabled").alias("source_enabled")
    )
    joined = fetches.join(s, ["tenant_id", "source_id"], "left")
    policy = (F.col("allowed_hosts"), F.col("include_subdomains"), F.col("allowed_path_prefixes"))
    joined = with_canonical_url(joined, "first", F.col("url"), *policy)
    joined = with_canonical_url(joined, "last", F.col("final_url"), *policy)
    routed = F.col("route_source_id").eqNullSafe(F.col("source_id")) if "route_source_id" in fetches.columns else F.lit(True)
    reason = (
        F.when(~routed, "source_mismatch").when(F.col("source_enabled").isNull(), "unknown_source").when(~F.col("source_enabled"), "source_disabled")
        .otherwise(F.coalesce(F.get(fetch_errors(), F.lit(0)), F.col("first.reject_reason"), F.col("last.reject_reason")))
    )
    return joined.select(
        *fetches.columns, F.col("first.canonical").alias("original_canonical_url"), F.col("last.canonical").alias("canonical_url"),
        reason.alias("reject_reason"),
    )


def admitted(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of classified fetches. Keep those at hand: a filter on an open plan repeats its steps."""
    return judged.where("reject_reason IS NULL").drop("reject_reason"), judged.where("reject_reason IS NOT NULL")


def arrivals(fetches: DataFrame) -> DataFrame:
    """Fetches with page_id, content_sha256 and revision_id, which follow from keys alone."""
    hashed = fetches.withColumn("content_sha256", content_sha256(F.col("content_text")))
    hashed = hashed.withColumn("page_id", derived_uuid(F.lit("page"), *[F.col(c) for c in PAGE]))
    return hashed.withColumn("revision_id", derived_uuid(F.lit("revision"), F.col("tenant_id"), F.col("page_id"), F.col("content_sha256")))


def revision_chain(arrived: DataFrame, order: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """Arrivals with ``changed`` and ``pointer_before``, as if taken in one by one.

    A content that the page has had before makes no new revision and is not a
    change, but the page's pointer moves back to it. ``pointer_before`` is the
    pointer just before the arrival. ``known`` has (revision_id, latest_of_page:
    page_id) of stored revisions, so that a batch goes on where the last ended.
    ``order`` is the order of arrival; pass fetched_at for event time.
    """
    page = Window.partitionBy("page_id").orderBy(order)
    first = Window.partitionBy("page_id", "content_sha256").orderBy(order)
    out = arrived.withColumn("pointer_before", F.lag("revision_id").over(page)).withColumn(
        "changed", F.row_number().over(first) == 1
    )
    if known is None:
        return out
    seen = known.select("revision_id").distinct().withColumn("stored", F.lit(True))
    latest = known.where("is_latest").select("page_id", F.col("revision_id").alias("stored_pointer"))
    out = out.join(seen, "revision_id", "left").join(latest, "page_id", "left")
    return out.withColumn("changed", F.col("changed") & F.col("stored").isNull()).withColumn(
        "pointer_before", F.coalesce("pointer_before", "stored_pointer")
    ).drop("stored", "stored_pointer")


def new_revisions(chain: DataFrame) -> DataFrame:
    """Rows for page_revisions: the first arrival of a content sets all its fields."""
    return chain.where("changed").select(
        "revision_id", "tenant_id", "page_id", F.col("pointer_before").alias("predecessor_revision_id"),
        F.col("original_canonical_url").alias("original_url"), F.col("canonical_url").alias("final_url"),
        F.nullif(F.col("title"), F.lit("")).alias("title"), "content_text", "content_sha256", "content_type", "http_status",
        "published_at", "fetched_at",
    )


def current_pages(arrived: DataFrame, order: str = "seq", stored: DataFrame | None = None) -> DataFrame:
    """Rows for pages: first seen at the first arrival, last seen and pointer from the last in order.

    A late arrival of an older fetch still sets last_seen_at, as arrival order rules.
    """
    fresh = arrived.groupBy("page_id", *PAGE).agg(
        F.max_by("revision_id", order).alias("latest_revision_id"), F.min_by("fetched_at", order).alias("first_seen_at"),
        F.max_by("fetched_at", order).alias("last_seen_at"),
    )
    fresh = fresh.select("page_id", *PAGE, "latest_revision_id", "first_seen_at", "last_seen_at")
    if stored is None:
        return fresh
    n, o = fresh.alias("n"), stored.alias("o")
    return n.join(o, F.col("n.page_id") == F.col("o.page_id"), "full").select(
        *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in ("page_id", *PAGE, "latest_revision_id")],
        F.coalesce("o.first_seen_at", "n.first_seen_at").alias("first_seen_at"),
        F.coalesce("n.last_seen_at", "o.last_seen_at").alias("last_seen_at"),
    )


SPACE = ["model", "model_version", "dimensions", "normalization"]


def new_page_embeddings(arrived: DataFrame, stored: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Rows for page_embeddings: the first vector of a revision in a model space stays."""
    e = arrived.select("tenant_id", "revision_id", "fetched_at", order, "embedding.*").withColumnRenamed("values", "embedding")
    key = ["tenant_id", "revision_id", *SPACE]
    first = Window.partitionBy(*key).orderBy(order)
    rows = e.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    rows = rows if stored is None else rows.join(stored.select(*key), key, "left_anti")
    return rows.select(
        derived_uuid(F.lit("page_embedding"), *[F.col(c) for c in key]).alias("embedding_id"), "tenant_id", "revision_id",
        "model", "model_version", "normalization", "dimensions", "embedding", F.col("fetched_at").alias("generated_at"),
    )
