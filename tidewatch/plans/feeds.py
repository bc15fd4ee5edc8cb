"""Registered queries about feeds that go on from batch to batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activations, pages, pooling
from ..sources import derived, schemas
from ..sources.scratch import scratch_path
from ..streaming import frontier_store, page_state, requests
from . import alerting

ARRIVED = "page_id string, seq long, revision_id string, content_sha256 string, fetched_at timestamp"


def page_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The revision chain from keyed state: the fetches come in three parts, and the stream stops and starts again between them."""
    root = scratch_path(spark, "page-state")
    arrived = pages.arrivals(derived.fetches(spark, d)).select("page_id", F.col("seq").cast("long").alias("seq"), "revision_id", "content_sha256", "fetched_at")
    last = arrived.agg(F.max("seq")).first()[0] or 0
    for n in range(3):
        arrived.where((F.col("seq") * 3 >= n * (last + 1)) & (F.col("seq") * 3 < (n + 1) * (last + 1))).write.mode("append").parquet(f"{root}/feed")
        stream = spark.readStream.schema(ARRIVED).parquet(f"{root}/feed")
        page_state.start(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("seq", "page_id", "revision_id", "content_sha256", "changed", "pointer_before")


def sent_again(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(before, after): the page vectors' fetches in two halves; after the first one some of its requests come once more, and some new ones from long before."""
    fetches, _ = alerting._feed(spark, d)
    middle = fetches.agg(F.max("seq")).first()[0] // 2
    before, after = fetches.where(F.col("seq") <= middle), fetches.where(F.col("seq") > middle)
    again = before.where(F.col("seq") % 3 == 0).withColumn("seq", F.col("seq") + 1_000_000)
    late = after.where(F.col("seq") % 5 == 0).withColumns({"seq": F.col("seq") + 2_000_000, "content_text": F.concat("content_text", F.lit(" late")), "fetched_at": F.timestamp_seconds(F.lit(0))})
    return before.unionByName(before.where(F.col("seq") % 7 == 0).withColumn("seq", F.col("seq") + 3_000_000)), after.unionByName(again).unionByName(late)


def feed_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """Each request of a feed as taken, repeated or late; rows may be ten minutes late, and a minute lies between two fetches."""
    root = scratch_path(spark, "requests")
    for part in sent_again(spark, d):
        part.write.mode("append").json(f"{root}/feed")
        requests.start(schemas.stream_feed(spark, f"{root}/feed"), "10 minutes", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return requests.told_apart(spark, schemas.read_feed(spark, f"{root}/feed"), f"{root}/out").select("seq", "tenant_id", "source_id", "outcome")


def active_rule_cap_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The log of enables and disables folded in four parts, each on top of what the one before left; every part is sent twice."""
    log = derived.activations(spark, d)
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    width = (high - low) // 4 + 1 if low is not None else 1
    state, told = activations.no_state(spark), []
    for n in range(4):
        part = log.where((F.col("seq") - F.lit(low or 0)) / F.lit(width) >= n).where((F.col("seq") - F.lit(low or 0)) / F.lit(width) < n + 1)
        for _ in range(2):
            rows, state = activations.folded(part, state)
            told.append(rows)
    return reduce(DataFrame.unionByName, told)


def _found_urls(spark: SparkSession, d: str) -> DataFrame:
    return derived.crawl_queue(spark, d).withColumns({"status": F.lit("pending"), "n": F.unix_seconds("created_at") / 60}).withColumn(
        "canonical_url", F.concat(F.lit("https://e.com/"), (F.col("n") % 400).cast("int").cast("string"))
    )


def frontier_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Found URLs merged into the stored frontier in three batches; every tenth URL of the first one is leased."""
    root = scratch_path(spark, "frontier")
    found = _found_urls(spark, d)
    part = lambda n: found.where(F.col("n") % 3 == n).drop("n")
    frontier_store.upsert(spark, root, part(0).withColumn("status", F.when(F.col("canonical_url").endswith("7"), "leased").otherwise("pending")), 0)
    for n in (1, 2, 2):
        frontier_store.upsert(spark, root, part(n), n)
    return frontier_store.stored(spark, root).select("source_id", "canonical_url", "status", F.col("depth").cast("int").alias("depth"), "priority", F.unix_seconds("created_at").alias("created"))


def weighted_centroid_merged(spark: SparkSession, d: str) -> DataFrame:
    """``weighted_centroid`` by sums that are merged part by part."""
    e = derived.table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("set_id"), "embedding", (F.lit(0.5) + F.lit(0.125) * (F.col("vec_id") % 10)).alias("weight")
    )
    pooled = pooling.weighted_centroid(e, "set_id", "embedding", "weight")
    return pooled.select("set_id", "status", F.posexplode("centroid").alias("place", "value")).select(
        "set_id", "status", "place", F.round(F.col("value").cast("double"), 5).alias("value")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (page_state_stream, feed_deduplicated, active_rule_cap_by_day, frontier_upserts, weighted_centroid_merged)
}
