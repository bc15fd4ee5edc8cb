"""A page feed without the requests that are sent again.

A request is known by what it says: tenant, source, URLs, content and time. Within
the time that a watermark lets rows be late each identity is taken once, whatever
batch it comes in, and is forgotten after it, so state is bounded by that time. Rows that come later still
are dropped and counted by the stream; they are told apart afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_sha256

IDENTITY = ["tenant_id", "source_id", "url", "final_url"]


def request_id() -> Column:
    """The hash of a request's identity; JSON keeps fields apart and nulls as nulls."""
    said = [*IDENTITY, content_sha256(F.col("content_text")).alias("content"), F.unix_micros("fetched_at").alias("at")]
    return F.sha2(F.to_json(F.struct(*said)), 256)


def once(feed: DataFrame, delay: str) -> DataFrame:
    """A stream of fetches with request_id, each request once; ``delay`` is how late a row may be by fetched_at."""
    return feed.withColumn("request_id", request_id()).withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["request_id"])


def start(feed: DataFrame, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append the requests of a stream, each once, to files at ``path`` and stop when all that is there has come."""
    return once(feed, delay).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_as_late(query: StreamingQuery) -> int:
    """Rows that a stream's last run has dropped because they came after the watermark."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def told_apart(spark: SparkSession, feed: DataFrame, taken: str) -> DataFrame:
    """All rows of a feed with request_id and ``outcome``: taken, for the first row of a request that was taken, repeated for its others, late for the rest.

    The first row is the one of least seq; the stream may have taken another one that says the same.
    """
    rows = feed.withColumn("request_id", request_id())
    known = spark.read.parquet(taken).select("request_id").distinct().withColumn("known", F.lit(True))
    first = rows.groupBy("request_id").agg(F.min("seq").alias("first"))
    told = rows.join(first, "request_id").join(known, "request_id", "left")
    return told.withColumn("outcome", F.when(F.col("known").isNull(), "late").when(F.col("seq") == F.col("first"), "taken").otherwise("repeated")).drop("known", "first")
