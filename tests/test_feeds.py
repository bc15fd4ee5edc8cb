"""Keyed state and watermarks of streams, against the batch operators."""

import datetime

from pyspark.sql import functions as F

from tidewatch.operators import pages
from tidewatch.plans import feeds
from tidewatch.sources import derived, schemas
from tidewatch.streaming import page_state, requests


def test_keyed_state_equals_the_batch_chain(spark, sf, tmp_path):
    """Reverts, contents that come back in another batch, a null time, and a start anew after each batch."""
    arrived = pages.arrivals(derived.fetches(spark, sf)).where("seq < 60 OR seq BETWEEN 200 AND 230").select("page_id", F.col("seq").cast("long").alias("seq"), "revision_id", "content_sha256", "fetched_at")
    arrived = arrived.withColumn("fetched_at", F.when(F.col("seq") != 7, F.col("fetched_at")))
    rows = arrived.collect()
    for low, high in ((0, 20), (20, 45), (45, 1000)):
        spark.createDataFrame([r for r in rows if low <= r.seq < high], arrived.schema).write.mode("append").parquet(f"{tmp_path}/feed")
        stream = spark.readStream.schema(feeds.ARRIVED).parquet(f"{tmp_path}/feed")
        page_state.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out")
    columns = ["seq", "page_id", "revision_id", "content_sha256", "changed", "pointer_before"]
    want = pages.revision_chain(arrived).select(*columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    page = arrived.withColumns({"tenant_id": F.lit("T"), "source_id": F.lit("S"), "canonical_url": F.col("page_id")})
    now = pages.current_pages(page).select("page_id", "latest_revision_id", "first_seen_at", "last_seen_at")
    shown = page_state.current(found)
    assert sorted(map(tuple, shown.drop("arrivals").collect()), key=repr) == sorted(map(tuple, now.collect()), key=repr)
    assert shown.agg(F.sum("arrivals")).first()[0] == len(rows)
    # Nothing new: nothing is done again.
    page_state.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)


def test_late_requests_are_dropped_and_counted(spark, sf, tmp_path):
    late = 0
    before, after = feeds.sent_again(spark, sf)
    for part in (before, after):
        part.write.mode("append").json(f"{tmp_path}/feed")
        query = requests.start(schemas.stream_feed(spark, f"{tmp_path}/feed"), "10 minutes", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()
        late += requests.dropped_as_late(query)
    told = requests.told_apart(spark, schemas.read_feed(spark, f"{tmp_path}/feed"), f"{tmp_path}/out")
    counts = {r.outcome: r["count"] for r in told.groupBy("outcome").count().collect()}
    taken = spark.read.parquet(f"{tmp_path}/out")
    assert counts["taken"] == taken.count() == taken.select("request_id").distinct().count()
    # Requests sent again so late that they are forgotten are dropped as late too.
    assert counts["late"] <= late <= counts["late"] + counts["repeated"] and counts["late"] > 0


def test_identities(spark):
    t = datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC)
    rows = [("T", "S", "u", "f", "a  b", t), ("T", "S", "u", "f", "a b ", t), ("T", "S", "u", "f", "a c", t), ("T", "S", "u,", "f", "a b", t), ("T", "S", None, "f", "a b", t), ("T", "S", "u", "f", "a b", None), ("T", "S", "u", "f", None, t)]
    ids = [r[0] for r in spark.createDataFrame(rows, "tenant_id string, source_id string, url string, final_url string, content_text string, fetched_at timestamp").select(requests.request_id()).collect()]
    assert ids[0] == ids[1] and None not in ids and len(set(ids)) == 6
