"""Markers of batches: all or nothing, once, merged and cleared away."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import intervals
from tidewatch.plans import alerting
from tidewatch.sources.commits import Folder, Ledger
from tidewatch.streaming import reverse


def test_a_batch_is_published_once(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/sink")
    assert ledger.folders() == [] and not ledger.has(0)
    first, second = ledger.draft(3), ledger.draft(3)
    assert first.name != second.name
    assert ledger.publish(first) and not ledger.publish(second)
    assert ledger.folders() == [first] and ledger.has(3) and not ledger.has(2)
    other = Ledger(spark, f"{tmp_path}/sink")
    assert other.publish(other.draft(4)) and [f.last for f in ledger.folders()] == [3, 4]
    whole = Folder(3, 4, "folder=merged-4-x")
    assert ledger.publish(whole, "merged") and not other.publish(Folder(3, 4, "folder=merged-4-y"), "merged")
    assert ledger.folders() == [Folder(0, 4, "folder=merged-4-x")] and ledger.has(1) and ledger.has(4) and not ledger.has(5)
    last = ledger.draft(5)
    assert ledger.publish(last) and ledger.folders()[1:] == [last]
    assert not [p.name for p in (tmp_path / "sink" / "_commits").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_merged_folders_hold_the_same_rows(spark, sf, tmp_path):
    root = f"{tmp_path}/sink"
    fetches, sources = alerting._feed(spark, sf)
    rules = alerting._rule_vectors(spark, sf)
    part = lambda n: fetches.where((F.col("seq") < 90) & (F.col("seq") % 3 == n))
    show = lambda: {t: sorted(map(repr, reverse.stored(spark, root, t).collect())) for t in reverse.TABLES}
    for n in range(2):
        reverse.ingest(spark, part(n), root, sources, rules, n)
    before, listed = show(), reverse.stored(spark, root, "page_revisions")
    assert reverse.merge(spark, root) and show() == before and not reverse.merge(spark, root)
    # A reader that has listed the small folders ends undisturbed, and a batch sent again changes nothing.
    assert sorted(map(repr, listed.collect())) == before["page_revisions"]
    reverse.ingest(spark, part(0), root, sources, rules, 0)
    assert show() == before
    ledger = Ledger(spark, root)
    written = [*reverse.TABLES, *(f"{t}_filters" for t in reverse.FILTERED)]
    assert ledger.vacuum(written, 3600) == [] and len(list((tmp_path / "sink" / "page_revisions").iterdir())) == 3
    assert sum(1 for x in ledger.vacuum(written, -5) if not x.startswith("_commits")) == 2 * len(written)
    assert show() == before and [p.name for p in (tmp_path / "sink" / "page_revisions").iterdir() if not p.name.startswith(".")] == [ledger.folders()[0].name]
    reverse.ingest(spark, part(2), root, sources, rules, 2)
    assert len(show()["page_revisions"]) == fetches.where("seq < 90").count() and len(ledger.folders()) == 2
    # Batches before a number, though a merged folder has later ones too.
    assert reverse.merge(spark, root)
    assert sorted(map(repr, reverse.stored(spark, root, "page_revisions", before=2).collect())) == before["page_revisions"]
    assert reverse.stored(spark, root, "page_revisions", before=0).count() == 0


def at(seconds):
    return None if seconds is None else datetime.datetime.fromtimestamp(seconds, datetime.UTC)


@pytest.mark.parametrize("buckets", [1, 32])
def test_points_meet_the_intervals_that_hold_them(spark, buckets):
    rng = random.Random(buckets)
    points = [(rng.choice("ab"), i, rng.choice([None, rng.randrange(1000), 500])) for i in range(200)]
    spans = []
    for i in range(80):
        low = rng.choice([None, rng.randrange(-500, 1200), 500])
        spans.append((rng.choice("abc"), i, low, rng.choice([None, (low or 0) + rng.choice([0, 1, 7, 300, 5000])])))
    p = spark.createDataFrame([(k, i, at(t)) for k, i, t in points], "k string, p int, t timestamp")
    s = spark.createDataFrame([(k, i, at(a), at(b)) for k, i, a, b in spans], "k string, s int, a timestamp, b timestamp")
    found = intervals.held_by(p, s, ["k"], "t", "a", "b", buckets)
    want = sorted((i, j) for k, i, t in points for m, j, a, b in spans if k == m and t is not None and a is not None and a <= t and (b is None or t < b))
    assert sorted((r.p, r.s) for r in found.collect()) == want and want
    assert intervals.held_by(p.limit(0), s, ["k"], "t", "a", "b").count() == intervals.held_by(p, s.limit(0), ["k"], "t", "a", "b").count() == 0


def test_rows_meet_in_their_bucket_only(spark):
    """One key, many short intervals and a long one: what meets is in proportion to rows, and the join has the bucket among its keys."""
    p = spark.range(2000).select(F.lit("k").alias("k"), F.col("id").alias("p"), F.timestamp_seconds("id").alias("t"))
    s = spark.range(400).select(F.lit("k").alias("k"), F.col("id").alias("s"), F.timestamp_seconds(F.col("id") * 5).alias("a"), F.timestamp_seconds(F.col("id") * 5 + 5).alias("b"))
    s = s.unionByName(spark.range(1).select(F.lit("k").alias("k"), (F.col("id") - 1).alias("s"), F.timestamp_seconds(F.lit(-(10**9))).alias("a"), F.lit(None).cast("timestamp").alias("b")))
    found = intervals.held_by(p, s, ["k"], "t", "a", "b")
    assert found.count() == 4000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("bucket" in line for line in joins)
    first, last, width = intervals.bucket_seconds(p, s, "t", "a", "b")
    cut = sum(int(min((5 * i + 5), last) // width) - int(5 * i // width) + 1 for i in range(400)) + int(last // width) + 1
    assert (first, last) == (0.0, 1999.0) and cut <= 401 * (intervals.BUCKETS + 2)
