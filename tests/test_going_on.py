"""What goes on from stored state or is merged from parts, against doing all at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import vectors
from tidewatch.operators import activations, frontier, pooling, rules
from tidewatch.plans import feeds
from tidewatch.streaming import frontier_store

LOG = "tenant_id string, owner_subject string, alert_rule_id string, seq bigint, enable boolean"


def test_day_by_day_equals_all_at_once(spark):
    rng = random.Random(6)
    rows = [("T", f"u{rng.randrange(4)}", f"r{rng.randrange(9)}", i, rng.random() < 0.7) for i in range(300)] + [(None, None, "r", 5, True), ("T", None, "r", 250, True)]
    log = spark.createDataFrame(rows, LOG)
    want = sorted(map(tuple, rules.admit_activation_log(log, 3).collect()), key=repr)
    state, got = activations.no_state(spark), []
    for low, high in ((0, 90), (90, 91), (91, 91), (91, 240), (240, 400)):
        part = log.where((F.col("seq") >= low) & (F.col("seq") < high))
        for again in range(2):
            told, state = activations.folded(part, state, 3)
            rows_told = list(map(tuple, told.collect()))
            assert not (again and rows_told)
            got += rows_told
    assert sorted(got, key=repr) == want and {r[-1] for r in want} == {True, False}
    kept = state.collect()
    assert len(kept) == len({r[:2] for r in rows}) and all(len(r.active) <= 3 for r in kept)


def test_frontier_batches_equal_one_and_leases_stay(spark, sf, tmp_path):
    found = feeds._found_urls(spark, sf)
    want = {(r.source_id, r.canonical_url): (r.depth, r.priority, r.created_at) for r in frontier.merged(found).collect()}
    for n in range(3):
        frontier_store.upsert(spark, f"{tmp_path}/a", found.where(F.col("n") % 3 == n).drop("n"), n)
    got = frontier_store.stored(spark, f"{tmp_path}/a").collect()
    assert {(r.source_id, r.canonical_url): (r.depth, r.priority, r.created_at) for r in got} == want and len(got) == len(want)
    # One new URL rewrites one bucket; a batch sent again none; a row on lease stays as it is.
    one = found.limit(1).drop("n").withColumns({"canonical_url": F.lit("https://e.com/new"), "status": F.lit("leased"), "depth": F.lit(3).cast("smallint")})
    before = frontier_store.folder_of_bucket(spark, f"{tmp_path}/a")
    hit = frontier_store.upsert(spark, f"{tmp_path}/a", one, 3)
    after = frontier_store.folder_of_bucket(spark, f"{tmp_path}/a")
    assert len(hit) == 1 and {b for b in after if after[b] != before.get(b)} == set(hit)
    assert frontier_store.upsert(spark, f"{tmp_path}/a", one, 3) == []
    frontier_store.upsert(spark, f"{tmp_path}/a", one.withColumns({"status": F.lit("pending"), "depth": F.lit(0).cast("smallint")}), 4)
    row = frontier_store.stored(spark, f"{tmp_path}/a").where("canonical_url = 'https://e.com/new'").collect()
    assert [(r.status, r.depth) for r in row] == [("leased", 3)]
    assert frontier_store.stored(spark, f"{tmp_path}/none").count() == 0


def test_pooled_vectors_have_the_same_bits_in_any_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 7, i, [float(x) for x in rng.normal(size=5)], float(rng.uniform(0.1, 2.0))) for i in range(200)]
    frame = spark.createDataFrame(rows, "k int, o int, v array<float>, w double")
    bits = [sorted((r.k, r.status, tuple(r.centroid)) for r in pooling.weighted_centroid(f, "k", "v", "w").collect()) for f in (frame, frame.repartition(9), frame.orderBy(F.rand(1)).coalesce(1))]
    assert bits[0] == bits[1] == bits[2] and len(bits[0]) == 7
    for r in vectors.weighted_centroid(frame, "k", "o", "v", "w").collect():
        assert np.allclose(r.centroid, dict((k, c) for k, _, c in bits[0])[r.k], atol=1e-6)


@pytest.mark.parametrize(
    ("rows", "status"),
    [
        ([([1.0, 0.0], 1.0), ([0.0, 0.0], 1.0)], "zero_vector"), ([([1.0, 0.0], 1.0), (None, 1.0)], "zero_vector"), ([([1.0], 1.0), ([1.0, 0.0], 1.0)], "dimension_mismatch"),
        ([([1.0, 0.0], None)], "dimension_mismatch"), ([([1.0, 0.0], 0.0)], "zero_weight"), ([([1.0, 0.0], 1.0), ([-1.0, 0.0], 1.0)], "zero_centroid"), ([([3.0, 4.0], 2.0)], "ok"),
    ],
)
def test_pooled_statuses(spark, rows, status):
    frame = spark.createDataFrame([("k", v, w) for v, w in rows], "k string, v array<float>, w double")
    for parts in (1, 3):
        (r,) = pooling.weighted_centroid(frame.repartition(parts), "k", "v", "w").collect()
        assert r.status == status and (r.centroid is None) == (status != "ok")
    assert pooling.weighted_centroid(frame.limit(0), "k", "v", "w").count() == 0


def test_limbs():
    x = np.array([1.5, -1.5, 0.0, -(2.0**-40), 3.1415926535, -1023.9])
    high, low = pooling.limbs(x)
    assert (low >= 0).all() and np.allclose(pooling.joined(high, low), x, rtol=0, atol=2.0**-53)
    assert np.allclose(pooling.joined(high * 1000, low * 1000), x * 1000, rtol=0, atol=1e-9)
