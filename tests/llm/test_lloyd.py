"""Rounds by columns against plain rounds over whole vectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import lloyd

SCHEMA = "vec_id long, embedding array<double>, cluster string, label int"


def plain(rows, dims, clusters, rounds):
    """(vec_id, cluster, distance) sorted, and the centroids, in Python's whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def near():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        to = near()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, n) in zip(kept, to, strict=True) if n == k]
            if own:
                centroids[k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return sorted(((i, k, d) for (i, _), (d, k) in zip(kept, near(), strict=True)), key=repr), centroids


def got(frame, **more):
    rows, centroids = lloyd.clustered(frame, **more)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in rows.collect()), key=repr), centroids.tolist()


@pytest.mark.parametrize(("dims", "block", "group_rows"), [(5, 2, 7), (5, 5, 1000), (5, 1, 1)])
def test_any_split_equals_plain_rounds(spark, dims, block, group_rows):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 2.0]) + rng.randrange(-3, 4) / 1024 for _ in range(dims)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (90, None), (91, [0.0] * (dims - 1)), (92, [0.0, None, 1.0, 1.0, 1.0]), (93, [math.nan] * dims), (94, [math.inf] + [0.0] * (dims - 1)), (95, [])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    want = plain(rows, dims, 4, 5)
    assert got(frame, clusters=4, rounds=5, dimensions=dims, block=block, group_rows=group_rows) == want
    assert len(want[0]) == 63


def test_ties_and_empty_clusters(spark):
    """All rows alike: the smallest number takes all, the other centroids stay."""
    frame = spark.createDataFrame([(i, [1.0, -1.0], "x", 1) for i in range(20)], SCHEMA)
    rows, centroids = got(frame, clusters=3, rounds=2, dimensions=2, block=1)
    assert [(k, d) for _, k, d in rows] == [(0, 0)] * 20 and centroids == [[1024, -1024]] * 3


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(1, [0.5, 0.5], "x", 1), (2, [-0.5, 0.0001], "x", 1)], SCHEMA)
    rows, centroids = got(frame, dimensions=2)
    assert len(centroids) == 2 and sorted(d for _, _, d in rows) == [0, 0] and [-512, 0] in centroids
    assert got(frame.limit(0), dimensions=2) == ([], [])
    assert got(frame, dimensions=3) == ([], [])
    with pytest.raises(Exception, match="in size"):
        lloyd.clustered(frame.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9)), dimensions=2)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [131071.0 * s, -131071.5 * s, 0.5]) for i, s in enumerate((1, -1, 1, -1, 0.25))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(frame, clusters=2, rounds=3, dimensions=3, block=2) == plain(rows, 3, 2, 3)


def test_floor_quotient(spark):
    pairs = [(a, b) for a in (-9, -8, -1, 0, 1, 8, 9, -(10**30), 10**30 + 1) for b in (1, 2, 3)]
    frame = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string").selectExpr("cast(a as decimal(38,0)) a", "cast(b as decimal(38,0)) b")
    small = frame.where("abs(a) < 1000").select("a", "b", lloyd.floor_quotient(F.col("a"), F.col("b")).alias("q")).collect()
    assert all(r.q == int(r.a) // int(r.b) for r in small) and len(small) == 21


def test_query_counts_and_sums(spark, sf):
    rows = lloyd.op13_centroid_clustering(spark, sf).collect()
    per = {}
    for r in rows:
        per[r.cluster] = per.get(r.cluster, 0) + r.distance
    assert all(r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values()) for r in rows)
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, centroids = plain(vectors, 64, 8, 10)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in rows), key=repr) == want
    assert {r.cluster: r.centroid_sha256 for r in rows} == {k: lloyd.digest(np.array(centroids[k])) for k in {k for _, k, _ in want}}
