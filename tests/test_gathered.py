"""Weighted views summed up inside the product of blocks."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])

from test_product import KEY, LEFT, RIGHT, admitted, sides  # noqa: E402

from tidewatch.operators import product, search  # noqa: E402
from tidewatch.plans import records  # noqa: E402


@pytest.mark.parametrize("block_bytes", [1 << 10, 1 << 20])
def test_sums_equal_those_of_all_pairs(spark, block_bytes):
    left, right = sides(spark, 7)
    pick = random.Random(8)
    weight = {r[2]: pick.choice([None, 0.25, 1.0, 2.0]) for r in right}
    vector = lambda rows: {r[2]: np.array(r[3], np.float32).astype(float)[None] for r in rows if None not in r[3]}
    v, w, zero = vector(left), vector(right), np.zeros(1, int)
    exact = {(i, j): product._exact(v[i], w[j], zero, zero)[0] for i, j in admitted(left, [(*r[:4], -2.0, *r[5:]) for r in right])}
    # Floors that are met exactly, and just missed.
    at = {j: c for (_, j), c in sorted(exact.items())}
    floor = {r[2]: float(np.nextafter(at[r[2]], 2 * (r[2] % 4 > 1))) if r[2] in at and r[2] % 2 else r[4] for r in right}
    a = spark.createDataFrame(left, LEFT).drop("k")
    b = spark.createDataFrame([(*r[:4], floor[r[2]], r[5], r[2] % 3, weight[r[2]]) for r in right], f"{RIGHT.rpartition(',')[0].replace('r long', 'of long')}, r long, weight double")
    want = {}
    for (i, j), c in exact.items():
        if c >= floor[j]:
            want.setdefault((i, j % 3), []).append((c, weight[j]))
    got = {(x.l, x.r): x for x in product.gathered(a, b, KEY, block_bytes).collect()}
    assert len(want) > 300 and set(got) == set(want)
    for k, pairs in want.items():
        known = [(c, w) for c, w in pairs if w is not None]
        assert abs(got[k].best - max(c for c, _ in pairs)) < 1e-12
        assert (got[k].weight is None) == (not known)
        if known:
            assert abs(got[k].weight - sum(w for _, w in known)) < 1e-12 and abs(got[k].weighted - sum(c * w for c, w in known)) < 1e-12


def test_exact_cosine_is_that_of_the_expression(spark):
    from tidewatch.functions.vectors import cosine_similarity

    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 2, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in p], [float(x) for x in q]) for i, (p, q) in enumerate(v)], "i int, a array<float>, b array<float>")
    want = [r.c for r in df.select("i", cosine_similarity(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]
    all_of = np.arange(50)
    assert product._exact(v[:, 0].astype(float), v[:, 1].astype(float), all_of, all_of).tolist() == want


def test_no_pair_of_an_item_and_a_view_leaves_its_task(spark, sf):
    plan = records.multi_view_search(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan
    items, views = records.alerting._items(spark, sf), records._views_of_queries(spark, sf)
    pairs = search.scored(items, views.withColumn("query_id", F.struct("query_id", "input_id")))
    old = pairs.groupBy(F.col("query_id.query_id").alias("q"), "embedding_id").agg(F.max("similarity").alias("best"))
    new = search.multi_view_scores(items, views, "max")
    show = lambda df: {tuple(r)[:2]: r[2] for r in df.collect()}
    one, two = show(old), show(new)
    assert set(one) == set(two) and all(abs(one[k] - two[k]) < 1e-12 for k in one)
