"""Products of blocks that hand out few pairs, and the metric index that leaves blocks out."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import match, metric, product

KEY = ["space", "dimensions"]
LEFT = "space string, dimensions int, l long, v array<float>, tag string, k int"
RIGHT = "space string, dimensions int, r long, v array<float>, floor double, tags array<string>, ceiling double"


def unit(v):
    return v / np.linalg.norm(v)


def clustered(rng, centers, n, spread=0.05):
    return [unit(centers[rng.integers(len(centers))] + rng.normal(scale=spread, size=len(centers[0]))) for _ in range(n)]


def sides(spark, seed=0, n=300, m=40, dims=8):
    """Rows of two spaces, some of which are alike, without direction, of another size or with a null."""
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    centers = [unit(rng.normal(size=dims)) for _ in range(6)]
    left = [("ab"[i % 7 == 0], dims, i, [float(x) for x in v], pick.choice(["s1", "s2", None]), pick.choice([0, 1, 3, 5])) for i, v in enumerate(clustered(rng, centers, n))]
    left += [("a", dims, n + i, left[0][3] if left[0][0] == "a" else left[1][3], "s1", 4) for i in range(9)]
    left += [("a", dims, n + 20, [0.0] * dims, "s1", 3), ("a", dims, n + 21, [1.0], "s1", 3), ("a", dims, n + 22, [None] * dims, "s1", 3)]
    right = [("ab"[i % 5 == 0], dims, i, [float(x) for x in v], pick.choice([-1.0, 0.2, 0.9, 0.99]), pick.choice([[], ["s1"], ["s2", "s9"], None]), None) for i, v in enumerate(clustered(rng, centers, m))]
    right += [("a", dims, m + i, right[1][3], 0.5, [], None) for i in range(6)] + [("a", dims, m + 9, [0.0] * dims, -1.0, [], None)]
    return left, right


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float(a @ b / np.sqrt((a * a).sum() * (b * b).sum()))


def admitted(left, right):
    """(l, r) -> cosine of all pairs that count."""
    out = {}
    for s, d, i, v, tag, _ in left:
        for t, _, j, w, floor, tags, ceiling in right:
            if s != t or len(v) != d or None in v or not any(v) or not any(w) or tags is None or (tags and tag not in tags):
                continue
            c = cosine(v, w)
            if c >= floor and (ceiling is None or c <= ceiling + 1e-12):
                out[i, j] = c
    return out


def best(pairs, side, k):
    """For each row of a side the scores of its k nearest."""
    per = {}
    for pair, c in pairs.items():
        per.setdefault(pair[side], []).append(c)
    return {i: sorted(x, reverse=True)[: k(i)] for i, x in per.items() if k(i) > 0}


PAIRS = {"blocks": product.near_pairs, "index": lambda *a: metric.near_pairs(*a, cell_rows=30)}


@pytest.mark.parametrize("how", sorted(PAIRS))
@pytest.mark.parametrize("block_bytes", [1 << 11, 1 << 20])
def test_nearest_rows_of_each_left_row(spark, how, block_bytes):
    left, right = sides(spark)
    k = {r[2]: r[5] for r in left}
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT).drop("ceiling")
    want = admitted(left, right)
    proposed = PAIRS[how](a, b, KEY, block_bytes, "l").cache()
    rows = [(r.l, r.r, r.score) for r in proposed.collect()]
    assert len(rows) == len({x[:2] for x in rows}) and all(abs(want[i, j] - c) < 1e-9 for i, j, c in rows)
    kept = {(r.l, r.r): r.score for r in product.nearest(proposed, "l").collect()}
    got = best(kept, 0, k.get)
    for i, scores in best(want, 0, k.get).items():
        assert np.allclose(got[i], scores, atol=1e-9), i
    # Nothing leaves the last cut but the k nearest and what ties with the last of them.
    for i, n in Counter(i for i, _ in kept).items():
        edge = sorted((c for (x, _), c in want.items() if x == i), reverse=True)
        assert n <= sum(c >= edge[min(k[i], len(edge)) - 1] - 3e-9 for c in edge)


def test_rows_out_of_the_product_are_bounded(spark):
    """All vectors near each other: every pair reaches its floor, but each block hands out k a row."""
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in unit(np.ones(8) + rng.normal(scale=0.2, size=8))] for _ in range(600)]
    a = spark.createDataFrame([("a", 8, i, v, "s", 3) for i, v in enumerate(vectors[:400])], LEFT)
    b = spark.createDataFrame([("a", 8, i, v, -1.0, []) for i, v in enumerate(vectors[400:])], RIGHT.rpartition(",")[0])
    per = 4096 // (8 * 8 + 64)
    columns = -(-200 // per)
    rows = product.near_pairs(a, b, KEY, 4096, "l").count()
    assert columns > 5 and 400 * 3 <= rows <= 400 * 3 * columns
    assert product.near_pairs(a, b, KEY, 4096).count() == 400 * 200
    assert product.nearest(product.near_pairs(a, b, KEY, 4096, "l"), "l").count() == 400 * 3


@pytest.mark.parametrize("block_bytes", [1 << 11, 1 << 20])
def test_nearest_rows_after_a_cursor(spark, block_bytes):
    left, right = sides(spark, 3)
    rng = random.Random(2)
    every = admitted(left, right)
    of = {}
    for (_, j), c in every.items():
        of.setdefault(j, []).append(c)
    right = [(*r[:6], rng.choice(of[r[2]]) if r[2] in of and rng.random() < 0.7 else None) for r in right]
    a, b = spark.createDataFrame([r[:5] for r in left], LEFT.rpartition(",")[0]), spark.createDataFrame(right, RIGHT).withColumn("k", F.lit(4))
    proposed = product.near_pairs(a, b, KEY, block_bytes, "r")
    kept = {(r.l, r.r): r.score for r in product.nearest(proposed, "r").collect()}
    ceiling = {r[2]: r[6] for r in right}
    for j, scores in of.items():
        top = ceiling[j]
        past = sorted((c for c in scores if top is None or c < top - 1e-9), reverse=True)[:4]
        level = [c for c in scores if top is not None and abs(c - top) <= 1e-9]
        got = sorted((c for (_, r), c in kept.items() if r == j), reverse=True)
        assert len(got) >= len(past) + len(level) and all(min(abs(c - x) for x in got) < 1e-9 for c in past + level)
        assert not got or top is None or got[0] <= top + 2e-9


def test_kth_best():
    scores = np.array([[3.0, 1, 2], [5, 5, 4], [-np.inf, 7, -np.inf]])
    assert product.kth_best(scores, np.array([2, 1, 2])).tolist() == [2, 5, -np.inf]
    assert product.kth_best(scores, np.array([9, 0, 1])).tolist() == [-np.inf, np.inf, 7]
    assert product.kth_best(scores, np.zeros(3, int)).tolist() == [np.inf] * 3


def test_cells_are_passed_over(spark):
    """Far clusters and high floors: most meetings are left out; low floors leave none out."""
    rng = np.random.default_rng(5)
    centers = [unit(np.eye(16)[i] + 0.01) for i in range(10)]
    left = [("a", 16, i, [float(x) for x in v], "s", 3) for i, v in enumerate(clustered(rng, centers, 600, 0.02))]
    vectors = clustered(rng, centers, 80, 0.02)
    for floor, least in ((0.9, 0.7), (-1.0, 0.0)):
        right = [("a", 16, i, [float(x) for x in v], floor, [], None) for i, v in enumerate(vectors)]
        a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT).drop("ceiling")
        told = metric.reach(a, b, KEY, cell_rows=20).first()
        assert told.cells * told.right_rows == told.meetings + told.skipped and told.pairs + told.pairs_skipped == 600 * 80
        assert told.pairs_skipped >= least * 600 * 80 and (floor > 0 or told.skipped == 0)
        found = {(r.l, r.r) for r in metric.near_pairs(a, b, KEY, cell_rows=20).collect()}
        assert found == set(admitted(left, right))


def test_no_rows(spark):
    left, right = sides(spark)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT).drop("ceiling")
    for pairs in PAIRS.values():
        assert pairs(a.limit(0), b, KEY, 1 << 20, "l").count() == pairs(a, b.limit(0), KEY, 1 << 20, "l").count() == 0


def test_pages_without_a_limit_get_no_rules(spark):
    pages = spark.createDataFrame([("p", "T", "s", "m", "1", 2, "l2", [1.0, 0.0], n) for n in (None, 0)], "page_key string, tenant_id string, source_id string, model string, model_version string, dimensions int, normalization string, page_vector array<float>, max_candidates int")
    rules = spark.createDataFrame([("T", "m", "1", 2, "l2", "e", "r", "v", [1.0, 0.0], 0.5, [])], "tenant_id string, model string, model_version string, dimensions int, normalization string, alert_embedding_id string, alert_rule_id string, alert_rule_revision_id string, rule_vector array<float>, similarity_threshold float, source_filters array<string>")
    assert match.reverse_match(pages, rules).count() == match.reverse_match_join(pages, rules).count() == 0
