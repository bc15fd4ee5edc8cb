"""The join of pages and rules by columns of components: the exact expression to the last bit, spread over tasks."""

import random

import numpy as np
import pytest

from tidewatch.operators import match

SPACE = "tenant_id string, model string, model_version string, dimensions int, normalization string"
PAGES = f"page_key string, source_id string, {SPACE}, page_vector array<float>, max_candidates int"
RULES = f"{SPACE}, alert_embedding_id string, alert_rule_id string, alert_rule_revision_id string, similarity_threshold float, source_filters array<string>, rule_vector array<float>"


def rows(spark, dims, n=90, m=40):
    rng, pick = np.random.default_rng(dims), random.Random(dims)
    vector = lambda d: [float(x) for x in rng.normal(size=d).astype(np.float32)]
    odd = [[0.0] * dims, [None] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [1e-30] * dims, [1.0] * (dims - 1), None]
    pages = [(f"p{i}", pick.choice(["s", "t", None]), "AB"[i % 9 == 0], "m", "1", dims, "l2", v, pick.choice([0, 1, 3, 50, None])) for i, v in enumerate([vector(dims) for _ in range(n)] + odd)]
    rules = [
        ("AB"[i % 5 == 0], "m", "1", dims, "l2", f"e{i}", f"r{i}", "v", pick.choice([-1.0, 0.0, 0.1]), pick.choice([[], [], ["source:s"], None]), v)
        for i, v in enumerate([vector(dims) for _ in range(m)] + odd + [pages[1][7]])
    ]
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, RULES)


@pytest.mark.parametrize("columns, dims", [(64, 5), (4, 11)])
def test_join_equals_the_exact_expression(spark, monkeypatch, columns, dims):
    monkeypatch.setattr(match, "COLUMNS", columns)
    monkeypatch.setattr(match, "JOINED_BYTES", 1 << 10)
    pages, rules = rows(spark, dims)
    got = sorted((r.page_key, r["rank"], r.alert_embedding_id, r.similarity) for r in match.reverse_match_join(pages, rules).collect())
    met = pages.join(rules.select("tenant_id", *match.SPACE, *match.RULE), ["tenant_id", *match.SPACE])
    want = sorted((r.page_key, r["rank"], r.alert_embedding_id, r.similarity) for r in match._admitted_pairs(met, "page_key").collect())
    assert len(got) > 150 and got == want


def test_a_space_is_many_groups(spark):
    """One tenant and model space is no single key of the join, and an array is not gone through for each pair."""
    pages, rules = rows(spark, 8)
    plan = match.reverse_match_join(pages, rules)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("row#" in line and "column#" in line and "_p7" in line for line in joins)
    assert not any("zip_with" in line or "aggregate(" in line for line in joins)
