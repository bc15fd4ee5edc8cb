"""Training-data queries against their SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import assert_equal  # noqa: E402

from tidewatch.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert_equal(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 14))
