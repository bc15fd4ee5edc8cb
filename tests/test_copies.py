"""Small blocks do not multiply what is sent."""

import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])

from test_product import KEY, LEFT, RIGHT, admitted, sides  # noqa: E402

from tidewatch.operators import product  # noqa: E402


def test_a_row_is_sent_a_bounded_number_of_times(spark, monkeypatch):
    left, right = sides(spark, 5, n=400, m=300)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT).drop("ceiling")
    for block_bytes in (200, 1 << 12):  # a row a block, and a few rows a block
        for side, name in zip(product.met(a, b, KEY, block_bytes), "lr", strict=True):
            assert 1 < side.groupBy(name).count().agg(F.max("count")).first()[0] <= product.COPIES
    found = {(r.l, r.r): r.score for r in product.near_pairs(a, b, KEY, 200).collect()}
    want = admitted(left, right)
    assert set(found) == set(want) and np.allclose([found[k] for k in want], list(want.values()), atol=1e-9)
    # Where full blocks are more than that, a row meets all of them.
    monkeypatch.setattr(product, "BLOCK_BYTES", 1 << 11)
    meets = product.met(a, b, KEY, 200)[0].groupBy("l").count().agg(F.max("count")).first()[0]
    assert meets > product.COPIES and {(r.l, r.r) for r in product.near_pairs(a, b, KEY, 200).collect()} == set(want)
