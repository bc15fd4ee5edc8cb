"""Filters of keys: never a key lost, few taken for held, and files without any of the keys left unread."""

from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import key_filters, schemas
from tidewatch.sources.commits import Ledger
from tidewatch.streaming import reverse

KEY = "canonical_match_key"


def keys(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.concat(F.lit("key"), F.col("id").cast("string")), 256).alias(KEY))


def bucketed(df):
    return df.withColumn("bucket", reverse.bucket_of("match_candidates"))


@pytest.mark.parametrize("n", [1, 40, 20000])
def test_held_keys_are_found_and_few_others(spark, n):
    held = bucketed(keys(spark, 0, n))
    filters = key_filters.build(held.unionByName(held), KEY).withColumn("folder", F.lit("f")).cache()
    found = key_filters.possible(filters, bucketed(keys(spark, 0, n)), KEY)
    assert found.select(KEY).distinct().count() == found.count() == n
    others = 20000
    assert key_filters.possible(filters, bucketed(keys(spark, 1_000_000, 1_000_000 + others)), KEY).count() <= others / 500
    # A word takes eight bytes; twice the bits asked for, as sizes are powers of two.
    assert filters.count() * 64 <= max(n * key_filters.BITS_PER_KEY * 2, 64 * reverse.BUCKETS)


def test_null_keys_and_empty_sides(spark):
    none = bucketed(spark.createDataFrame([(None,)], f"{KEY} string"))
    assert key_filters.build(none, KEY).count() == 0
    filters = key_filters.build(bucketed(keys(spark, 0, 5)), KEY).withColumn("folder", F.lit("f"))
    assert key_filters.possible(filters, none, KEY).count() == 0 and key_filters.possible(filters.limit(0), bucketed(keys(spark, 0, 5)), KEY).count() == 0


def candidates(spark, low, high):
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schemas.SCHEMAS["match_candidates"]).schema if f.name != KEY]
    return keys(spark, low, high).select(KEY, *blank)


def test_only_buckets_with_a_key_are_read(spark, tmp_path):
    root = f"{tmp_path}/sink"
    ledger = Ledger(spark, root)
    for n in range(3):
        folder = ledger.draft(n)
        for table in reverse.TABLES:
            rows = candidates(spark, 100 * n, 100 * n + 100) if table == "match_candidates" else spark.createDataFrame([], reverse.COLUMNS[table])
            reverse.publish(rows, root, table, folder)
        assert ledger.publish(folder)
    of = lambda df: reverse.stored(spark, root, "match_candidates", None, df)
    files = lambda df: {urlparse(f).path for f in df.inputFiles()}
    every = files(reverse.stored(spark, root, "match_candidates"))
    # One key of the second batch: one file of all.
    assert len(every) >= 3 * 15 and len(files(of(keys(spark, 150, 151)))) == 1
    # Two keys of different batches that share no file, and keys that nobody has.
    assert len(files(of(keys(spark, 99, 101)))) == 2 and of(keys(spark, 5000, 5020)).count() == 0
    asked = keys(spark, 95, 105).unionByName(keys(spark, 7000, 7010))
    hold = lambda df: sorted(r[0] for r in df.join(asked, KEY, "left_semi").select(KEY).collect())
    assert hold(of(asked)) == sorted(r[0] for r in keys(spark, 95, 105).collect()) == hold(reverse.stored(spark, root, "match_candidates"))
    assert reverse.stored(spark, root, "match_candidates", 1, asked).join(asked, KEY, "left_semi").count() == 5
    assert reverse.merge(spark, root)
    assert hold(of(asked)) == sorted(r[0] for r in keys(spark, 95, 105).collect()) and len(files(of(keys(spark, 150, 151)))) == 1
