"""Stages tell rows apart by themselves: equal or null ids, equal texts and odd columns lose nothing."""

from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import inverted_index, mixing, near_copies, quality

ODD = "doc_id long, text string, source string, tags map<string,int>, row long, turn int, `a.b` string, __hit int"


def odd(spark):
    rows = [(1, "one two three four five", "s", {"k": 1}), (1, "one two three four five", "s", {"k": 2}), (None, "six seven", "t", None)]
    rows += [(None, "eight nine", "t", None), (2, None, None, None), (3, "", "s", None), (1, "quite another text", "s", None)]
    return spark.createDataFrame([(*r, i, 7, "x", 0) for i, r in enumerate(rows)], ODD)


def test_mixed_rows_keep_every_column(spark):
    docs = odd(spark)
    mixed = mixing.mixed_rows(docs)
    assert mixed.dtypes == docs.dtypes
    taken = Counter(r.row for r in mixed.collect())
    assert taken == Counter(r.row for r in mixing.mixed_rows(docs.repartition(3)).collect())
    assert set(taken) <= {0, 1, 2, 3, 6} and {r.row: (r.tags or {}).get("k") for r in mixed.collect() if r.row < 2}.items() <= {0: 1, 1: 2}.items()
    want = {r.doc_id: r.copies for r in mixing.mix(docs.select(F.col("row").alias("doc_id"), "text", "source")).collect()}
    assert sum(taken.values()) == sum(want.values())
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


def test_many_sizes_carry_exactly(spark):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 700 as int))").alias("text"), F.expr("concat('s', id % 3)").alias("source"))
    per = mixing.mix(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(per) == 3 and all(abs(r.taken - r.target) <= 1 for r in per)


def test_decontaminate_by_row(spark):
    docs = odd(spark)
    items = spark.createDataFrame([(None, "six seven"), ("b", "one two three four"), ("b", "not here at all")], "item_id string, text string")
    kept = inverted_index.decontaminate(docs, items, size=4)
    assert kept.dtypes == docs.dtypes and sorted(r.row for r in kept.collect()) == [3, 4, 5, 6]
    found = inverted_index.search(inverted_index.build_index(docs.select("row", "text").withColumnRenamed("row", "doc_id")), items, size=4)
    assert {r.doc_id: (r.hits, r.items) for r in found.collect() if r.hits} == {0: ([0, 1, 2, 3], ["b"]), 1: ([0, 1, 2, 3], ["b"]), 2: ([0, 1], [])}


def test_documents_are_told_by_stored_shards(spark, monkeypatch):
    """Answers to several blocks belong together however the index is split when it is read."""
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.expr("concat('alpha beta gamma delta ', id, ' omega ', id % 7, ' end of it')").alias("text"))
    items = spark.createDataFrame([(f"i{i}", f"omega {i} end of") for i in range(7)] + [("all", "alpha beta gamma delta")], "item_id string, text string")
    index = inverted_index.build_index(docs.repartition(5))
    assert index.select("shard").distinct().count() == index.count() == 5
    want = {i: (list(range(4)) + list(range(5, 9)), sorted(["all", f"i{i % 7}"])) for i in range(60)}
    monkeypatch.setattr(inverted_index, "BLOCK_BYTES", 100)
    for split in (index, index.coalesce(1), index.repartition(3, "shard")):
        found = inverted_index.search(split, items, size=4).collect()
        assert len(found) == 60 and {r.doc_id: (sorted(r.hits), r.items) for r in found} == want


def test_quality_and_copies_by_row(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels, good=0.0)
    assert kept.dtypes == docs.dtypes and kept.count() == docs.count()
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    alone = near_copies.keep_one(docs)
    assert alone.dtypes == docs.dtypes and sorted((r.text or "") for r in alone.collect()) == sorted(["", "eight nine", "one two three four five", "quite another text", "six seven"])
