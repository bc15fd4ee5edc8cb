"""Registered queries against their SQL, and the stream against the batch."""

import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])

from compare import assert_equal  # noqa: E402

from tidewatch.operators import match, pages  # noqa: E402
from tidewatch.plans import alerting, alerting_sql, contracts, contracts_sql, feeds, feeds_sql, records, records_sql  # noqa: E402
from tidewatch.sources import schemas  # noqa: E402
from tidewatch.streaming import reverse  # noqa: E402


QUERIES = {**alerting.QUERIES, **records.QUERIES, **feeds.QUERIES, **contracts.QUERIES}
ORACLES = {**alerting_sql.ORACLES, **records_sql.ORACLES, **feeds_sql.ORACLES, **contracts_sql.ORACLES}


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"streaming_reverse_match", "streaming_reverse_match_merged"}))
def test_query_equals_sql(spark, sf, name):
    assert_equal(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", ["reverse_match_topk", "page_revision_chain", "url_policy", "query_inputs", "source_creation", "historical_candidates"])
def test_compiled_query_equals_sql_on_more_rows(spark, name):
    """The other tests leave whole-stage compilation off, as it takes longer than their few rows."""
    sf = "/root/testdata/sf0.01"
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        assert_equal(QUERIES[name](spark, sf), ORACLES[name], sf)
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")


def feed(spark, sf):
    fetches, sources = alerting._feed(spark, sf)
    fetches = fetches.where("seq < 120")
    again = fetches.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1000)
    bad = fetches.where("seq = 7").withColumns({"seq": F.lit(5000).cast("long"), "final_url": F.lit("https://elsewhere.org/")})
    return fetches.unionByName(again).unionByName(bad), sources


def tables(spark, root):
    show = lambda t, cols: sorted(map(tuple, reverse.stored(spark, root, t).select(*cols).collect()), key=repr)
    return (
        show("match_candidates", ["candidate_id", "alert_embedding_id", "page_embedding_sha256", "similarity", "created_at"]),
        show("page_revisions", ["revision_id", "predecessor_revision_id", "fetched_at"]),
        sorted(map(tuple, reverse.current(spark, root).collect()), key=repr),
    )


def test_batches_equal_one_batch_and_a_rerun_adds_nothing(spark, sf, tmp_path, monkeypatch):
    fetches, sources = feed(spark, sf)
    fetches = fetches.cache()
    rules = alerting._rule_vectors(spark, sf).cache()
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    reverse.ingest(spark, fetches, one, sources, rules)
    halves = [fetches.where("seq < 1000"), fetches.where("seq >= 1000")]
    everything = lambda: {t: sorted(map(repr, reverse.stored(spark, two, t).collect())) for t in reverse.TABLES}
    publish, views = reverse.publish, []

    def watched(rows, root, table, folder):
        publish(rows, root, table, folder)
        views.append(everything())

    def failing(rows, root, table, folder):
        if table == "rejected_fetches":
            raise OSError("lost")
        publish(rows, root, table, folder)

    for n, half in enumerate(halves):
        before = everything()
        monkeypatch.setattr(reverse, "publish", failing)
        with pytest.raises(OSError, match="lost"):
            reverse.ingest(spark, half, two, sources, rules, n)
        assert everything() == before
        monkeypatch.setattr(reverse, "publish", watched)
        reverse.ingest(spark, half, two, sources, rules, n)
        # A reader between any two writes sees nothing of the batch.
        assert views[-len(reverse.TABLES) :] == [before] * len(reverse.TABLES) and everything() != before
    first = tables(spark, two)
    assert first == tables(spark, one) and first[0]
    after = everything()
    for n, half in enumerate(halves):
        reverse.ingest(spark, half, two, sources, rules, n)
        assert everything() == after
    assert not list((tmp_path / "two" / "_work").glob("*"))
    rejected = reverse.stored(spark, one, "rejected_fetches").collect()
    assert [(r.seq, r.reject_reason) for r in rejected] == [(5000, "host_not_allowed")]


def test_chain_feeds_tables(spark, sf):
    fetches, sources = feed(spark, sf)
    good, _ = pages.admitted(pages.classified(fetches, sources).cache())
    arrived = pages.arrivals(good)
    chain = pages.revision_chain(arrived)
    vectors = pages.new_page_embeddings(arrived)
    assert vectors.count() == chain.where("changed").count() == fetches.where("seq < 1000").count()
    assert schemas.missing_columns(pages.new_revisions(chain), "page_revisions").count() == 0
    assert match.candidate_counts(alerting._candidates(spark, sf)).count() <= 3
