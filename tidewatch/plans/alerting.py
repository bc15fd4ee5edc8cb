"""Registered queries of the alerting engine over the derived tables."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scope, text, urls, vectors
from ..functions.ids import match_key, uuid_of
from ..operators import access, audit, frontier, match, metric, pages, rules, search, snapshots, views
from ..sources import derived
from ..sources.schemas import stream_feed
from ..sources.scratch import scratch_path
from ..streaming import reverse

SPACE = ["model", "model_version", "dimensions", "normalization"]
PER_PAGE, PER_QUERY, PER_RULE = 10, 5, 5


def _rule_vectors(spark: SparkSession, d: str) -> DataFrame:
    return match.rule_vectors(
        derived.alert_rules(spark, d), derived.alert_rule_revisions(spark, d), derived.alert_rule_embeddings(spark, d)
    )


def _matches(spark: SparkSession, d: str, how: Callable = match.reverse_match) -> DataFrame:
    p = derived.page_vectors(spark, d, PER_PAGE)
    found = how(p, _rule_vectors(spark, d))
    return found.join(p.select("page_key", "content_sha256", "canonical_url", "fetched_at"), "page_key").withColumnRenamed("page_key", "revision_id")


def _shown_matches(found: DataFrame) -> DataFrame:
    key = match_key(*[F.col(c) for c in ("tenant_id", "alert_rule_id", "alert_rule_revision_id", "revision_id", "content_sha256", *SPACE)])
    return found.select(
        "revision_id", "alert_rule_id", "alert_embedding_id", "rank", F.round("similarity", 6).alias("similarity"), "threshold", key.alias("match_key")
    )


def reverse_match_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown_matches(_matches(spark, d))


def reverse_match_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same with blocks so small that a space has many on either side."""
    return _shown_matches(_matches(spark, d, lambda p, r: match.reverse_match(p, r, block_bytes=1 << 14)))


def reverse_match_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The same through the metric index, with small cells."""
    indexed = lambda *a: metric.near_pairs(*a, cell_rows=200)
    return _shown_matches(_matches(spark, d, lambda p, r: match.reverse_match(p, r, pairs=indexed)))


def reverse_match_joined(spark: SparkSession, d: str) -> DataFrame:
    return _shown_matches(_matches(spark, d, match.reverse_match_join))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return search.searchable(derived.page_embeddings(spark, d), derived.page_revisions(spark, d), derived.pages(spark, d))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return derived.rule_base(spark, d).where("model_version = 'v1'").select(
        F.col("alert_embedding_id").alias("query_id"), "tenant_id", *SPACE, F.col("embedding").alias("vector"),
        F.lit(0.05).cast("float").alias("min_similarity"), F.array().cast("array<string>").alias("source_ids"),
    )


def _shown_hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "embedding_id", "source_id", F.round("similarity", 6).alias("similarity"), "has_more")


def similarity_search(spark: SparkSession, d: str) -> DataFrame:
    return _shown_hits(search.search_many(_items(spark, d), _queries(spark, d), PER_QUERY))


def similarity_search_page2(spark: SparkSession, d: str) -> DataFrame:
    queries = _queries(spark, d)
    cursors = search.next_cursors(search.search_many(_items(spark, d), queries, PER_QUERY))
    return _shown_hits(search.search_many(_items(spark, d), queries.join(cursors, "query_id"), PER_QUERY))


def historical_match(spark: SparkSession, d: str) -> DataFrame:
    found = match.historical_match(_items(spark, d), _rule_vectors(spark, d), PER_RULE)
    return found.select("alert_rule_id", "embedding_id", "rank", F.round("similarity", 6).alias("similarity"), "threshold")


def page_revision_chain(spark: SparkSession, d: str) -> DataFrame:
    chain = pages.revision_chain(pages.arrivals(derived.fetches(spark, d)))
    return chain.select("seq", "page_id", "revision_id", "content_sha256", "changed", "pointer_before")


def page_current(spark: SparkSession, d: str) -> DataFrame:
    now = pages.current_pages(pages.arrivals(derived.fetches(spark, d)))
    return now.select("page_id", "canonical_url", "latest_revision_id", "first_seen_at", "last_seen_at")


def url_policy(spark: SparkSession, d: str) -> DataFrame:
    policy = (F.array(F.lit("example.com")), F.lit(True), F.array(F.lit("/en"), F.lit("/de")))
    checked = urls.with_canonical_url(derived.table(spark, d, "pages").select("page_id", "url"), "c", F.col("url"), *policy)
    return checked.select("page_id", "c.canonical", "c.reject_reason")


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return derived.table(spark, d, "documents").select("doc_id", text.content_sha256(F.col("text")).alias("content_sha256"))


def query_keywords(spark: SparkSession, d: str) -> DataFrame:
    return derived.query_texts(spark, d).select("conv_id", "turn", F.array_join(text.keywords(F.col("query_text")), " ").alias("keywords"))


def query_entities(spark: SparkSession, d: str) -> DataFrame:
    return derived.query_texts(spark, d).select("conv_id", "turn", F.array_join(text.entities(F.col("query_text")), "|").alias("entities"))


def query_inputs(spark: SparkSession, d: str) -> DataFrame:
    inputs = views.exploded(derived.query_texts(spark, d), ["conv_id", "turn"], text.query_inputs(F.col("query_text")))
    return inputs.select("conv_id", "turn", "ordinal", "kind", "text", "text_sha256", F.round(F.col("weight").cast("double"), 3).alias("weight"))


def query_input_report(spark: SparkSession, d: str) -> DataFrame:
    texts = derived.query_texts(spark, d)
    inputs = views.exploded(texts, ["conv_id"], text.query_inputs(F.col("query_text")))
    return views.input_report(inputs, "conv_id")


def weighted_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = derived.table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("set_id"), (F.col("vec_id") % 10).alias("ordinal"), "embedding",
        (F.lit(0.5) + F.lit(0.125) * (F.col("vec_id") % 10)).alias("weight"),
    )
    pooled = vectors.weighted_centroid(e, "set_id", "ordinal", "embedding", "weight")
    return pooled.select("set_id", "status", F.posexplode("centroid").alias("place", "value")).select(
        "set_id", "status", "place", F.round(F.col("value").cast("double"), 5).alias("value")
    )


def source_scope(spark: SparkSession, d: str) -> DataFrame:
    b = derived.rule_base(spark, d)
    third = F.col("q10") % 3
    requested = F.when(third == 0, F.array().cast("array<string>")).when(third == 1, F.array(uuid_of(2, F.col("label")))).otherwise(
        F.array(uuid_of(2, F.col("label")), uuid_of(2, (F.col("label") + 1) % 10))
    )
    allowed = scope.constrain(scope.filter_ids(F.col("source_filters")), requested)
    return b.select("alert_rule_id", allowed.isNotNull().alias("admitted"), F.array_join(allowed, ",").alias("sources"))


def rule_listing_by_principal(spark: SparkSession, d: str) -> DataFrame:
    listed = rules.listing(derived.alert_rules(spark, d), derived.alert_rule_revisions(spark, d))
    principals = listed.select("tenant_id", F.col("owner_subject").alias("subject")).distinct().withColumn(
        "is_tenant_admin", F.col("subject") == "user-0"
    )
    seen = access.visible_rows(listed, principals)
    newest = rules.newest(seen, ["tenant_id", "subject"], "updated_at", "alert_rule_id")
    return newest.select("tenant_id", "subject", "rank", "alert_rule_id", "owner_subject", "name", "enabled", F.round(F.col("similarity_threshold").cast("double"), 6).alias("threshold"))


def active_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.active_counts(derived.alert_rules(spark, d), derived.alert_rule_revisions(spark, d))


def active_rule_cap(spark: SparkSession, d: str) -> DataFrame:
    enables = derived.activations(spark, d).where("enable").withColumn("seq", F.struct("ts", "event_id"))
    return rules.admit_activations(enables).select("tenant_id", "owner_subject", "alert_rule_id", "nth", "admitted")


def active_rule_cap_with_disable(spark: SparkSession, d: str) -> DataFrame:
    return rules.admit_activation_log(derived.activations(spark, d))


def rule_embedding_upsert(spark: SparkSession, d: str) -> DataFrame:
    b = derived.rule_base(spark, d).withColumnRenamed("revision_id", "alert_rule_revision_id")
    key = ["tenant_id", "alert_rule_id", "alert_rule_revision_id", *SPACE]
    stored = b.where("q10 % 2 = 0").select(*key, vectors.embedding_sha256(F.col("embedding")).alias("embedding_sha256"))
    first = b.select(F.col("vec_id").alias("seq"), *key, "embedding")
    again = b.where("q10 % 5 = 0").select((F.col("vec_id") + 1).alias("seq"), *key, F.reverse("embedding").alias("embedding"))
    short = b.where("q10 % 11 = 0").select((F.col("vec_id") + 2).alias("seq"), *key, F.slice("embedding", 1, 3).alias("embedding"))
    out = rules.upsert_rule_embeddings(
        first.unionByName(again).unionByName(short), derived.alert_rules(spark, d), derived.alert_rule_revisions(spark, d), stored, F.current_timestamp()
    )
    return out.select("seq", "alert_rule_id", "outcome")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    hashed = derived.page_base(spark, d).select("revision_id", vectors.embedding_sha256(F.col("embedding")).alias("page_embedding_sha256"))
    return match.reverse_candidates(_matches(spark, d).join(hashed, "revision_id"), F.col("fetched_at"))


def candidate_dedup(spark: SparkSession, d: str) -> DataFrame:
    new = _candidates(spark, d)
    n = F.substring("alert_rule_id", -6, 6).cast("int")
    stored = new.where(n % 2 == 0).withColumn("page_embedding_model", F.when(n % 4 == 0, "other").otherwise(F.col("page_embedding_model")))
    inserted, existing, conflicts = match.merge_candidates(new, stored, match.REVERSE_EVIDENCE)
    show = lambda df, name: df.select("canonical_match_key", "revision_id", "alert_rule_id", F.lit(name).alias("outcome"))
    return show(inserted, "inserted").unionByName(show(existing, "existing")).unionByName(show(conflicts, "conflict"))


def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    return match.candidate_counts(_candidates(spark, d))


def match_keys(spark: SparkSession, d: str) -> DataFrame:
    p = derived.page_base(spark, d)
    key = match_key(
        F.col("tenant_id"), uuid_of(3, F.col("q10")), uuid_of(4, F.col("q10")), F.col("revision_id"), F.col("content_sha256"), *[F.col(c) for c in SPACE]
    )
    return p.select("revision_id", key.alias("match_key"))


def event_visibility(spark: SparkSession, d: str) -> DataFrame:
    return access.event_audience(derived.event_feed(spark, d), derived.event_principals(spark, d)).select("subject", "event_id", "event_type")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before = derived.alert_rule_revisions(spark, d)
    n = F.substring("alert_rule_id", -6, 6).cast("int")
    after = before.where(n % 11 != 0).withColumn("similarity_threshold", F.when(n % 13 == 0, F.lit(0.9).cast("float")).otherwise(F.col("similarity_threshold")))
    return before, after.withColumn("name", F.when(n % 26 == 0, "renamed").otherwise(F.col("name")))


def immutability_audit(spark: SparkSession, d: str) -> DataFrame:
    found = audit.immutability(*_snapshots(spark, d), "alert_rule_revisions")
    return found.select("id", "change", F.array_join(F.array_sort("columns"), ",").alias("columns"))


def immutability_by_digest(spark: SparkSession, d: str) -> DataFrame:
    """``immutability_audit`` of stored snapshots, of which only the ranges that differ are joined."""
    roots = [scratch_path(spark, "snapshot") for _ in range(2)]
    for rows, root in zip(_snapshots(spark, d), roots, strict=True):
        snapshots.write(rows, root, "revision_id", audit.MUTABLE["alert_rule_revisions"])
    found = snapshots.immutability(spark, *roots, "alert_rule_revisions")
    return found.select("id", "change", F.array_join(F.array_sort("columns"), ",").alias("columns"))


def integrity_audit(spark: SparkSession, d: str) -> DataFrame:
    p, r, e = derived.pages(spark, d), derived.page_revisions(spark, d), derived.page_embeddings(spark, d)
    n = lambda c: F.substring(c, -9, 9).cast("int")
    tables = {
        "pages": p.where(n("page_id") % 17 != 0), "page_revisions": r.unionByName(r.where(n("revision_id") % 23 == 0)),
        "page_embeddings": e.withColumn("revision_id", F.when(n("embedding_id") % 29 == 0, uuid_of(9, F.lit(0))).otherwise(F.col("revision_id"))),
    }
    return audit.integrity(tables)


def input_audit(spark: SparkSession, d: str) -> DataFrame:
    """Documents as embedding inputs: most are longer than an input may be."""
    docs = derived.table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, "note").otherwise("document").alias("kind"), (F.col("doc_id") % 128).cast("int").alias("ordinal"), "text",
        F.sha2("text", 256).alias("text_sha256"), (F.lit(0.05) + F.lit(0.25) * (F.col("doc_id") % 10)).cast("float").alias("weight"),
    )
    _, bad = audit.split_rows(docs, "semantic_inputs")
    return bad.select("doc_id", F.array_join("errors", ",").alias("errors"))


def frontier_due(spark: SparkSession, d: str) -> DataFrame:
    queue = frontier.merged(derived.crawl_queue(spark, d))
    due = frontier.due(queue, derived.crawl_sources(spark, d), F.timestamp_seconds(F.lit(6 * 3600)))
    return due.select("source_id", "canonical_url", "turn", "priority", "status")


def _page_inputs(spark: SparkSession, d: str) -> DataFrame:
    viewed = views.with_page_inputs(derived.spread(derived.table(spark, d, "pages")), "inputs", F.col("html"), F.col("url"))
    return views.exploded(viewed, ["page_id"], F.col("inputs"))


def page_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The views of all kinds, in order; those that SQL can express are ``page_views`` too."""
    return _page_inputs(spark, d).select("page_id", "ordinal", "kind", "text", F.round(F.col("weight").cast("double"), 3).alias("weight"))


def page_views(spark: SparkSession, d: str) -> DataFrame:
    return _page_inputs(spark, d).where(F.col("kind").isin("title", "heading", "url_signal")).select(
        "page_id", "kind", "text", F.round(F.col("weight").cast("double"), 3).alias("weight")
    )


def embedding_sha256(spark: SparkSession, d: str) -> DataFrame:
    return derived.table(spark, d, "embeddings").select("vec_id", vectors.embedding_sha256(F.col("embedding")).alias("embedding_sha256"))


def vector_text(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as text and read again: the round trip loses nothing."""
    e = derived.table(spark, d, "embeddings").select("vec_id", "embedding", vectors.to_text(F.col("embedding")).alias("text"))
    return e.select("vec_id", (vectors.from_text(F.col("text")) == F.col("embedding")).alias("same"), F.size(vectors.from_text(F.col("text"))).alias("dimensions"))


def principal_claims(spark: SparkSession, d: str) -> DataFrame:
    """Roles of the events' users from claims: a list for even users, a text for odd ones."""
    users = derived.table(spark, d, "events").select("user_id").distinct()
    n = F.col("user_id")
    role = F.when(n % 50 == 0, " Admin ").when(n % 3 == 0, "Editor").otherwise("viewer")
    claims = F.when(
        n % 2 == 0, F.to_json(F.struct(n.cast("string").alias("sub"), uuid_of(1, n % 3).alias("tenant_id"), F.array(role, F.lit("MEMBER")).alias("roles")))
    ).otherwise(F.to_json(F.struct(n.cast("string").alias("sub"), uuid_of(1, n % 3).alias("tenant_id"), F.concat(role, F.lit(", member")).alias("roles"))))
    found = access.principals_from_claims(users.select(claims.alias("claims")), allowed=("admin", "editor"))
    return found.select("tenant_id", "subject", F.array_join("roles", ",").alias("roles"), "is_tenant_admin")


LOWER = str.maketrans(text.UPPER, text.LOWER)


def hashing_embedder(dimensions: int = 32) -> Callable[[pd.Series], pd.Series]:
    """An embedder without a model: words hashed to signed places."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dimensions, np.float32)
            for word in t.translate(LOWER).split():
                h = int(md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)
                v[h % dimensions] += 1 if h >> 31 else -1
            out.append(v if v.any() else np.ones(dimensions, np.float32))
        return pd.Series(out)

    return run


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    texts = derived.query_texts(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "query_text")
    pooled = views.query_vectors(texts, hashing_embedder(), 32)
    place = lambda i: F.round(F.col("centroid")[i].cast("double"), 5)
    return pooled.select("query_id", "status", "inputs", F.round("length", 5).alias("length"), place(0).alias("first"), place(31).alias("last"))


def _feed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(fetches, sources) for the stream, from the page vectors."""
    p = derived.page_base(spark, d)
    e = F.struct("model", "model_version", "dimensions", "normalization", F.col("embedding").alias("values"))
    fetches = p.select(
        F.col("vec_id").alias("seq"), "tenant_id", "source_id", F.concat("canonical_url", F.lit("#top")).alias("url"), F.col("canonical_url").alias("final_url"),
        F.lit("").alias("title"), F.concat(F.lit("content "), F.col("vec_id").cast("string")).alias("content_text"), F.lit("text/html").alias("content_type"),
        F.lit(200).cast("smallint").alias("http_status"), F.lit(None).cast("timestamp").alias("published_at"), "fetched_at", e.alias("embedding"),
        F.lit(PER_PAGE).cast("smallint").alias("max_candidates"),
    )
    sources = p.select("tenant_id", "source_id").distinct().select(
        "*", F.array(F.lit("example.com")).alias("allowed_hosts"), F.array(F.lit("/")).alias("allowed_path_prefixes"), F.lit(True).alias("include_subdomains"),
        F.lit(True).alias("enabled"),
    )
    return fetches, sources


def streaming_reverse_match(spark: SparkSession, d: str) -> DataFrame:
    """The page vectors replayed as a feed of JSON files in two micro-batches."""
    root = scratch_path(spark, "stream")
    fetches, sources = _feed(spark, d)
    fetches.repartition(2, "seq").write.json(f"{root}/feed")
    feed = stream_feed(spark, f"{root}/feed", files_per_batch=1)
    reverse.start(feed, f"{root}/out", f"{root}/checkpoint", sources, lambda: _rule_vectors(spark, d)).awaitTermination()
    found = reverse.stored(spark, f"{root}/out", "match_candidates")
    return found.select("tenant_id", "alert_rule_id", "alert_embedding_id", F.round("similarity", 6).alias("similarity"), "threshold")


def streaming_reverse_match_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same feed in four batches; folders are merged after the second and the fourth, and a batch is sent once more after each."""
    root = scratch_path(spark, "stream")
    fetches, sources = _feed(spark, d)
    rules_now = _rule_vectors(spark, d)
    for n in range(4):
        part = fetches.where(F.col("seq") % 4 == n)
        reverse.ingest(spark, part, root, sources, rules_now, n)
        if n % 2:
            reverse.merge(spark, root)
            reverse.ingest(spark, part, root, sources, rules_now, n)
    found = reverse.stored(spark, root, "match_candidates")
    return found.select("tenant_id", "alert_rule_id", "alert_embedding_id", F.round("similarity", 6).alias("similarity"), "threshold")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        reverse_match_topk, reverse_match_blocks, reverse_match_pruned, reverse_match_joined, similarity_search, similarity_search_page2, historical_match, page_revision_chain, page_current,
        url_policy, content_hash, query_keywords, query_entities, query_inputs, query_input_report, weighted_centroid, source_scope,
        rule_listing_by_principal, active_rule_counts, active_rule_cap, active_rule_cap_with_disable, rule_embedding_upsert, candidate_dedup,
        candidate_counts, match_keys, event_visibility, immutability_audit, immutability_by_digest, integrity_audit, input_audit, frontier_due, page_views, page_inputs, embedding_sha256,
        vector_text, principal_claims, query_vectors, streaming_reverse_match, streaming_reverse_match_merged,
    )
}
