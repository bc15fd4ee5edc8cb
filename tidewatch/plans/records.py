"""Registered queries about what is taken in, refused, recorded and sent on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scope, text
from ..functions.ids import uuid_of
from ..operators import access, audit, frontier, intervals, match, pages, rules, search, views
from ..sources import derived, schemas
from ..sources.scratch import scratch_path
from ..streaming import reverse
from . import alerting

SPACE = ["model", "model_version", "dimensions", "normalization"]


def _epoch():
    return F.timestamp_seconds(F.lit(0))


def _none():
    return F.array().cast("array<string>")


def _every(n: int, column: str = "n"):
    return F.col(column) % n == 0


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups and purchases as submissions of four rules an owner; some break a rule of form."""
    e = derived.table(spark, d, "events").where("event_type IN ('signup', 'purchase')").withColumn("n", F.col("event_id"))
    source = uuid_of(2, F.col("n") % 10)
    channels = F.when(_every(23), F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.concat(F.lit("c"), i.cast("string"))))
    return e.select(
        F.col("n").alias("seq"), uuid_of(1, F.col("user_id") % 3).alias("tenant_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("owner_subject"),
        (F.col("n") % 4).cast("string").alias("rule_ref"), F.when(_every(13), "  ").otherwise(F.concat(F.lit("  rule "), (F.col("n") % 4).cast("string"), F.lit("\t"))).alias("name"),
        F.when(_every(17), " x ").otherwise(F.concat(F.lit("watch   topic "), (F.col("n") % 5).cast("string"))).alias("query_text"),
        F.lit(" test-embedding-model ").alias("embedding_model"), ((F.col("n") % 12) / 10).alias("similarity_threshold"),
        channels.when(_every(29), F.array(F.lit(" "))).otherwise(F.array(F.lit("in_app"), F.lit(" email "), F.lit("in_app"))).alias("delivery_channels"),
        F.when(_every(19), F.array(F.lit("not-a-source"))).when(_every(7), F.array(F.concat(F.lit("source:"), source), F.upper(source))).otherwise(_none()).alias("source_filters"),
        F.lit(None).cast("boolean").alias("enabled"),
    )


def rule_revisions_created(spark: SparkSession, d: str) -> DataFrame:
    made, revisions, _ = rules.create_rules(_submissions(spark, d), _epoch())
    active = made.select("alert_rule_id", "active_revision_id")
    return revisions.join(active, "alert_rule_id").select(
        "alert_rule_id", "revision_id", "revision_number", "name", "query_text", "embedding_model", F.round(F.col("similarity_threshold").cast("double"), 6).alias("threshold"),
        F.array_join("source_filters", ",").alias("filters"), F.array_join("delivery_channels", ",").alias("channels"), "enabled",
        (F.col("revision_id") == F.col("active_revision_id")).alias("is_active"),
    )


def rule_submissions_rejected(spark: SparkSession, d: str) -> DataFrame:
    _, _, rejected = rules.create_rules(_submissions(spark, d), _epoch())
    return rejected.select("seq", "tenant_id", F.array_join("errors", ",").alias("errors"))


def source_creation(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of the pages submitted as sources, some outside their own policy or bounds, some taken already."""
    host = F.regexp_extract("url", r"^[^:]+://([^/?#]+)", 1)
    p = derived.table(spark, d, "pages").select(F.col("page_id").alias("n"), host.alias("host"))
    submitted = p.select(
        F.col("n").alias("seq"), uuid_of(1, F.col("n") % 2).alias("tenant_id"), F.when(_every(9), "").otherwise("site").alias("name"),
        F.concat(F.lit("https://"), "host", F.lit(":443/#top")).alias("root_url"), F.array(F.when(_every(11), "other.example").otherwise(F.col("host"))).alias("allowed_hosts"),
        F.lit(False).alias("include_subdomains"), F.array(F.lit("/")).alias("allowed_path_prefixes"), F.array(F.lit("manual")).alias("discovery_modes"),
        F.when(_every(7), 10).otherwise(3600).alias("crawl_interval_seconds"), F.lit(3).cast("smallint").alias("max_depth"),
        F.lit(100).alias("max_pages_per_run"), (F.col("n") % 13 != 0).alias("obey_robots"),
    )
    stored = p.where("n % 40 = 0").select(uuid_of(1, F.lit(0)).alias("tenant_id"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("root_url"))
    made = rules.create_sources(submitted, stored, _epoch())
    return made.select("seq", F.when(F.col("outcome") != "rejected", F.col("source_id")).alias("source_id"), "root_url", "outcome", "reason")


def page_requests_rejected(spark: SparkSession, d: str) -> DataFrame:
    """The page feed with bad fields planted, each request with the source that its route names."""
    fetches, sources = alerting._feed(spark, d)
    n, e = F.col("seq"), F.col("embedding")
    bad = fetches.withColumns(
        {
            "http_status": F.when(n % 31 == 0, 500).otherwise(200).cast("smallint"), "max_candidates": F.when(n % 37 == 0, 501).otherwise(10).cast("smallint"),
            "content_type": F.when(n % 41 == 0, "").otherwise("text/html"), "fetched_at": F.when(n % 43 != 0, F.col("fetched_at")),
            "embedding": F.struct(
                F.when(n % 47 == 0, "").otherwise(e["model"]).alias("model"), F.when(n % 53 == 0, "").otherwise(e["model_version"]).alias("model_version"),
                (e["dimensions"] + (n % 59 == 0).cast("int")).alias("dimensions"), e["normalization"].alias("normalization"),
                F.when(n % 61 == 0, F.concat(F.slice(e["values"], 2, 1 << 20), F.array(F.lit(float("nan")).cast("float")))).otherwise(e["values"]).alias("values"),
            ),
            "final_url": F.when(n % 67 == 0, "https://elsewhere.org/").otherwise(F.col("final_url")),
            "route_source_id": F.when(n % 29 == 0, uuid_of(2, F.lit(99))).otherwise(F.col("source_id")),
        }
    )
    known = sources.where(F.col("source_id") != uuid_of(2, F.lit(8))).withColumn("enabled", F.col("source_id") != uuid_of(2, F.lit(9)))
    return pages.classified(bad, known).where("reject_reason IS NOT NULL").select("seq", "reject_reason")


def candidate_audit(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of both modes with fields broken; those from before the cutover need no rule revision."""
    v = derived.table(spark, d, "embeddings").withColumn("n", F.col("vec_id"))
    sha = lambda bad: F.when(bad, "ABC").otherwise(F.sha2(F.col("n").cast("string"), 256))
    rows = v.select(
        "n", F.when(_every(3), "reverse_alert_stream").when(_every(50), "guess").otherwise("historical_page_search").alias("match_mode"),
        F.element_at(F.array(*[F.lit(s) for s in (*audit.STATUSES, "lost")]), (F.col("n") % 7 + 1).cast("int")).alias("status"),
        F.when(_every(11), 1.5).when(_every(13), float("nan")).otherwise(0.5).alias("similarity"), F.when(_every(17), -0.1).otherwise(0.25).alias("threshold"),
        sha(_every(19)).alias("canonical_match_key"), F.when(~_every(5), uuid_of(8, F.col("n"))).alias("embedding_id"),
        F.when(~_every(4), uuid_of(5, F.col("n"))).alias("alert_embedding_id"), sha(_every(9)).alias("page_embedding_sha256"),
        F.lit("m").alias("page_embedding_model"), F.lit("v1").alias("page_embedding_model_version"), F.lit(64).alias("page_embedding_dimensions"),
        F.when(_every(15), "squashed").otherwise("l2").alias("page_embedding_normalization"), F.when(~_every(2), uuid_of(4, F.col("n"))).alias("alert_rule_revision_id"),
        F.timestamp_seconds(F.col("n")).alias("created_at"),
    )
    errors = audit.errors_of("match_candidates", cutover=F.timestamp_seconds(F.lit(100)))
    return rows.select("n", F.array_join(errors, ",").alias("errors")).where("errors <> ''")


def provider_output(spark: SparkSession, d: str) -> DataFrame:
    """Sets of ten inputs whose vectors came back missing, twice, unasked, of another model or not finite."""
    v = derived.table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("set_id"), (F.col("vec_id") % 10).alias("ordinal"), "vec_id", "embedding"
    )
    model = F.when(F.col("vec_id") % 70 == 3, "other").otherwise("test-embedding-model")
    back = v.where("vec_id % 90 <> 4").select("set_id", "ordinal", model.alias("model"), F.when(F.col("vec_id") % 110 == 5, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"), "vec_id")
    twice = back.where("vec_id % 130 = 6")
    unasked = back.where("vec_id % 170 = 7").withColumn("ordinal", F.lit(77).cast("bigint"))
    outputs = back.unionByName(twice).unionByName(unasked).drop("vec_id")
    size = v.select(F.size("embedding").alias("n")).first()[0]
    found = views.output_errors(v.select("set_id", "ordinal"), outputs, size, "test-embedding-model")
    return found.select("set_id", F.array_join("errors", ",").alias("errors"))


RAISED = 0.27


def historical_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of an evaluation that asks for more than most rules do, with what they record of their score."""
    hits = match.historical_match(alerting._items(spark, d), alerting._rule_vectors(spark, d), 5, RAISED)
    made = match.historical_candidates(hits, _epoch())
    told = lambda field: F.get_json_object("score_explanation", f"$.{field}")
    return made.select(
        "canonical_match_key", "alert_rule_id", "embedding_id", "match_mode", "status", F.round("threshold", 6).alias("threshold"),
        F.round(told("semantic_similarity").cast("double"), 6).alias("similarity"), told("page_revision_id").alias("told_revision"),
        told("canonical_url").alias("told_url"), told("dimensions").cast("int").alias("told_dimensions"),
    )


def score_explanations(spark: SparkSession, d: str) -> DataFrame:
    told = lambda field: F.get_json_object("score_explanation", f"$.{field}")
    return alerting._candidates(spark, d).select(
        "canonical_match_key", told("match_mode").alias("told_mode"), F.round(told("semantic_similarity").cast("double"), 6).alias("told_similarity"),
        told("page_embedding_sha256").alias("told_vector"), told("page_vector_persisted").alias("told_persisted"), told("normalization").alias("told_normalization"),
    )


def evaluation_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether rules may be evaluated with a search's model and sources, and why not."""
    b = derived.rule_base(spark, d)
    asked = F.when(F.col("q10") % 3 == 0, _none()).otherwise(F.array(uuid_of(2, F.col("label") + F.col("q10") % 2)))
    filters = F.when(F.col("q10") % 8 == 0, F.array(F.lit("source:"))).otherwise(F.col("source_filters"))
    model = F.when(F.col("q10") % 5 == 0, "other").otherwise(F.col("model"))
    return b.select("alert_rule_id", match.evaluate_errors(model, F.col("model"), F.col("enabled"), asked, filters).alias("refused"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.table(spark, d, "events").where("event_type IN ('signup', 'error')").select(
        uuid_of(1, F.col("user_id") % 3).alias("tenant_id"), "event_id", F.col("event_type").alias("kind"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("owner"),
    )
    at = F.timestamp_seconds(F.col("event_id"))
    made = access.envelope(rows.where("kind = 'signup'"), "alert_rule.created", F.col("owner"), at)
    return made.unionByName(access.envelope(rows.where("kind = 'error'"), "source.created", None, at))


def event_envelopes(spark: SparkSession, d: str) -> DataFrame:
    told = lambda field: F.get_json_object("payload", f"$.{field}")
    return _events(spark, d).select(
        "tenant_id", "audience", "owner_subject", "event_type", F.unix_seconds("occurred_at").alias("occurred"), told("event_type").alias("told_type"),
        told("tenant_id").alias("told_tenant"), told("data.event_id").cast("bigint").alias("told_id"),
    )


def event_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """The envelopes as a stream, each to every subscriber that may see it."""
    root = scratch_path(spark, "fan-out")
    # Files of two batches, as many in each as a shuffle has tasks.
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _events(spark, d).repartition(2 * files, "payload").write.option("compression", "gzip").json(f"{root}/in")
    feed = spark.readStream.schema(schemas.struct("events_out")).option("maxFilesPerTrigger", files).json(f"{root}/in")
    reverse.fan_out(feed, derived.event_principals(spark, d), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    shown = ["event_type", F.get_json_object("payload", "$.data.event_id").cast("bigint").alias("event_id")]
    return reverse.received(spark, f"{root}/out", shown).select("subject", "event_type", "event_id")


def query_input_sets(spark: SparkSession, d: str) -> DataFrame:
    q = derived.query_texts(spark, d).select(
        uuid_of(1, F.col("conv_id") % 3).alias("tenant_id"), F.concat_ws("-", "conv_id", "turn").alias("subject"), "query_text"
    )
    sets = views.input_sets(q, "alert_rule_revision", "subject", "space-1", F.col("query_text"), text.query_inputs(F.col("query_text")), "query-views", "1")
    good, _ = audit.split_rows(sets, "semantic_input_sets")
    return good.select(
        "input_set_id", "tenant_id", "subject_id", "source_content_sha256", F.size("inputs").alias("inputs"), F.get_json_object("provenance", "$.inputs").cast("int").alias("told_inputs")
    )


def newest_listings(spark: SparkSession, d: str) -> DataFrame:
    """The newest pages, revisions and sources of each tenant, at most seven of each here."""
    show = lambda df, kind, key: df.select("tenant_id", F.lit(kind).alias("kind"), "rank", F.col(key).alias("id"))
    sources = derived.page_base(spark, d).groupBy("tenant_id", "source_id").agg(F.max("fetched_at").alias("created_at"))
    return (
        show(frontier.newest_pages(derived.pages(spark, d), 7), "page", "page_id")
        .unionByName(show(frontier.newest_revisions(derived.page_revisions(spark, d), 7), "revision", "revision_id"))
        .unionByName(show(rules.newest(sources, ["tenant_id"], "created_at", "source_id", 7), "source", "source_id"))
    )


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rule revisions written as JSON texts and read again under their schema."""
    back = schemas.from_json_rows(schemas.to_json_rows(derived.alert_rule_revisions(spark, d)), "alert_rule_revisions")
    return back.select(
        "revision_id", "name", "query_text", "revision_number", F.round(F.col("similarity_threshold").cast("double"), 6).alias("threshold"),
        F.array_join("source_filters", ",").alias("filters"), "enabled", F.unix_seconds("created_at").alias("created"),
    )


def page_vectors_stored(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that arrive twice, the second time reversed: the first of a revision and space stays, as do stored ones."""
    p = derived.page_base(spark, d)
    e = lambda v: F.struct("model", "model_version", "dimensions", "normalization", v.alias("values"))
    first = p.select(F.col("vec_id").alias("seq"), "tenant_id", "revision_id", "fetched_at", e(F.col("embedding")).alias("embedding"))
    again = p.select((F.col("vec_id") + 1_000_000).alias("seq"), "tenant_id", "revision_id", "fetched_at", e(F.reverse("embedding")).alias("embedding"))
    stored = derived.page_embeddings(spark, d).where(F.substring("revision_id", -6, 6).cast("int") % 7 == 0)
    new = pages.new_page_embeddings(first.unionByName(again), stored)
    return new.select("embedding_id", "revision_id", *SPACE, F.round(F.col("embedding")[0].cast("double"), 6).alias("first_value"))


def filter_syntax(spark: SparkSession, d: str) -> DataFrame:
    """Source filters in the spellings that are taken, and some that are not."""
    v = derived.table(spark, d, "embeddings").select("vec_id", uuid_of(2, F.col("vec_id") % 50).alias("u"))
    spelled = F.array(
        F.col("u"), F.concat(F.lit(" source:"), F.upper("u"), F.lit("\t")), F.concat(F.lit("{"), F.col("u"), F.lit("}")), F.concat(F.lit("source:urn:uuid:"), F.col("u")),
        F.replace("u", F.lit("-"), F.lit("")), F.concat(F.lit("source:"), F.substring("u", 2, 40)), F.lit(""), F.concat(F.col("u"), F.lit("}")),
    )
    one = F.element_at(spelled, (F.col("vec_id") % 8 + 1).cast("int"))
    filters = F.when(F.col("vec_id") % 100 == 1, F.array_repeat(one, 101)).otherwise(F.array(one, one))
    out = v.withColumn("filters", filters)
    return out.select(
        "vec_id", F.array_join(scope.filter_ids(F.col("filters")), ",").alias("ids"), F.array_join(scope.normalize_filters(F.col("filters")), ",").alias("normal"),
        scope.filter_error(F.col("filters")).alias("error"),
    )


def space_audit(spark: SparkSession, d: str) -> DataFrame:
    v = derived.table(spark, d, "embeddings").withColumn("n", F.col("vec_id"))
    spaces = v.select(
        "n", F.when(_every(11), "").otherwise("local").alias("provider"), F.when(_every(13), F.repeat(F.lit("m"), 257)).otherwise("m").alias("model"),
        F.when(_every(17), "v\u0001").otherwise("v1").alias("model_version"), F.when(_every(19), 40000).otherwise(64).alias("dimensions"),
        F.element_at(F.array(*[F.lit(x) for x in ("l2", "unit_length", "none")]), (F.col("n") % 3 + 1).cast("int")).alias("normalization"),
    )
    _, bad = audit.split_rows(spaces, "embedding_spaces")
    return bad.select("n", F.array_join("errors", ",").alias("errors"))


def revision_rows(spark: SparkSession, d: str) -> DataFrame:
    """New revisions as a listing shows them: an empty title is none, the excerpt has 600 characters at most."""
    arrived = pages.arrivals(derived.fetches(spark, d)).withColumn("title", F.when(F.col("seq") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), F.col("seq").cast("string"))))
    made = pages.new_revisions(pages.revision_chain(arrived))
    shown = rules.excerpts(made)
    return shown.select("page_id", "revision_id", "title", F.sha2("excerpt", 256).alias("excerpt_sha256"), F.char_length("excerpt").alias("excerpt_chars"))


def rules_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each page's fetch with the revision of its rule that was valid then; revisions of a rule follow each other every 50 minutes."""
    versions = derived.rule_base(spark, d).select("tenant_id", (F.col("q10") % 3).alias("topic"), F.col("revision_id").alias("rule_revision_id"), F.col("created_at").alias("valid_from"))
    until = F.lead("valid_from").over(Window.partitionBy("tenant_id", "topic").orderBy("valid_from"))
    versions = versions.withColumn("valid_to", until)
    p = derived.page_base(spark, d).select("tenant_id", "revision_id", "fetched_at")
    return intervals.held_by(p, versions, ["tenant_id"], "fetched_at", "valid_from", "valid_to").select("revision_id", "topic", "rule_revision_id")


def _views_of_queries(spark: SparkSession, d: str) -> DataFrame:
    q = alerting._queries(spark, d)
    n = F.substring("query_id", -6, 6).cast("int") / 10
    return q.select(
        "tenant_id", *SPACE, "vector", F.lit(-1.0).cast("float").alias("min_similarity"), "source_ids", F.col("query_id").alias("input_id"),
        (F.lit(0.5) + F.lit(0.25) * (n % 3)).alias("weight"), F.concat(F.lit("q"), (n % 4).cast("int").cast("string")).alias("query_id"),
    )


def multi_view_search(spark: SparkSession, d: str) -> DataFrame:
    """Four queries of many views each: the weighted mean and the best similarity of every page."""
    found = search.multi_view_totals(alerting._items(spark, d), _views_of_queries(spark, d))
    return found.select("query_id", "embedding_id", *[F.round(c, 6).alias(c) for c in ("mean_score", "best_score")])


def single_search(spark: SparkSession, d: str) -> DataFrame:
    """One query over two sources, as a page and the row after it."""
    one = alerting._queries(spark, d).where(F.col("query_id") == uuid_of(5, F.lit(10))).withColumn("source_ids", F.array(uuid_of(2, F.lit(1)), uuid_of(2, F.lit(2))))
    one = one.withColumn("min_similarity", F.lit(-1.0).cast("float"))
    found = search.search_one(alerting._items(spark, d), one, 5)
    return found.select("embedding_id", "source_id", "excerpt", F.round("similarity", 6).alias("similarity"), "fetched_at")


def feed_read(spark: SparkSession, d: str) -> DataFrame:
    """The page feed as JSON lines, every third without a limit of candidates: it gets the default."""
    path = scratch_path(spark, "feed")
    fetches, _ = alerting._feed(spark, d)
    fetches.withColumn("max_candidates", F.when(F.col("seq") % 3 > 0, F.col("max_candidates"))).write.json(path)
    back = schemas.read_feed(spark, path)
    return back.select("seq", "source_id", "final_url", "max_candidates", F.size("embedding.values").alias("dimensions"), F.unix_seconds("fetched_at").alias("fetched"))


def tables_written(spark: SparkSession, d: str) -> DataFrame:
    """Tables written in their layout and read again: one tenant's pages, and vectors of the model space."""
    root = scratch_path(spark, "tables")
    schemas.write_table(derived.pages(spark, d), root, "pages")
    schemas.write_table(derived.page_embeddings(spark, d), root, "page_embeddings")
    tenant = uuid_of(1, F.lit(1))
    p = access.in_tenant(schemas.read_table(spark, root, "pages"), tenant).select(F.lit("pages").alias("name"), F.col("page_id").alias("id"))
    e = schemas.read_table(spark, root, "page_embeddings").where("model_version = 'v1' AND dimensions > 1 AND normalization = 'unit_length'")
    return p.unionByName(access.in_tenant(e, tenant).select(F.lit("page_embeddings").alias("name"), F.col("embedding_id").alias("id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rule_revisions_created, rule_submissions_rejected, source_creation, page_requests_rejected, candidate_audit, provider_output, historical_candidates,
        score_explanations, evaluation_gates, event_envelopes, event_fan_out, query_input_sets, newest_listings, json_rows, page_vectors_stored, filter_syntax,
        space_audit, revision_rows, rules_as_of, multi_view_search, single_search, feed_read, tables_written,
    )
}
