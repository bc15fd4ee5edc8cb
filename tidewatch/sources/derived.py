"""Tables of the alerting engine derived from the given test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import derived_uuid, uuid_of

MODEL, NORMALIZATION = "test-embedding-model", "unit_length"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it has fewer input splits than there are cores: heavy expressions need them all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", F.floor(F.col("vec_id") / 10).cast("bigint").alias("q10"), "label", F.col("embedding").cast("array<float>").alias("embedding"),
        F.size("embedding").alias("dimensions"), F.lit(MODEL).alias("model"), F.lit(NORMALIZATION).alias("normalization"),
    )


def rule_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth vector is a rule's."""
    v = _vectors(spark, sf_dir).where(F.col("vec_id") % 10 == 0)
    return v.select(
        "*", uuid_of(1, F.col("q10") % 3).alias("tenant_id"), F.concat(F.lit("user-"), (F.col("q10") % 7).cast("string")).alias("owner_subject"),
        F.when(F.col("vec_id") % 70 == 0, "v2").otherwise("v1").alias("model_version"), (F.col("vec_id") % 90 != 0).alias("enabled"),
        F.when(F.col("vec_id") % 40 == 0, F.array(F.concat(F.lit("source:"), uuid_of(2, F.col("label")))))
        .otherwise(F.array().cast("array<string>")).alias("source_filters"),
        (F.lit(0.20) + F.lit(0.01) * (F.col("q10") % 10)).cast("float").alias("similarity_threshold"),
        uuid_of(3, F.col("q10")).alias("alert_rule_id"), uuid_of(4, F.col("q10")).alias("revision_id"), uuid_of(5, F.col("vec_id")).alias("alert_embedding_id"),
        F.timestamp_seconds(F.col("vec_id") * 60).alias("created_at"),
    )


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_base(spark, sf_dir).select(
        "alert_rule_id", "tenant_id", "owner_subject", F.col("revision_id").alias("active_revision_id"), "created_at", F.col("created_at").alias("updated_at")
    )


def alert_rule_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_base(spark, sf_dir).select(
        "revision_id", "tenant_id", "alert_rule_id", F.col("owner_subject").alias("created_by_subject"),
        F.concat(F.lit("rule "), F.col("q10").cast("string")).alias("name"), F.concat(F.lit("watch topic "), F.col("q10").cast("string")).alias("query_text"),
        F.col("model").alias("embedding_model"), F.lit(1).alias("revision_number"), "similarity_threshold", "source_filters",
        F.array(F.lit("in_app")).alias("delivery_channels"), "enabled", "created_at",
    )


def alert_rule_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_base(spark, sf_dir).select(
        "alert_embedding_id", "tenant_id", "alert_rule_id", F.col("revision_id").alias("alert_rule_revision_id"), "model", "model_version",
        "normalization", "dimensions", "embedding", F.col("created_at").alias("generated_at"),
    )


def page_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other vectors are pages'."""
    v = _vectors(spark, sf_dir).where(F.col("vec_id") % 10 != 0)
    return v.select(
        "*", uuid_of(1, F.col("vec_id") % 3).alias("tenant_id"), uuid_of(2, F.col("label")).alias("source_id"), F.lit("v1").alias("model_version"),
        uuid_of(6, F.col("vec_id")).alias("page_id"), uuid_of(7, F.col("vec_id")).alias("revision_id"), uuid_of(8, F.col("vec_id")).alias("embedding_id"),
        F.sha2(F.concat(F.lit("content-"), F.col("vec_id").cast("string")), 256).alias("content_sha256"),
        F.concat(F.lit("https://pages.example.com/"), F.col("vec_id").cast("string")).alias("canonical_url"),
        F.timestamp_seconds(F.col("vec_id") * 60).alias("fetched_at"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_base(spark, sf_dir).select(
        "page_id", "tenant_id", "source_id", "canonical_url", F.col("revision_id").alias("latest_revision_id"),
        F.col("fetched_at").alias("first_seen_at"), F.col("fetched_at").alias("last_seen_at"),
    )


def page_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_base(spark, sf_dir).select(
        "revision_id", "tenant_id", "page_id", F.lit(None).cast("string").alias("predecessor_revision_id"), F.col("canonical_url").alias("original_url"),
        F.col("canonical_url").alias("final_url"), F.lit(None).cast("string").alias("title"),
        F.concat(F.lit("content "), F.col("vec_id").cast("string")).alias("content_text"), "content_sha256", F.lit("text/html").alias("content_type"),
        F.lit(200).cast("smallint").alias("http_status"), F.lit(None).cast("timestamp").alias("published_at"), "fetched_at",
    )


def page_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_base(spark, sf_dir).select(
        "embedding_id", "tenant_id", "revision_id", "model", "model_version", "normalization", "dimensions", "embedding", F.col("fetched_at").alias("generated_at")
    )


def page_vectors(spark: SparkSession, sf_dir: str, max_candidates: int) -> DataFrame:
    """Pages as the reverse match takes them."""
    return page_base(spark, sf_dir).select(
        F.col("revision_id").alias("page_key"), "tenant_id", "source_id", "model", "model_version", "dimensions", "normalization",
        F.col("embedding").alias("page_vector"), F.lit(max_candidates).alias("max_candidates"), "content_sha256", "canonical_url", "fetched_at",
    )


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken in twice over a fifth as many pages: the second pass brings nothing new."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    page = F.col("doc_id") % max(n // 5, 1)
    url = F.concat(F.lit("https://docs.example.com/p/"), page.cast("string"))
    one = docs.select("doc_id", "text", F.col("doc_id").alias("seq"), url.alias("canonical_url"), uuid_of(2, page % 7).alias("source_id"))
    two = one.withColumn("seq", F.col("doc_id") + n)
    return one.unionByName(two).select(
        "seq", uuid_of(1, F.lit(0)).alias("tenant_id"), "source_id", F.col("canonical_url").alias("original_canonical_url"), "canonical_url",
        F.lit("").alias("title"), F.col("text").alias("content_text"), F.lit("text/html").alias("content_type"),
        F.lit(200).cast("smallint").alias("http_status"), F.lit(None).cast("timestamp").alias("published_at"),
        F.timestamp_seconds(F.col("seq") * 60).alias("fetched_at"),
    )


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query_text"))


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of enables and disables of rules by their owners, in order of time."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    return e.select(
        uuid_of(1, F.col("user_id") % 3).alias("tenant_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("owner_subject"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 20).cast("string")).alias("alert_rule_id"),
        (F.col("event_type") != "error").alias("enable"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), "ts", "event_id",
    )


def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", uuid_of(1, F.col("user_id") % 3).alias("tenant_id"), F.when(F.col("event_type") == "error", "admins").otherwise("owner_or_admins").alias("audience"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("owner_subject"), "event_type",
    )


def event_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users of the events; every fiftieth is an admin of its tenant."""
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    return e.select(
        uuid_of(1, F.col("user_id") % 3).alias("tenant_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("subject"),
        (F.col("user_id") % 50 == 0).alias("is_tenant_admin"),
    )


def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[^:]+://([^/?#]+)", 1)
    n = F.col("page_id")
    return p.select(
        uuid_of(1, F.lit(0)).alias("tenant_id"), derived_uuid(F.lit("source"), host).alias("source_id"), "url",
        F.regexp_replace("url", "#.*$", "").alias("canonical_url"), F.lit("sitemap").alias("discovered_by"), (n % 5).cast("smallint").alias("depth"),
        F.element_at(F.array(*[F.lit(s) for s in ("pending", "failed", "fetched", "leased")]), (n % 4 + 1).cast("int")).alias("status"),
        (n % 3).cast("int").alias("priority"), F.timestamp_seconds((n % 10) * 3600).alias("next_attempt_at"), F.lit(0).alias("attempt_count"),
        F.timestamp_seconds(n * 60).alias("created_at"),
    )


def crawl_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[^:]+://([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select(host.alias("host")).distinct().select(
        uuid_of(1, F.lit(0)).alias("tenant_id"), derived_uuid(F.lit("source"), F.col("host")).alias("source_id"), (~F.endswith(F.col("host"), F.lit(".net"))).alias("enabled"),
        F.lit(3).alias("max_depth"), F.lit(5).alias("max_pages_per_run"), "host",
    )
