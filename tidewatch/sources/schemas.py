"""Declared schemas of all tables; every read names one, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDING = "model string, model_version string, dimensions int, normalization string, values array<float>"

SCHEMAS: dict[str, str] = {
    "sources": """tenant_id string, source_id string, name string, root_url string, allowed_hosts array<string>,
        allowed_path_prefixes array<string>, discovery_modes array<string>, include_subdomains boolean,
        obey_robots boolean, enabled boolean, crawl_interval_seconds int, max_depth smallint, max_pages_per_run int,
        created_at timestamp, updated_at timestamp""",
    "fetches": f"""seq bigint, tenant_id string, source_id string, url string, final_url string, title string,
        content_text string, content_type string, http_status smallint, published_at timestamp, fetched_at timestamp,
        embedding struct<{", ".join(p.replace(" ", ": ", 1) for p in EMBEDDING.split(", "))}>, max_candidates smallint""",
    "pages": """page_id string, tenant_id string, source_id string, canonical_url string, latest_revision_id string,
        first_seen_at timestamp, last_seen_at timestamp""",
    "page_revisions": """revision_id string, tenant_id string, page_id string, predecessor_revision_id string,
        original_url string, final_url string, title string, content_text string, content_sha256 string,
        content_type string, http_status smallint, published_at timestamp, fetched_at timestamp""",
    "page_embeddings": """embedding_id string, tenant_id string, revision_id string, model string, model_version string,
        normalization string, dimensions int, embedding array<float>, generated_at timestamp""",
    "alert_rules": """alert_rule_id string, tenant_id string, owner_subject string, active_revision_id string,
        created_at timestamp, updated_at timestamp""",
    "alert_rule_revisions": """revision_id string, tenant_id string, alert_rule_id string, created_by_subject string,
        name string, query_text string, embedding_model string, revision_number int, similarity_threshold float,
        source_filters array<string>, delivery_channels array<string>, enabled boolean, created_at timestamp""",
    "alert_rule_embeddings": """alert_embedding_id string, tenant_id string, alert_rule_id string,
        alert_rule_revision_id string, model string, model_version string, normalization string, embedding_sha256 string,
        dimensions int, embedding array<float>, generated_at timestamp""",
    "match_candidates": """candidate_id string, tenant_id string, alert_rule_id string, alert_rule_revision_id string,
        revision_id string, embedding_id string, match_mode string, alert_embedding_id string,
        page_embedding_sha256 string, page_embedding_model string, page_embedding_model_version string,
        page_embedding_normalization string, page_embedding_dimensions int, canonical_match_key string, status string,
        score_explanation string, similarity double, threshold double, created_at timestamp, updated_at timestamp""",
    "semantic_input_sets": """input_set_id string, tenant_id string, subject_kind string, subject_id string,
        embedding_space_id string, extractor_name string, extractor_version string, source_content_sha256 string,
        provenance string, created_at timestamp""",
    "semantic_inputs": """input_id string, tenant_id string, input_set_id string, kind string, ordinal int, text string,
        text_sha256 string, weight float""",
    "semantic_input_vectors": """tenant_id string, input_id string, model string, model_version string,
        normalization string, dimensions int, embedding array<float>, generated_at timestamp""",
    "crawl_queue": """tenant_id string, source_id string, url string, canonical_url string, discovered_by string, depth smallint,
        status string, priority int, next_attempt_at timestamp, attempt_count int, last_error string, created_at timestamp,
        updated_at timestamp""",
    "principals": "tenant_id string, subject string, roles array<string>, is_tenant_admin boolean",
    "events_out": """tenant_id string, audience string, owner_subject string, event_type string, payload string,
        occurred_at timestamp""",
}

#: Columns by which a table is laid out, so that scans prune to a tenant or a model space.
PARTITIONS = {
    "pages": ["tenant_id"], "page_revisions": ["tenant_id"],
    "page_embeddings": ["model", "model_version", "dimensions", "normalization"], "crawl_queue": ["status"],
}

#: Keys of the tables: what may occur once only.
KEYS = {
    "sources": ["tenant_id", "root_url"], "crawl_queue": ["tenant_id", "source_id", "canonical_url"],
    "pages": ["tenant_id", "source_id", "canonical_url"], "page_revisions": ["tenant_id", "page_id", "content_sha256"],
    "page_embeddings": ["tenant_id", "revision_id", "model", "model_version", "dimensions", "normalization"],
    "match_candidates": ["tenant_id", "canonical_match_key"],
    "semantic_input_sets": ["tenant_id", "subject_kind", "subject_id", "embedding_space_id", "extractor_name", "extractor_version", "source_content_sha256"],
    "semantic_inputs": ["input_set_id", "ordinal"],
    "semantic_input_vectors": ["input_id", "model", "model_version", "dimensions", "normalization"],
    "alert_rule_revisions": ["tenant_id", "alert_rule_id", "revision_number"],
    "alert_rule_embeddings": ["tenant_id", "alert_rule_revision_id", "model", "model_version", "dimensions", "normalization"],
}

#: (child, columns, parent, columns): references that have to exist.
REFERENCES = [
    ("pages", ["tenant_id", "source_id"], "sources", ["tenant_id", "source_id"]),
    ("crawl_queue", ["tenant_id", "source_id"], "sources", ["tenant_id", "source_id"]),
    ("page_revisions", ["tenant_id", "page_id"], "pages", ["tenant_id", "page_id"]),
    ("page_embeddings", ["tenant_id", "revision_id"], "page_revisions", ["tenant_id", "revision_id"]),
    ("alert_rule_revisions", ["tenant_id", "alert_rule_id"], "alert_rules", ["tenant_id", "alert_rule_id"]),
    ("alert_rules", ["tenant_id", "active_revision_id"], "alert_rule_revisions", ["tenant_id", "revision_id"]),
    ("alert_rule_embeddings", ["tenant_id", "alert_rule_revision_id"], "alert_rule_revisions", ["tenant_id", "revision_id"]),
    ("match_candidates", ["tenant_id", "revision_id"], "page_revisions", ["tenant_id", "revision_id"]),
    ("match_candidates", ["tenant_id", "alert_rule_revision_id"], "alert_rule_revisions", ["tenant_id", "revision_id"]),
]


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(struct(table)).parquet(f"{root}/{table}")


def write_table(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Write in the declared column order and layout."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in struct(table)]).write.mode(mode).partitionBy(
        *PARTITIONS.get(table, [])
    ).parquet(f"{root}/{table}")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A page feed of JSON lines; a missing candidate limit is 100."""
    return with_defaults(spark.read.schema(struct("fetches")).json(path))


def stream_feed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(struct("fetches"))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_defaults(reader.json(path))


def with_defaults(feed: DataFrame) -> DataFrame:
    return feed.withColumn("max_candidates", F.coalesce("max_candidates", F.lit(100).cast("smallint")))


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*")).alias("data"))


def from_json_rows(df: DataFrame, table: str) -> DataFrame:
    return df.select(F.from_json("data", struct(table)).alias("r")).select("r.*")


def missing_columns(df: DataFrame, table: str) -> DataFrame:
    """(table, column, declared, found) where a table does not keep to its schema; no rows if it does."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [
        (table, f.name, f.dataType.simpleString(), have.get(f.name))
        for f in struct(table)
        if have.get(f.name) != f.dataType.simpleString()
    ]
    return df.sparkSession.createDataFrame(wrong, "table string, column string, declared string, found string")
