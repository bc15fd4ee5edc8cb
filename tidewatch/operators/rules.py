"""Alert rules: submissions, activation under the owner's limit, and their vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope
from ..functions.ids import derived_uuid
from ..functions.text import collapse_whitespace, excerpt
from ..functions.urls import with_canonical_url
from ..functions.vectors import embedding_sha256, is_finite, is_valid
from . import audit

ACTIVE_LIMIT = 10
LISTING = 500
SPACE = ["model", "model_version", "dimensions", "normalization"]
_EDGE = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def normalized(submissions: DataFrame) -> DataFrame:
    """Submissions with trimmed texts and canonical, sorted, distinct lists."""
    channels = F.coalesce("delivery_channels", F.array().cast("array<string>"))
    filters = F.coalesce("source_filters", F.array().cast("array<string>"))
    return submissions.withColumns(
        {
            "name": trimmed(F.col("name")), "query_text": collapse_whitespace(F.col("query_text")),
            "embedding_model": trimmed(F.col("embedding_model")), "enabled": F.coalesce("enabled", F.lit(True)),
            "delivery_channels": F.array_sort(F.array_distinct(F.transform(channels, trimmed))),
            "source_filters": F.coalesce(scope.normalize_filters(filters), filters),
        }
    )


def rule_errors() -> Column:
    """Reasons why a normalised submission is refused; empty if it is not. Names and models are measured in bytes."""
    channels = F.col("delivery_channels")
    checks = {
        "name": ~F.octet_length("name").between(1, 256),
        "query_text": ~F.char_length("query_text").between(3, 700),
        "embedding_model": ~F.octet_length("embedding_model").between(1, 160),
        "similarity_threshold": ~(is_finite(F.col("similarity_threshold")) & F.col("similarity_threshold").between(0, 1)),
        "delivery_channels": (F.size(channels) > 32) | ~F.forall(channels, lambda x: F.octet_length(x).between(1, 120)),
    }
    flags = [F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in checks.items()]
    return F.filter(F.array(*flags, scope.filter_error(F.col("source_filters"))), lambda x: x.isNotNull())


def create_rules(submissions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, revisions, rejected) from submissions with seq, tenant_id and owner_subject.

    Revision numbers count a rule's submissions: those that share tenant, owner and
    ``rule_ref`` are one rule. The limit of active rules is applied by ``admit_activations``.
    """
    checked = normalized(submissions).withColumn("errors", rule_errors())
    good = checked.where(F.size("errors") == 0)
    rule = derived_uuid(F.lit("rule"), F.col("tenant_id"), F.col("owner_subject"), F.col("rule_ref"))
    per_rule = Window.partitionBy("tenant_id", "alert_rule_id").orderBy("seq")
    good = good.withColumn("alert_rule_id", rule).withColumn("revision_number", F.row_number().over(per_rule))
    good = good.withColumn("revision_id", derived_uuid(F.lit("rule_revision"), F.col("alert_rule_id"), F.col("revision_number")))
    revisions = good.select(
        "revision_id", "tenant_id", "alert_rule_id", F.col("owner_subject").alias("created_by_subject"), "name", "query_text",
        "embedding_model", "revision_number", F.col("similarity_threshold").cast("float"), "source_filters", "delivery_channels",
        "enabled", at.alias("created_at"),
    )
    rules = good.groupBy("alert_rule_id", "tenant_id", "owner_subject").agg(
        F.max_by("revision_id", "revision_number").alias("active_revision_id")
    ).select("*", at.alias("created_at"), at.alias("updated_at"))
    return rules, revisions, checked.where(F.size("errors") > 0)


def active_counts(rules: DataFrame, revisions: DataFrame) -> DataFrame:
    """Enabled active rules of each owner."""
    v = revisions.select("tenant_id", F.col("revision_id").alias("active_revision_id"), "enabled")
    return rules.join(v, ["tenant_id", "active_revision_id"]).where("enabled").groupBy("tenant_id", "owner_subject").agg(F.count("*").alias("active_rules"))


def admit_activations(enables: DataFrame, limit: int = ACTIVE_LIMIT) -> DataFrame:
    """First enables of each rule with ``admitted``: the first ``limit`` of an owner in order of seq.

    For logs without disables. An owner's window holds one row a rule.
    """
    first = enables.groupBy("tenant_id", "owner_subject", "alert_rule_id").agg(F.min("seq").alias("seq"))
    owner = Window.partitionBy("tenant_id", "owner_subject").orderBy("seq", "alert_rule_id")
    return first.withColumn("nth", F.row_number().over(owner)).withColumn("admitted", F.col("nth") <= limit)


LOG = ["tenant_id", "owner_subject", "alert_rule_id", "seq", "enable"]


def _fold_batches(limit: int):
    """Rows that come sorted by owner and order, with whether each is admitted; only the owner's active rules are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner: tuple | None = None
        active: set = set()
        for batch in batches:
            admitted = []
            for tenant, subject, rule, enable in zip(*(batch.column(c).to_pylist() for c in ("tenant_id", "owner_subject", "alert_rule_id", "enable")), strict=True):
                if (tenant, subject) != owner:
                    owner, active = (tenant, subject), set()
                fits = not enable or rule in active or len(active) < limit
                if enable and fits:
                    active.add(rule)
                elif not enable:
                    active.discard(rule)
                admitted.append(fits)
            yield pa.record_batch([*batch.columns, pa.array(admitted, pa.bool_())], names=[*batch.schema.names, "admitted"])

    return run


def admit_activation_log(log: DataFrame, limit: int = ACTIVE_LIMIT) -> DataFrame:
    """A log of enables and disables with ``admitted``, folded in order for each owner.

    A disable frees a place, so no window can tell: each owner's log passes one
    task in order, which holds ``limit`` rules of it at most, and owners are spread
    over all tasks.
    """
    dealt = log.select(*LOG).repartition("tenant_id", "owner_subject").sortWithinPartitions("tenant_id", "owner_subject", "seq", "alert_rule_id")
    return dealt.mapInArrow(
        _fold_batches(limit), "tenant_id string, owner_subject string, alert_rule_id string, seq bigint, enable boolean, admitted boolean"
    )


def upsert_rule_embeddings(
    requests: DataFrame, rules: DataFrame, revisions: DataFrame, stored: DataFrame, at: Column
) -> DataFrame:
    """Requests with ``outcome``: created, existing, conflict, wrong_target or invalid_vector.

    A vector must target the enabled active revision of its rule and that revision's
    model. Stored vectors never change: the same hash is existing, another a
    conflict. Among requests for one space the first in seq creates.
    """
    target = rules.select("tenant_id", "alert_rule_id", F.col("active_revision_id").alias("alert_rule_revision_id")).join(
        revisions.select("tenant_id", "alert_rule_id", F.col("revision_id").alias("alert_rule_revision_id"), "enabled", "embedding_model"),
        ["tenant_id", "alert_rule_id", "alert_rule_revision_id"],
    ).where("enabled").select("tenant_id", "alert_rule_id", "alert_rule_revision_id", F.col("embedding_model").alias("model"), F.lit(True).alias("is_target"))
    key = ["tenant_id", "alert_rule_revision_id", *SPACE]
    out = requests.withColumn("embedding_sha256", embedding_sha256(F.col("embedding"))).withColumn(
        "valid", is_valid(F.col("embedding"), F.col("dimensions"))
    )
    out = out.join(target, ["tenant_id", "alert_rule_id", "alert_rule_revision_id", "model"], "left")
    usable = F.col("valid") & F.coalesce("is_target", F.lit(False))
    old = stored.select(*key, F.col("embedding_sha256").alias("stored_sha256"))
    out = out.join(old, key, "left")
    turn = Window.partitionBy(*key, usable).orderBy("seq")
    holder = F.coalesce(F.col("stored_sha256"), F.first("embedding_sha256").over(turn))
    first = F.row_number().over(turn) == 1
    outcome = (
        F.when(~F.col("valid"), "invalid_vector").when(~usable, "wrong_target")
        .when(F.col("stored_sha256").isNull() & first, "created")
        .when(F.col("embedding_sha256") == holder, "existing").otherwise("conflict")
    )
    return out.select(
        "seq", derived_uuid(F.lit("rule_embedding"), *[F.col(c) for c in key]).alias("alert_embedding_id"), *key, "alert_rule_id",
        "embedding", "embedding_sha256", at.alias("generated_at"), outcome.alias("outcome"),
    )


def listing(rules: DataFrame, revisions: DataFrame) -> DataFrame:
    """What a rule shows: its identity and its active revision."""
    v = revisions.select(
        "tenant_id", "alert_rule_id", F.col("revision_id").alias("active_revision_id"), "revision_number", "name", "query_text",
        "embedding_model", "similarity_threshold", "source_filters", "delivery_channels", "enabled", "created_by_subject",
    )
    return rules.join(v, ["tenant_id", "alert_rule_id", "active_revision_id"])


def newest(rows: DataFrame, group: list[str], order: str, key: str, limit: int = LISTING) -> DataFrame:
    """The newest rows of each group, ties by key."""
    w = Window.partitionBy(*group).orderBy(F.desc(order), F.asc(key))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def create_sources(submissions: DataFrame, stored: DataFrame, at: Column) -> DataFrame:
    """Source submissions with canonical root and ``outcome``: created, conflict or rejected, and why.

    A root URL occurs once in a tenant; the first in seq takes it.
    """
    policy = (F.col("allowed_hosts"), F.col("include_subdomains"), F.col("allowed_path_prefixes"))
    out = with_canonical_url(submissions, "root", F.col("root_url"), *policy).withColumn(
        "reason", F.coalesce(F.col("root.reject_reason"), F.get(audit.errors_of("sources"), F.lit(0)))
    )
    taken = stored.select("tenant_id", F.col("root_url").alias("canonical_root")).distinct().withColumn("taken", F.lit(True))
    out = out.withColumn("canonical_root", F.col("root.canonical")).join(taken, ["tenant_id", "canonical_root"], "left")
    turn = Window.partitionBy("tenant_id", "canonical_root", F.col("reason").isNull()).orderBy("seq")
    outcome = (
        F.when(F.col("reason").isNotNull(), "rejected")
        .when(F.col("taken").isNull() & (F.row_number().over(turn) == 1), "created").otherwise("conflict")
    )
    return out.select(
        "seq", derived_uuid(F.lit("source"), F.col("tenant_id"), F.col("canonical_root")).alias("source_id"), "tenant_id", "name",
        F.coalesce("canonical_root", "root_url").alias("root_url"), outcome.alias("outcome"), "reason", at.alias("created_at"),
    )


def excerpts(revisions: DataFrame) -> DataFrame:
    """Revisions as a listing shows them, newest first by fetched_at."""
    return revisions.select("tenant_id", "page_id", "revision_id", "title", excerpt(F.col("content_text")).alias("excerpt"), "fetched_at")

