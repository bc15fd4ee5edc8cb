"""Matching of pages and alert rules, in both directions, and idempotent candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scope
from ..functions.ids import derived_uuid, match_key
from ..functions.vectors import cosine_similarity, is_finite, norm
from . import product, search

SPACE = ["model", "model_version", "dimensions", "normalization"]
MAX_CANDIDATES = 500


def active_rules(rules: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rules with the fields of their active revision, where that is enabled."""
    v = revisions.select(
        "tenant_id", "alert_rule_id", F.col("revision_id").alias("active_revision_id"), "name", "query_text", "embedding_model",
        "similarity_threshold", "source_filters", "delivery_channels", "enabled",
    )
    return rules.select("tenant_id", "alert_rule_id", "owner_subject", "active_revision_id").join(
        v, ["tenant_id", "alert_rule_id", "active_revision_id"]
    ).where("enabled")


def rule_vectors(rules: DataFrame, revisions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Vectors that may match: of the active, enabled revision and its own model."""
    a = active_rules(rules, revisions).select(
        "tenant_id", "alert_rule_id", F.col("active_revision_id").alias("alert_rule_revision_id"), "owner_subject",
        "similarity_threshold", "source_filters", F.col("embedding_model").alias("model"),
    )
    e = embeddings.select("tenant_id", "alert_rule_id", "alert_rule_revision_id", "alert_embedding_id", *SPACE, F.col("embedding").alias("rule_vector"))
    return e.join(a, ["tenant_id", "alert_rule_id", "alert_rule_revision_id", "model"])


def _ranked(pairs: DataFrame, key: str) -> DataFrame:
    """The nearest rules of each page, at most as many as it asks for.

    The first limit is a plain number, so that tasks cut their own rows before
    the shuffle; a page's own limit follows.
    """
    order = Window.partitionBy(key).orderBy("distance", "alert_embedding_id")
    top = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_CANDIDATES)
    return top.where(F.col("rank") <= F.col("max_candidates"))


def _admitted_pairs(met: DataFrame, key: str) -> DataFrame:
    """Ranked pairs of pages and rules that meet: the rule admits the source and the exact similarity reaches its threshold."""
    pairs = met.where(scope.admits(F.col("source_filters"), F.col("source_id"))).select(
        key, "tenant_id", "source_id", "max_candidates", *SPACE, "alert_rule_id", "alert_rule_revision_id", "alert_embedding_id",
        F.col("similarity_threshold").cast("double").alias("threshold"), cosine_similarity(F.col("page_vector"), F.col("rule_vector")).alias("similarity"),
    )
    pairs = pairs.where(is_finite(F.col("similarity")) & (F.col("similarity") >= F.col("threshold")))
    return _ranked(pairs.withColumn("distance", 1.0 - F.col("similarity")), key)


RULE = ["alert_embedding_id", "alert_rule_id", "alert_rule_revision_id", "similarity_threshold", "source_filters", "rule_vector"]


def sides(pages: DataFrame, rules: DataFrame, key: str = "page_key") -> tuple[DataFrame, DataFrame]:
    """Pages and rules as the two sides of a product: pages choose, rules have a floor and sources."""
    space = ["tenant_id", *SPACE]
    asked = F.when(F.col("max_candidates").isNull(), 0).otherwise(F.least(F.col("max_candidates").cast("int"), F.lit(MAX_CANDIDATES)))
    left = pages.select(*space, F.col(key).alias("l"), F.col("page_vector").alias("v"), F.concat(F.lit(scope.PREFIX), F.col("source_id")).alias("tag"), asked.alias("k"))
    right = rules.select(
        *space, F.col("alert_embedding_id").alias("r"), F.col("rule_vector").alias("v"), F.col("similarity_threshold").alias("floor"), F.col("source_filters").alias("tags")
    )
    return left, right


def reverse_match(
    pages: DataFrame, rules: DataFrame, key: str = "page_key", block_bytes: int = product.BLOCK_BYTES, pairs: Callable[..., DataFrame] = product.near_pairs
) -> DataFrame:
    """Each page vector against all rule vectors of its tenant and model space.

    ``pages`` has ``key``, tenant_id, source_id, the model space, page_vector and
    max_candidates; ``rules`` as from ``rule_vectors``. A pair counts if the rule
    admits the source and the similarity is a finite number that reaches the
    rule's own single-precision threshold; only then is the nearest kept. Blocks of
    pages and rules are multiplied and propose as many rules a page as it asks for;
    ``metric.near_pairs`` as ``pairs`` leaves out blocks that thresholds can't reach.
    Vectors are fetched for what is left of all blocks, and the exact expression decides.
    """
    left, right = sides(pages, rules, key)
    near = product.nearest(pairs(left, right, ["tenant_id", *SPACE], block_bytes, "l"), "l")
    near = near.select(F.col("l").alias(key), F.col("r").alias("alert_embedding_id"))
    return _admitted_pairs(near.join(rules.select(*RULE), "alert_embedding_id").join(pages, key), key)


#: Components of vectors that a join holds as columns of their own; further ones stay in an array.
COLUMNS = 64
#: Bytes of vectors in a block of either side of the join.
JOINED_BYTES = 1 << 20


def _in_columns(vector: str, norm_as: str, n: int) -> list[Column]:
    """The length of a vector, its first ``n`` components as columns that are never null, and the rest."""
    v = F.col(vector)
    double = lambda i: F.coalesce(F.get(v, F.lit(i)).cast("double"), F.lit(0.0)).alias(f"{norm_as}{i}")
    return [norm(v).alias(norm_as), *[double(i) for i in range(n)], F.slice(v, n + 1, F.greatest(F.size(v) - n, F.lit(0))).alias(f"{norm_as}_rest")]


def reverse_match_join(pages: DataFrame, rules: DataFrame, key: str = "page_key") -> DataFrame:
    """``reverse_match`` as one join: every pair of a space is computed by expressions alone.

    Both sides are cut into blocks as for the product, so that a large space is many
    tasks' work. The first ``COLUMNS`` components are columns, whose sum of products Spark
    compiles, and each pair's is computed once in the join, in order, to the last bit as by
    ``cosine_similarity``; shorter vectors end in zeros, longer ones go on with an array.
    ``key`` and alert_embedding_id tell rows apart.
    """
    space = ["tenant_id", *SPACE, "_size"]
    whole = lambda v: F.forall(v, lambda x: x.isNotNull())
    left = pages.withColumn("_size", F.size("page_vector")).where(whole("page_vector"))
    right = rules.select("tenant_id", *SPACE, *RULE).withColumn("_size", F.size("rule_vector")).where(whole("rule_vector"))
    most = right.agg(F.max("_size")).first()[0] or 0
    n = min(most, COLUMNS)
    page = ["source_id", "max_candidates", *_in_columns("page_vector", "_p", n)]
    rule = [*[c for c in RULE if c not in ("alert_embedding_id", "rule_vector")], *_in_columns("rule_vector", "_r", n)]
    a, b = product.blocks(left, right, space, key, "alert_embedding_id", JOINED_BYTES)
    group = [*space, "row", "column"]
    a = a.select(*group, key, F.concat(F.lit(scope.PREFIX), F.col("source_id")).alias("_tag"), *page).where("_p > 0")
    b = b.select(*group, "alert_embedding_id", F.col("similarity_threshold").cast("double").alias("threshold"), *rule).where("_r > 0")
    dot = F.lit(0.0)
    for i in range(n):
        dot = dot + F.col(f"_p{i}") * F.col(f"_r{i}")
    if most > n:
        rest = F.zip_with(F.col("_p_rest").cast("array<double>"), F.col("_r_rest").cast("array<double>"), lambda x, y: x * y)
        dot = F.aggregate(rest, dot, lambda s, x: s + x)
    scale = F.col("_p") * F.col("_r")
    x, y = a.alias("x"), b.alias("y")
    same = F.lit(True)
    for c in group:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    admitted = (F.size("source_filters") == 0) | F.array_contains("source_filters", F.col("_tag"))
    # A little less than the threshold: the quotient decides, after the ranking, lest the sum is computed for each condition again.
    pairs = x.join(y, same & (dot >= (F.col("threshold") - product.HAIR) * scale) & admitted).select(
        key, "x.tenant_id", "source_id", "max_candidates", *[f"x.{c}" for c in SPACE], "alert_rule_id", "alert_rule_revision_id", "alert_embedding_id", "threshold",
        (dot / scale).alias("similarity"),
    )
    reaches = is_finite(F.col("similarity")) & (F.col("similarity") >= F.col("threshold"))
    order = Window.partitionBy(key).orderBy(F.coalesce(reaches, F.lit(False)).desc(), "distance", "alert_embedding_id")
    top = pairs.withColumn("distance", 1.0 - F.col("similarity")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_CANDIDATES)
    return top.where((F.col("rank") <= F.col("max_candidates")) & reaches)


def historical_match(items: DataFrame, rules: DataFrame, limit: int, requested_threshold: float = 0.0) -> DataFrame:
    """Every active rule against stored pages: its ``limit`` nearest hits.

    ``items`` as from ``search.searchable``, ``rules`` as from ``rule_vectors``. A
    request can raise a rule's threshold, not lower it; the floor is that threshold
    in single precision while ``threshold`` records it in double.
    """
    ids = scope.filter_ids(F.col("source_filters"))
    threshold = F.greatest(F.lit(float(requested_threshold)), F.col("similarity_threshold").cast("double"))
    queries = rules.select(
        F.col("alert_embedding_id").alias("query_id"), "tenant_id", *SPACE, F.col("rule_vector").alias("vector"),
        threshold.cast("float").alias("min_similarity"), ids.alias("source_ids"),
    )
    hits = search.search_many(items, queries, limit)
    r = rules.select(
        F.col("alert_embedding_id").alias("query_id"), "tenant_id", "alert_rule_id", "alert_rule_revision_id", threshold.alias("threshold")
    )
    return hits.join(r, "query_id")


def evaluate_errors(search_model: Column, rule_model: Column, enabled: Column, requested: Column, rule_filters: Column) -> Column:
    """Why an evaluation of a rule is refused, null if it is not."""
    return (
        F.when(~F.coalesce(enabled, F.lit(False)), "rule_disabled")
        .when(~F.coalesce(search_model == rule_model, F.lit(False)), "model_mismatch")
        .when(scope.filter_ids(rule_filters).isNull(), "invalid_rule_filter")
        .when(scope.constrain(scope.filter_ids(rule_filters), requested).isNull(), "outside_rule_scope")
    )


def _explanation(shape: str) -> Column:
    common = [
        F.col("similarity").alias("semantic_similarity"), "threshold", "alert_rule_revision_id",
        F.col("revision_id").alias("page_revision_id"), *SPACE, "canonical_url", "content_sha256",
    ]
    if shape == "historical":
        return F.to_json(F.struct(*common))
    return F.to_json(
        F.struct(F.lit("reverse_alert_stream").alias("match_mode"), *common, "page_embedding_sha256", F.lit(False).alias("page_vector_persisted"))
    )


def _candidate(rows: DataFrame, mode: str, at: Column) -> DataFrame:
    key = match_key(*[F.col(c) for c in ("tenant_id", "alert_rule_id", "alert_rule_revision_id", "revision_id", "content_sha256", *SPACE)])
    rows = rows.withColumn("canonical_match_key", key)
    reverse = mode == "reverse_alert_stream"
    none = F.lit(None)
    only = lambda c, kind="string": (F.col(c) if reverse else none).cast(kind)
    return rows.select(
        derived_uuid(F.lit("candidate"), F.col("tenant_id"), F.col("canonical_match_key")).alias("candidate_id"), "tenant_id",
        "alert_rule_id", "alert_rule_revision_id", "revision_id",
        (none if reverse else F.col("embedding_id")).cast("string").alias("embedding_id"), F.lit(mode).alias("match_mode"),
        only("alert_embedding_id").alias("alert_embedding_id"), only("page_embedding_sha256").alias("page_embedding_sha256"),
        only("model").alias("page_embedding_model"), only("model_version").alias("page_embedding_model_version"),
        only("normalization").alias("page_embedding_normalization"), only("dimensions", "int").alias("page_embedding_dimensions"),
        "canonical_match_key", F.lit("pending").alias("status"), _explanation("reverse" if reverse else "historical").alias("score_explanation"),
        "similarity", "threshold", at.cast("timestamp").alias("created_at"), at.cast("timestamp").alias("updated_at"),
    )


def reverse_candidates(matched: DataFrame, at: Column) -> DataFrame:
    """Rows for match_candidates from reverse matches joined to their revision."""
    return _candidate(matched, "reverse_alert_stream", at)


def historical_candidates(hits: DataFrame, at: Column) -> DataFrame:
    """Rows for match_candidates from ``historical_match``."""
    return _candidate(hits, "historical_page_search", at)


REVERSE_EVIDENCE = [
    "alert_rule_id", "alert_rule_revision_id", "revision_id", "match_mode", "alert_embedding_id", "page_embedding_sha256",
    "page_embedding_model", "page_embedding_model_version", "page_embedding_dimensions", "page_embedding_normalization",
]
HISTORICAL_EVIDENCE = ["alert_rule_id", "alert_rule_revision_id", "revision_id", "embedding_id"]


def merge_candidates(new: DataFrame, stored: DataFrame, evidence: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inserted, existing, conflicts): candidates whose key is new, is stored with equal evidence, or with other evidence.

    The first of several new rows of one key stands for it: the least candidate
    row in the order of the rule vector.
    """
    key = ["tenant_id", "canonical_match_key"]
    order = Window.partitionBy(*key).orderBy("alert_embedding_id", "embedding_id")
    new = new.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    n, s = new.alias("n"), stored.alias("s")
    same_key = [F.col(f"n.{c}") == F.col(f"s.{c}") for c in key]
    equal = F.lit(True)
    for c in evidence:
        equal = equal & F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
    inserted = new.join(stored.select(*key), key, "left_anti").select(*new.columns)
    met = n.join(s, same_key)
    return inserted, met.where(equal).select("s.*"), met.where(~equal).select("n.*")


def without_conflicted_pages(rows: DataFrame, conflicts: DataFrame, column: str = "revision_id") -> DataFrame:
    """Rows of pages none of whose candidates conflict: a conflict withholds all of its page."""
    return rows.join(conflicts.select(F.col("revision_id").alias(column)).distinct(), column, "left_anti")


def candidate_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("tenant_id", "match_mode").agg(F.count("*").alias("candidates"), F.count_distinct("revision_id").alias("revisions"))

