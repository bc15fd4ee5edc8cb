"""Exact similarity search over stored page vectors, for one query or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..functions.vectors import cosine_similarity, is_finite
from . import product

SPACE = ["model", "model_version", "dimensions", "normalization"]
HIT = [
    "embedding_id", "revision_id", "page_id", "source_id", "canonical_url", "content_sha256", "title", "excerpt",
    "similarity", "distance", *SPACE, "fetched_at",
]


def searchable(embeddings: DataFrame, revisions: DataFrame, pages: DataFrame) -> DataFrame:
    """Vectors of all revisions, not just the latest, with what a hit shows of them."""
    r = revisions.select("tenant_id", "revision_id", "page_id", "content_sha256", "title", excerpt(F.col("content_text")).alias("excerpt"), "fetched_at")
    p = pages.select("tenant_id", "page_id", "source_id", "canonical_url")
    return embeddings.drop("generated_at").join(r, ["tenant_id", "revision_id"]).join(p, ["tenant_id", "page_id"])


def after_cursor(distance: Column, embedding_id: Column, cursor_distance: Column, cursor_id: Column) -> Column:
    """Rows past a keyset cursor; all rows without one."""
    past = (distance > cursor_distance) | ((distance == cursor_distance) & (embedding_id > cursor_id))
    return cursor_distance.isNull() | past


def scored(items: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Items in each query's tenant, model space and sources that reach its floor, with similarity.

    ``queries`` has query_id, tenant_id, the model space, vector, min_similarity,
    source_ids and optionally cursor_distance and cursor_id. All filters come
    before any ranking. A similarity that is not a finite number is no hit. Blocks
    of items and queries are multiplied to propose hits, which the exact expression
    then decides; embedding_id and query_id tell rows apart. With ``limit`` at least
    so many nearest hits of each query are there, and little more: blocks propose no more.
    """
    for name, kind in (("cursor_distance", "double"), ("cursor_id", "string")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    space = ["tenant_id", *SPACE]
    right = queries.select(
        *space, F.col("query_id").alias("r"), F.col("vector").alias("v"), F.col("min_similarity").alias("floor"), F.col("source_ids").alias("tags"),
        (1.0 - F.col("cursor_distance")).alias("ceiling"), *([] if limit is None else [F.lit(limit).alias("k")]),
    )
    left = items.select(*space, F.col("embedding_id").alias("l"), F.col("embedding").alias("v"), F.col("source_id").alias("tag"))
    near = product.near_pairs(left, right, space, per=None if limit is None else "r")
    if limit is not None:
        near = product.nearest(near, "r")
    i, q, n = items.alias("i"), queries.alias("q"), near.alias("n")
    inside = (F.size("q.source_ids") == 0) | F.array_contains("q.source_ids", F.col("i.source_id"))
    out = n.join(q, F.col("n.r") == F.col("q.query_id")).join(i, F.col("n.l") == F.col("i.embedding_id")).where(inside).select(
        "q.query_id", "q.min_similarity", "q.cursor_distance", "q.cursor_id", "i.*",
        cosine_similarity(F.col("i.embedding"), F.col("q.vector")).alias("similarity"),
    )
    out = out.withColumn("distance", 1.0 - F.col("similarity"))
    floor = F.col("similarity") >= F.col("min_similarity").cast("double")
    return out.where(is_finite(F.col("similarity")) & floor).where(
        after_cursor(F.col("distance"), F.col("embedding_id"), F.col("cursor_distance"), F.col("cursor_id"))
    )


def search_many(items: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` nearest hits of each query after its cursor, with rank and ``has_more``.

    Order: distance, then embedding id. The cursor for the next page is the
    distance and id of the last row of a query whose ``has_more`` is true.
    """
    order = Window.partitionBy("query_id").orderBy("distance", "embedding_id")
    ranked = scored(items, queries, limit + 1).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit + 1)
    more = F.max("rank").over(Window.partitionBy("query_id")) > limit
    return ranked.withColumn("has_more", more).where(F.col("rank") <= limit).select("query_id", "rank", *HIT, "has_more")


def search_one(items: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """As ``search_many`` for a single query: a top-k without a window, a row more than asked for tells of a next page."""
    return scored(items, queries, limit + 1).orderBy("distance", "embedding_id").limit(limit + 1).select("query_id", *HIT)


def next_cursors(hits: DataFrame) -> DataFrame:
    """(query_id, cursor_distance, cursor_id) of the queries that have more hits."""
    return hits.where("has_more").groupBy("query_id").agg(
        F.max_by(F.struct("distance", "embedding_id"), "rank").alias("c")
    ).select("query_id", F.col("c.distance").alias("cursor_distance"), F.col("c.embedding_id").alias("cursor_id"))


def multi_view_totals(items: DataFrame, views: DataFrame) -> DataFrame:
    """(query_id, embedding_id, mean_score, best_score): similarity over a query's weighted views, as weighted mean and best.

    ``views`` are queries with input_id and weight. An addition to the single-vector search.
    Views are summed up where blocks are multiplied, so that memory and what is shuffled
    grow with the scores handed out and not with all pairs of items and views. Views after
    a cursor go by the pairs themselves.
    """
    if "cursor_distance" in views.columns:
        per = scored(items, views.withColumn("query_id", F.struct("query_id", "input_id", "weight")))
        by = {"query_id": F.col("query_id.query_id"), "weight": F.col("query_id.weight")}
        per = per.select(*[c.alias(name) for name, c in by.items()], "embedding_id", "similarity")
        mean = F.sum(F.col("similarity") * F.col("weight")) / F.sum("weight")
        return per.groupBy("query_id", "embedding_id").agg(mean.alias("mean_score"), F.max("similarity").alias("best_score"))
    space = ["tenant_id", *SPACE]
    right = views.select(
        *space, F.col("query_id").alias("r"), F.struct("query_id", "input_id").alias("of"), F.col("vector").alias("v"), F.col("min_similarity").alias("floor"), F.col("source_ids").alias("tags"), "weight"
    )
    left = items.where("embedding_id IS NOT NULL").select(*space, F.col("embedding_id").alias("l"), F.col("embedding").alias("v"), F.col("source_id").alias("tag"))
    sums = product.gathered(left, right, space)
    return sums.select(
        F.col("r").alias("query_id"), F.col("l").alias("embedding_id"), (F.col("weighted") / F.col("weight")).alias("mean_score"), F.col("best").alias("best_score")
    )


def multi_view_scores(items: DataFrame, views: DataFrame, how: str = "max") -> DataFrame:
    """(query_id, embedding_id, score): one of the two figures of ``multi_view_totals``."""
    return multi_view_totals(items, views).select("query_id", "embedding_id", F.col("best_score" if how == "max" else "mean_score").alias("score"))
