"""Expressions over dense vectors (arrays of floats), summed in double precision and in order."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMALIZATIONS = ("none", "l2", "unit_length")
EPSILON = 2.220446049250313e-16


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """1 minus the cosine distance; null for a zero vector or unequal sizes."""
    scale = norm(a) * norm(b)
    return F.when((scale > 0) & (F.size(a) == F.size(b)), dot(a, b) / scale)


def unit(v: Column) -> Column:
    """The vector at length 1 in double precision; null for a zero vector."""
    length = norm(v)
    return F.when(length > 0, F.transform(_double(v), lambda x: x / length))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_valid(v: Column, dimensions: Column) -> Column:
    """As many values as dimensions, all finite, and a length above zero."""
    return F.coalesce(
        (F.size(v) == dimensions) & F.forall(v, is_finite) & (norm(v) > EPSILON), F.lit(False)
    )


def to_text(v: Column) -> Column:
    """``[0.25,-0.5,1]``: whole values without a point."""
    numbers = F.transform(v, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", ""))
    return F.concat(F.lit("["), F.array_join(numbers, ","), F.lit("]"))


def from_text(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def _digests(vectors: pa.Array) -> pa.Array:
    """SHA-256 of each list of floats, big-endian; null for a null list or one with a null in it."""
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # -0 becomes 0
    flat[np.isnan(flat)] = np.nan
    data, ends = flat.astype(">f4").tobytes(), vectors.offsets.to_numpy()
    holes = np.concatenate([[0], np.cumsum(vectors.values.is_null().to_numpy(zero_copy_only=False))])
    known = vectors.is_valid().to_numpy(zero_copy_only=False) & (holes[ends[1:]] == holes[ends[:-1]])
    return pa.array([sha256(data[4 * a : 4 * b]).hexdigest() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], known, strict=True)], pa.string())


def embedding_sha256(v: Column) -> Column:
    """SHA-256 over the big-endian bits of the floats; -0 counts as 0. Vectors are hashed an Arrow batch at a time."""

    @F.arrow_udf("string")
    def digests(vectors: pa.Array) -> pa.Array:
        return _digests(vectors)

    return digests(v.cast("array<float>"))


def weighted_centroid(rows: DataFrame, key: str, ordinal: str, vector: str, weight: str) -> DataFrame:
    """(key, status, centroid) for each key: the unit vector of the weighted mean of unit vectors.

    ``status`` is ok, or zero_vector, zero_weight, dimension_mismatch or
    zero_centroid with a null centroid. Inputs are summed in the order of their
    ordinals, so results repeat to the last bit. A key holds at most the inputs of
    one query, which the input checks bound.
    """
    parts = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), unit(F.col(vector)).alias("u"), F.col(weight).cast("double").alias("w")))).alias("parts")
    )
    size = F.size(F.col("parts")[0]["u"])
    zeros = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["w"])
    summed = F.aggregate(
        "parts", zeros, lambda s, p: F.zip_with(s, p["u"], lambda x, y: x + y * p["w"])
    )
    status = (
        F.when(F.exists("parts", lambda p: p["u"].isNull()), "zero_vector")
        .when(F.exists("parts", lambda p: F.size(p["u"]) != size), "dimension_mismatch")
        .when(~(total > 0), "zero_weight")
    )
    mean = parts.select(
        key, status.alias("status"),
        F.when(status.isNull(), F.transform(summed, lambda x: x / total)).alias("mean"),
    )
    length = norm(F.col("mean"))
    return mean.select(
        key,
        F.coalesce("status", F.when(length > EPSILON, "ok").otherwise("zero_centroid")).alias("status"),
        F.when(F.col("status").isNull() & (length > EPSILON), F.transform("mean", lambda x: (x / length).cast("float"))).alias("centroid"),
    )
