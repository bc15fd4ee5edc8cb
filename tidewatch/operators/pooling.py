"""Weighted centroids as an aggregate whose parts can be merged in any order.

Components are summed as whole numbers, in two limbs of 30 bits behind the point, so
a sum is the same to the last bit however rows are dealt and parts are merged, and
more exact than one of doubles. Tasks add up what they have before anything is
shuffled; a key moves as one row a task, never as a list of its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import EPSILON

LIMB = float(1 << 30)
#: Weights are below this, so that sums of 2 ** 22 rows and more a key fit.
LARGEST = 1024.0
#: Keys that a task holds before it hands on what it has.
KEYS = 20_000
PARTS = "high array<long>, low array<long>, weight array<long>, zeros long, odd long, rows long"


class Part(NamedTuple):
    """Sums of a key: limbs of the components and of the weight, rows without direction, rows of another size or weight, all rows."""

    high: np.ndarray
    low: np.ndarray
    weight: np.ndarray
    zeros: int
    odd: int
    rows: int

    def plus(self, other: Part) -> Part:
        if not len(self.high) or not len(other.high):
            one = self if len(self.high) else other
            return Part(one.high, one.low, self.weight + other.weight, self.zeros + other.zeros, self.odd + other.odd, self.rows + other.rows)
        if len(self.high) != len(other.high):
            return Part(self.high, self.low, self.weight + other.weight, self.zeros + other.zeros, self.odd + other.odd + 1, self.rows + other.rows)
        return Part(*(a + b for a, b in zip(self, other, strict=True)))


def limbs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers (high, low) with x = (high + low / LIMB) / LIMB but for less than 2 ** -60."""
    scaled = x * LIMB
    high = np.floor(scaled)
    return high.astype(np.int64), np.floor((scaled - high) * LIMB).astype(np.int64)


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    carry = low >> 30
    return ((high + carry) + (low - (carry << 30)) / LIMB) / LIMB


def _units(flat: np.ndarray, size: int) -> np.ndarray:
    v = flat.reshape(-1, size)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(length > 0, v / length, np.nan)


def _of_batch(keys: list, vectors: pa.Array, weights: np.ndarray) -> Iterator[tuple[object, Part]]:
    """A part for each key and vector size of a batch."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = vectors.offsets.to_numpy()[:-1] - vectors.offsets.to_numpy()[0]
    number: dict = {}
    of = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
    names = list(number)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        u = _units(flat[begin[own, None] + np.arange(size)].ravel(), int(size)) if size else np.full((len(own), 0), np.nan)
        w = weights[own]
        fit = np.isfinite(w) & (np.abs(w) < LARGEST)
        zero = ~np.isfinite(u).all(axis=1) if size else np.ones(len(own), bool)
        which, place = np.unique(of[own], return_inverse=True)
        good = fit & ~zero
        high, low = limbs(np.where(good[:, None], u * np.where(fit, w, 0.0)[:, None], 0.0))
        w_high, w_low = limbs(np.where(fit, w, 0.0))
        sums = [np.zeros((len(which), int(size)), np.int64) for _ in range(2)] + [np.zeros((len(which), 2), np.int64)]
        for total, x in zip(sums, (high, low, np.stack([w_high, w_low], axis=1)), strict=True):
            np.add.at(total, place, x)
        counts = [np.bincount(place, x, len(which)).astype(np.int64) for x in (zero, ~fit, np.ones(len(own)))]
        for i, k in enumerate(which.tolist()):
            yield names[k], Part(sums[0][i], sums[1][i], sums[2][i], *(int(c[i]) for c in counts))


def _record(parts: dict, key: pa.DataType) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    columns = [pa.array(list(parts), key)]
    columns += [pa.array([getattr(p, f) for p in parts.values()], longs) for f in ("high", "low", "weight")]
    columns += [pa.array([getattr(p, f) for p in parts.values()], pa.int64()) for f in ("zeros", "odd", "rows")]
    return pa.record_batch(columns, names=["key", "high", "low", "weight", "zeros", "odd", "rows"])


def _partial_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        for key, part in _of_batch(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)):
            held[key] = held[key].plus(part) if key in held else part
        if len(held) > KEYS:
            yield _record(held, batch.schema.field(0).type)
            held = {}
    if held:
        yield _record(held, batch.schema.field(0).type)


def _settled(part: Part) -> tuple[str, np.ndarray | None]:
    total = float(joined(part.weight[:1], part.weight[1:])[0])
    if part.zeros:
        return "zero_vector", None
    if part.odd:
        return "dimension_mismatch", None
    if not total > 0:
        return "zero_weight", None
    mean = joined(part.high, part.low) / total
    length = np.sqrt((mean * mean).sum())
    return ("ok", (mean / length).astype(np.float32)) if length > EPSILON else ("zero_centroid", None)


def _merged_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, status, centroid) of parts that come sorted by key: one key's sums are held at a time."""
    key, held, kind = None, None, None

    def rows(done: list[tuple[object, Part]]) -> pa.RecordBatch:
        told = [(k, *_settled(p)) for k, p in done]
        return pa.record_batch([pa.array([t[0] for t in told], kind), pa.array([t[1] for t in told], pa.string()), pa.array([t[2] for t in told], pa.list_(pa.float32()))], names=["key", "status", "centroid"])

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        lists = [[np.array(x, np.int64) for x in batch.column(i).to_pylist()] for i in (1, 2, 3)]
        for k, *sums in zip(batch.column(0).to_pylist(), *lists, *(batch.column(i).to_pylist() for i in (4, 5, 6)), strict=True):
            part = Part(*sums)
            if held is not None and k == key:
                held = held.plus(part)
                continue
            if held is not None:
                done.append((key, held))
            key, held = k, part
        yield rows(done)
    if held is not None:
        yield rows([(key, held)])


def weighted_centroid(rows: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """(key, status, centroid) for each key: the unit vector of the weighted mean of unit vectors.

    ``status`` is ok, or with a null centroid zero_vector (a vector that is null,
    empty, not finite or without length), dimension_mismatch (two sizes, or a weight that is null, not finite or 1024
    and more), zero_weight or zero_centroid, the first that holds. Bits do not depend on the partitioning.
    """
    slim = rows.select(
        F.col(key).alias("key"), F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias("v"), F.coalesce(F.col(weight).cast("double"), F.lit(float("nan"))).alias("w")
    )
    kind = T.StructField("key", rows.schema[key].dataType)
    partial = T.StructType([kind, *T.StructType.fromDDL(PARTS).fields])
    parts = slim.mapInArrow(_partial_batches, partial)
    out = T.StructType([kind, *T.StructType.fromDDL("status string, centroid array<float>").fields])
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(_merged_batches, out).withColumnRenamed("key", key)
