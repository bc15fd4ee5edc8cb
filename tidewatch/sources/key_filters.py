"""Bloom filters of the keys that a folder of a table holds, a filter a bucket.

A filter is rows of words of 64 bits: a key sets six bits of one word of its bucket.
Filters are built, merged and asked by joins and aggregates, so none passes the
driver. Of the keys that are asked for, those that no folder can hold are new
without a read of the table; a key that a folder lacks is taken for held about
once in two thousand times, and a key that it holds always.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key and bits that a key sets.
BITS_PER_KEY, SET = 24, 6
#: Most words of a bucket's filter, as a power of two.
MAX_WIDTH = 30


def _mask(hashed: Column) -> Column:
    """The bits of a key in its word."""
    out = F.lit(0).cast("long")
    for n in range(SET):
        at = F.shiftright(hashed, 6 * n).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return out


def _hashed(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, key, place, mask): the hash that gives a key's word, and its bits."""
    return keys.select("bucket", key, F.xxhash64(F.lit("word"), F.col(key)).alias("place"), _mask(F.xxhash64(F.lit("bits"), F.col(key))).alias("mask"))


def build(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, width, word, bits) of the filters of ``keys``, which has bucket and key; null keys are in none."""
    known = keys.dropna(subset=[key]).select("bucket", key).distinct()
    # Words for a bucket: the least power of two with BITS_PER_KEY bits a key.
    width = F.ceil(F.log2(F.count("*") * (BITS_PER_KEY / 64))).cast("int")
    sized = known.groupBy("bucket").agg(F.least(F.greatest(width, F.lit(0)), F.lit(MAX_WIDTH)).alias("width"))
    placed = _hashed(known, key).join(sized, "bucket").withColumn("word", word_of("place", "width"))
    return placed.groupBy("bucket", "width", "word").agg(F.bit_or("mask").alias("bits"))


def word_of(place: str, width: str) -> Column:
    return F.col(place).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(width)) - 1)


def possible(filters: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(folder, bucket, key) for each folder and each of ``keys`` that it may hold.

    ``filters`` has folder beside the columns of ``build``. A row a key and folder
    is looked up, by bucket and word.
    """
    asked = _hashed(keys.dropna(subset=[key]).select("bucket", key).distinct(), key)
    # A row a folder and bucket: their number does not grow with the keys, and folders are merged.
    sizes = filters.select("folder", "bucket", "width").distinct()
    looked = asked.join(sizes, "bucket").withColumn("word", word_of("place", "width"))
    met = looked.join(filters.select("folder", "bucket", "word", "bits"), ["folder", "bucket", "word"])
    return met.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("folder", "bucket", key)
