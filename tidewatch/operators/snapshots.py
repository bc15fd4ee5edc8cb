"""Snapshots of a table compared by a tree of digests, so that only what differs is read.

A snapshot is written once, its rows laid out by ranges of a position, and beside it
goes a digest of each range that has rows: their number and two sums of hashes of
their frozen columns. Sums merge, so a wider range's digest is the sum of those in
it, whatever the partitioning. Two snapshots are compared from the widest ranges
down; below ranges that agree nothing is looked at, and rows are joined only where
the narrowest ranges differ.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit

#: Positions are whole numbers from 0 up to 2 to this power.
SPAN = 32


class Layout(NamedTuple):
    """How positions are cut into ranges."""

    #: Bits that the ranges of each level are wide, the widest first. A snapshot has at most 2 ** (SPAN - the last) digests a level.
    steps: tuple[int, ...]
    #: Bits of the ranges that rows are laid out by, a folder each; from the last step up to SPAN.
    folder_bits: int


#: For positions by hash: 256 folders, 65,536 narrowest ranges.
HASHED = Layout((32, 24, 16), 24)
#: For seconds of time: a folder each 18 hours, narrowest ranges of about an hour.
TIMED = Layout((32, 24, 16, 12), 16)


def hashed_position(key: str) -> Column:
    """Positions for keys in no order: the upper half of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key)), 32)


def timed_position(at: str) -> Column:
    """Positions by a frozen time in seconds: what is added later leaves the earlier ranges as they were.

    Null times and times before 1970 come first, times past the span last.
    """
    return F.coalesce(F.least(F.greatest(F.unix_seconds(at), F.lit(0)), F.lit((1 << SPAN) - 1)), F.lit(0)).cast("long")


def row_hashes(columns: list[str]) -> list[Column]:
    """Two hashes of 60 bits of all values of a row, nulls and their places included."""
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    sha = F.sha2(F.to_json(F.struct(*columns), options), 256)
    return [F.conv(F.substring(sha, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]


def write(rows: DataFrame, root: str, key: str, mutable: list[str], position: Column | None = None, layout: Layout = HASHED) -> None:
    """Store a snapshot at ``root``: its rows and the digests of all levels.

    Null keys are rows like any other; an empty table has no digests.
    """
    place = hashed_position(key) if position is None else position
    frozen = [c for c in rows.columns if c not in mutable]
    folder, leaf = F.shiftright(F.col("_position"), layout.folder_bits).cast("int"), F.shiftright(F.col("_position"), layout.steps[-1]).cast("int")
    laid = rows.withColumn("_position", place.cast("long")).withColumns({"_folder": folder, "_range": leaf}).drop("_position")
    # A folder may hold a third of all rows, so ranges and not folders are dealt to tasks.
    laid.repartitionByRange("_folder", "_range").sortWithinPartitions("_folder", "_range").write.partitionBy("_folder").parquet(f"{root}/rows")
    # An empty table's folders tell nothing of its columns.
    laid.limit(0).write.parquet(f"{root}/schema")
    spark = rows.sparkSession
    stored = spark.read.schema(laid.schema).parquet(f"{root}/rows")
    a, b = row_hashes(frozen)
    leaves = stored.select("_range", a.alias("a"), b.alias("b")).groupBy("_range").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    shown = leaves.select(F.lit(layout.steps[-1]).alias("bits"), F.col("_range").alias("range"), "n", *[F.col(c).cast("decimal(38,0)").alias(c) for c in ("a", "b")])
    shown.write.partitionBy("bits").parquet(f"{root}/digests")
    for bits, below in reversed(list(zip(layout.steps[:-1], layout.steps[1:], strict=True))):
        wider = _digests(spark, root, below).groupBy(F.shiftright("range", bits - below).alias("range"))
        wider = wider.agg(*[F.sum(c).cast(t).alias(c) for c, t in (("n", "long"), ("a", "decimal(38,0)"), ("b", "decimal(38,0)"))])
        wider.withColumn("bits", F.lit(bits)).write.mode("append").partitionBy("bits").parquet(f"{root}/digests")


def _digests(spark: SparkSession, root: str, bits: int) -> DataFrame:
    stored = spark.read.schema("range int, n long, a decimal(38,0), b decimal(38,0), bits int").parquet(f"{root}/digests")
    return stored.where(F.col("bits") == bits).drop("bits")


def differing_ranges(spark: SparkSession, before: str, after: str, layout: Layout = HASHED) -> DataFrame:
    """(range) of the narrowest ranges whose digests differ or that one snapshot lacks, found from the widest down."""
    found, above = None, None
    for bits in layout.steps:
        sides = [_digests(spark, root, bits) for root in (before, after)]
        if found is not None:
            wider = found.select(F.col("range").alias("wider"))
            sides = [s.withColumn("wider", F.shiftright("range", above - bits)).join(wider, "wider", "left_semi").drop("wider") for s in sides]
        x, y = sides[0].alias("x"), sides[1].alias("y")
        same = F.lit(True)
        for c in ("n", "a", "b"):
            same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        both = x.join(y, F.col("x.range") == F.col("y.range"), "full_outer").where(~same)
        found, above = both.select(F.coalesce("x.range", "y.range").alias("range")), bits
    return found


def folders_of(ranges: DataFrame, layout: Layout) -> list[int]:
    """Folders that hold the given ranges: at most 2 ** (SPAN - folder_bits) numbers."""
    return sorted(r[0] for r in ranges.select(F.shiftright("range", layout.folder_bits - layout.steps[-1])).distinct().collect())


def differing_rows(spark: SparkSession, before: str, after: str, layout: Layout = HASHED) -> tuple[DataFrame, DataFrame]:
    """The rows of both snapshots in ranges that differ; folders without such a range are not read."""
    ranges = differing_ranges(spark, before, after, layout)
    folders, named = folders_of(ranges, layout), ranges.select(F.col("range").alias("_range"))

    def rows(root: str) -> DataFrame:
        schema = spark.read.parquet(f"{root}/schema").schema
        stored = spark.read.schema(schema).parquet(f"{root}/rows").where(F.col("_folder").isin(folders))
        return stored.join(named, "_range", "left_semi").drop("_range", "_folder")

    return rows(before), rows(after)


def immutability(
    spark: SparkSession, before: str, after: str, table: str, key: str | None = None, mutable: list[str] | None = None, layout: Layout = HASHED
) -> DataFrame:
    """``audit.immutability`` of two snapshots, which must have been written with the same positions, layout and mutable columns."""
    return audit.immutability(*differing_rows(spark, before, after, layout), table, key, mutable)
