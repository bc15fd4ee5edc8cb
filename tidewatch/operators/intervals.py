"""Points in time with the intervals of their key that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that an interval lies in on the average, at most.
BUCKETS = 32


def _seconds(at: Column) -> Column:
    return F.unix_micros(at) / F.lit(1_000_000.0)


def bucket_seconds(points: DataFrame, spans: DataFrame, at: str, begin: str, end: str, buckets: int = BUCKETS) -> tuple[float, float, float] | None:
    """(first, last, width): the points' range, and a width at which intervals, cut to it, lie in ``buckets`` on the average.

    One row is fetched. None if there are no points or no intervals that meet their range.
    """
    first, last = points.agg(F.min(_seconds(F.col(at))), F.max(_seconds(F.col(at)))).first()
    if first is None:
        return None
    a = F.greatest(_seconds(F.col(begin)), F.lit(first))
    b = F.least(F.coalesce(_seconds(F.col(end)), F.lit(last)), F.lit(last))
    mean = spans.agg(F.avg(F.when(b >= a, b - a))).first()[0]
    return None if mean is None else (first, last, max(mean / buckets, 1.0))


def held_by(points: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, end: str, buckets: int = BUCKETS) -> DataFrame:
    """Each point with each interval of its keys for which begin <= at < end; a null end is open.

    Time is cut into buckets. A point lies in one, an interval in all that it
    touches within the points' range; rows meet in a bucket of their keys only, and
    the exact bounds decide. The width follows from the data, so that intervals
    take (``buckets`` + 2) rows on the average, however long some of them are. Null times meet
    nothing. Columns of the intervals other than the keys must be named otherwise than the points'.
    """
    found = bucket_seconds(points, spans, at, begin, end, buckets)
    first, last, width = found or (0.0, 0.0, 1.0)
    place = lambda seconds: F.floor((seconds - F.lit(first)) / F.lit(width)).cast("long")
    low = place(F.greatest(_seconds(F.col(begin)), F.lit(first)))
    high = place(F.least(F.coalesce(_seconds(F.col(end)), F.lit(last)), F.lit(last)))
    cut = spans.where(F.col(begin).isNotNull()).withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    cut = cut.withColumn("bucket", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    dealt = points.withColumn("bucket", place(_seconds(F.col(at))))
    inside = (F.col(begin) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return dealt.join(cut, [*keys, "bucket"]).where(inside).drop("bucket")
