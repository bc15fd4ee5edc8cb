"""The crawl frontier as a stored table: found URLs are merged into it by rewriting the buckets that they fall in.

A batch writes the buckets that it touches to a folder of its own and publishes it
by a marker (``sources.commits``). A bucket's rows are those of the last published
folder that has it, so readers see whole batches and the rest of the table is not rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frontier import KEY, merged
from ..sources.commits import Ledger
from ..sources.schemas import SCHEMAS, struct
from ..sources.scratch import materialise

TABLE = "crawl_queue"
BUCKETS = 64
#: What finding a URL tells; everything else belongs to those who work on the queue.
FOUND = ["url", "discovered_by", "depth", "priority", "created_at"]


def bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int")


def folder_of_bucket(spark: SparkSession, root: str) -> dict[int, str]:
    """The folder that has each bucket's rows now: as many entries as there are buckets at most."""
    ledger = Ledger(spark, root)
    latest: dict[int, str] = {}
    for folder in ledger.folders():
        for name in ledger._names(f"{TABLE}/{folder.name}"):
            if name.startswith("bucket="):
                latest[int(name.partition("=")[2])] = folder.name
    return latest


def stored(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame:
    """The table, or some buckets of it."""
    paths = [f"{root}/{TABLE}/{f}/bucket={b}" for b, f in sorted(folder_of_bucket(spark, root).items()) if buckets is None or b in buckets]
    if not paths:
        return spark.createDataFrame([], SCHEMAS[TABLE])
    names = [f.name for f in struct(TABLE)]
    return spark.read.schema(SCHEMAS[TABLE]).option("basePath", f"{root}/{TABLE}").parquet(*paths).select(*names)


def upserted(found: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of ``held`` and those of ``found``, one a URL, after merging.

    A URL that is held keeps its status, attempts, times and lease; its discovery is
    the better one of both, as in ``frontier.merged``, unless it is leased: then nothing of it changes.
    """
    n, o = merged(found).alias("n"), held.alias("o")
    there, new = F.col("o.canonical_url").isNotNull(), F.col("n.canonical_url").isNotNull()
    order = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in ("depth", "priority", "created_at", "discovered_by")))
    taken = new & (~there | ((F.col("o.status") != "leased") & (order("n") < order("o"))))
    same = [F.col(f"n.{c}") == F.col(f"o.{c}") for c in KEY]
    columns = []
    for f in struct(TABLE):
        c = f.name
        if c in KEY:
            columns.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c in FOUND:
            columns.append(F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).cast(f.dataType).alias(c))
        else:
            given = F.col(f"n.{c}") if c in found.columns else F.lit(None)
            columns.append(F.when(there, F.col(f"o.{c}")).otherwise(given).cast(f.dataType).alias(c))
    return n.join(o, same, "full").select(*columns)


def upsert(spark: SparkSession, root: str, found: DataFrame, batch_id: int) -> list[int]:
    """Merge a batch of found URLs into the table and publish it; the buckets that were rewritten, none for a batch that is published already."""
    ledger = Ledger(spark, root)
    if ledger.has(batch_id):
        return []
    found = materialise(found, "found")
    hit = sorted(r[0] for r in found.select(bucket().alias("b")).distinct().collect())
    folder = ledger.draft(batch_id)
    rows = upserted(found, stored(spark, root, hit)).withColumn("bucket", bucket())
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{TABLE}/{folder.name}")
    return hit if ledger.publish(folder) else []
