"""Size-tiered shards of a document table under a versioned manifest.

Arrivals are appended as small immutable files. Compaction merges runs of files
of similar size into files of a target size. What belongs to a version is told
by its manifest alone: a version exists once its pointer file has been renamed
into place, which fails if another writer was first, so readers never see half
a change and a lost job leaves only files that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, free_name, materialise, scratch_path

#: Text bytes of a merged file.
TARGET_BYTES = 64 << 20
#: Documents in an appended file at most.
ARRIVAL_ROWS = 1000
#: Tiers are powers of this over ``SMALL_BYTES``; a run needs as many files unless it fills a target.
FAN_IN = 4
SMALL_BYTES = 64 << 10
#: Lists of up to this many files (about 100 bytes each) are sent to all tasks; longer ones are joined by a shuffle.
BROADCAST_FILES = 200_000

#: ``folder`` is the folder of the version that wrote the shard, in which ``shard`` is a file or a folder of one run.
MANIFEST = "shard string, folder string, n_docs long, n_bytes long, tier int, added long"


class CommitConflict(RuntimeError):
    """Another writer committed the same version first."""


class ShardTable:
    """A folder with ``data/`` (immutable files), ``lists/`` (manifests) and ``versions/`` (pointers)."""

    def __init__(self, spark: SparkSession, root: str, size_column: str = "text"):
        self.spark, self.root, self.size_column = spark, root.rstrip("/"), size_column
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """The latest version, 0 for none."""
        folder = self._path("versions")
        fs = folder.getFileSystem(self._conf)
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        pointer = self.spark.read.text(f"{self.root}/versions/{version:09d}.json").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{json.loads(pointer)['list']}")

    def commit(self, manifest: DataFrame, base: int) -> int:
        """Publish ``manifest`` as version ``base + 1``; raises CommitConflict if that exists."""
        name = f"lists/{base + 1:09d}-{uuid.uuid4().hex}"
        manifest.write.parquet(f"{self.root}/{name}")
        draft, final = self._path(f"versions/.draft-{uuid.uuid4().hex}"), self._path(f"versions/{base + 1:09d}.json")
        out = draft.getFileSystem(self._conf).create(draft, False)
        out.write(bytearray(json.dumps({"list": name}).encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Exception as error:
            if "AlreadyExists" in str(error):
                raise CommitConflict(f"version {base + 1} exists") from error
            raise
        return base + 1

    def _tier(self, size):
        ratio = F.greatest(size, F.lit(SMALL_BYTES)) / F.lit(float(SMALL_BYTES))
        return F.floor(F.log(ratio) / F.log(F.lit(float(FAN_IN)))).cast("int")

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Write ``rows`` as they are dealt, without a shuffle, and commit them as new shards.

        Every row is written with all its columns: nulls, repeated rows and texts of
        any length are kept; no rows give a version without new shards.
        """
        base = self.version()
        name = f"data/a-{base + 1:09d}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", arrival_rows).parquet(f"{self.root}/{name}")
        size = F.octet_length(F.coalesce(F.col(self.size_column), F.lit("")))
        added = (
            self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")
            .select(F.col("_metadata.file_name").alias("file"), size.alias("size"))
            .groupBy("file").agg(F.count("*").alias("n_docs"), F.sum("size").alias("n_bytes"))
        )
        added = added.select(
            F.concat(F.lit(f"{name}/"), "file").alias("shard"), F.lit(name).alias("folder"), "n_docs", "n_bytes",
            self._tier(F.col("n_bytes")).alias("tier"), F.lit(base + 1).cast("long").alias("added"),
        )
        return self.commit(self.manifest(base).unionByName(added), base)

    def plan(self, manifest: DataFrame, target_bytes: int) -> DataFrame:
        """(run, shard, ...) for each shard that is to be merged; runs are whole numbers from 0, few of them unused.

        Within a tier, files follow each other by age; a run is closed when its
        bytes reach the target. A run of one file is left alone, as are files of
        half the target or more and a last run of fewer than ``FAN_IN`` files that
        has not filled half a target. Files are sorted by range, so that running
        sums are made a part at a time; what is ordered whole has a row a part and tier.
        """
        small = manifest.where(F.col("n_bytes") * 2 < target_bytes).repartitionByRange("tier", "added", "shard")
        placed = materialise(small.withColumn("part", F.spark_partition_id()), "shard-order")
        sums = placed.groupBy("tier", "part").agg(F.sum("n_bytes").alias("bytes"))
        along = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("tier", "part", F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("base"))
        in_tier = placed.groupBy("tier").agg(F.ceil(F.sum("n_bytes") / target_bytes).alias("runs"))
        first = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
        in_tier = in_tier.select("tier", F.coalesce(F.sum("runs").over(first), F.lit(0)).alias("first"))
        age = Window.partitionBy("part", "tier").orderBy("added", "shard").rowsBetween(Window.unboundedPreceding, -1)
        inside = placed.withColumn("inside", F.coalesce(F.sum("n_bytes").over(age), F.lit(0)))
        run = (F.col("first") + F.floor((F.col("base") + F.col("inside")) / target_bytes)).cast("int")
        runs = inside.join(sums, ["tier", "part"]).join(F.broadcast(in_tier), "tier").withColumn("run", run)
        worth = runs.groupBy("run").agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes")).where(
            (F.col("files") >= FAN_IN) | ((F.col("files") > 1) & (F.col("bytes") * 2 >= target_bytes))
        )
        return runs.join(worth.select("run"), "run").select("run", "shard", "folder", "n_docs", "n_bytes")

    def compact(self, schema, target_bytes: int = TARGET_BYTES) -> int:
        """Merge one round of runs; returns the version that holds afterwards.

        Nothing to merge commits nothing. Text moves once, to the task that
        writes its run: each run has a task of its own.
        """
        base = self.version()
        manifest = self.manifest(base)
        plan_at = f"{self.root}/lists/plan-{uuid.uuid4().hex}"
        self.plan(manifest, target_bytes).write.parquet(plan_at)
        plan = self.spark.read.parquet(plan_at)
        files, last = plan.agg(F.count("*"), F.max("run")).first()
        if not files:
            return base
        name = f"data/c-{base + 1:09d}-{uuid.uuid4().hex[:8]}"
        run, shard = free_name("__run", schema.names), free_name("__shard", schema.names)
        rows = self._rows(plan.select("shard", "folder", F.col("run").alias(run)), files, schema)
        (
            rows.drop(shard).repartitionById(last + 1, run)
            .write.option("compression", "zstd").partitionBy(run).parquet(f"{self.root}/{name}")
        )
        merged = plan.groupBy("run").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))
        merged = merged.select(
            F.concat(F.lit(f"{name}/{run}="), "run").alias("shard"), F.lit(name).alias("folder"), "n_docs", "n_bytes",
            self._tier(F.col("n_bytes")).alias("tier"), F.lit(base + 1).cast("long").alias("added"),
        )
        kept = manifest.join(plan.select("shard"), "shard", "left_anti").select(*manifest.columns)
        return self.commit(kept.unionByName(merged), base)

    def _rows(self, listed: DataFrame, files: int, schema) -> DataFrame:
        """Rows of the listed shards with the shard's name in ``__shard`` (or a name that is free) and the list's further columns.

        The driver names folders only, one a version that still has shards; which
        files in them count is told by a join with the list.
        """
        folders = [f"{self.root}/{r['folder']}" for r in listed.select("folder").distinct().toLocalIterator()]
        shard = free_name("__shard", schema.names)
        moves = listed.withColumnRenamed("shard", shard).drop("folder")
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn(shard, F.lit("")).join(moves, shard)
        file = F.regexp_extract("_metadata.file_path", r"(data/[^/]+/[^/]+)(?:/[^/]+)?$", 1)
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders).select("*", file.alias(shard))
        return rows.join(F.broadcast(moves) if files <= BROADCAST_FILES else moves, shard)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, with ``__shard``, or the first free name like it; no version yet has no rows."""
        listed = self.manifest(version).select("shard", "folder")
        return self._rows(listed, listed.count(), schema)


def shard(docs: DataFrame, root: str, arrivals: int = 2, target_bytes: int = TARGET_BYTES) -> ShardTable:
    """Append ``docs`` in ``arrivals`` parts and compact until nothing is worth merging.

    Every row is kept with all its columns; null and empty texts count no bytes,
    and repeated rows stay repeated. An empty table gives versions without shards.
    """
    table = ShardTable(docs.sparkSession, root)
    for part in range(arrivals):
        arrival = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == part
        table.append(docs.where(arrival) if arrivals > 1 else docs)
    while True:
        before = table.version()
        if table.compact(docs.schema, target_bytes) == before:
            return table


def placed(docs: DataFrame, root: str) -> DataFrame:
    """Each row's shard in the final version, read back from the shards."""
    table = shard(docs, root)
    rows = table.read(docs.schema).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.col(free_name("__shard", docs.columns)).alias("shard"),
    )
    listed = table.manifest().select(
        "shard", F.col("n_docs").alias("shard_docs"), F.col("n_bytes").alias("shard_bytes"), "tier"
    )
    return rows.join(listed, "shard").withColumn("version", F.lit(table.version()).cast("long"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each row of ``documents``; null and empty texts are placed with no bytes, repeated rows each."""
    return placed(documents(spark, sf_dir), scratch_path(spark, "shards"))
