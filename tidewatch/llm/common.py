"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts that split at ASCII white space only.
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and driver and executors are one process, as
    in a local test, a temporary folder is made and put in its place for the rest
    of the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> DataFrame:
    """Write ``df`` as Parquet, with further options of the writer, in the shared folder and read it back.

    Cuts the lineage: a lost executor only repeats reads of files that every
    other executor can reach.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(compression=codec, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1 and so on, and which name stands for which: no added name clashes."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores before it as no name of ``taken`` has."""
    lower = {x.lower() for x in taken}
    while name in lower:
        name = "_" + name
    return name


def digest_of(text) -> F.Column:
    """The SHA-256 of a text, binary; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))


def crc_of_id(column) -> F.Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it has fewer input splits than there are cores, as a small table in one file has.

    Python functions over whole texts would else run in few tasks. Tables with
    enough splits are left as they are, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
