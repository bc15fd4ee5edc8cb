"""Centroid clustering by Lloyd rounds that are split by columns.

Vectors are whole numbers, dealt into groups of rows and cut into blocks of
columns. A task holds some blocks and the centroids' slices of these columns: it
has the exact part of each distance, parts are added by group of rows, and the
least sum is the row's centroid. The sums of the new centroids are made block by
block again, so no task holds whole vectors or whole centroids of its rows. All
numbers are integers, so neither the split nor the order of additions matters.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
#: Components become floor(SCALE * x).
SCALE = 1024
#: The first centroids are the vectors of least hash, with this number before their id.
SALT = 3
#: Columns of a block and rows of a group.
BLOCK = 16
GROUP_ROWS = 2048
#: Components are below this in size, so that every distance of a few hundred dimensions fits a long.
LIMIT = 1 << 27
#: Bytes of blocks that a task works on.
TASK_BYTES = 32 << 20
MAX_PARTITIONS = 20_000

GROUP_SCHEMA = "ids array<long>, blocks array<binary>"
RESULT = "vec_id long, cluster int, distance long"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with ``dimensions`` components, none of them null or not finite."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where((F.size(v) == dimensions) & finite).select(F.col("vec_id").cast("long"), v.alias("v"))


def _scaled(v: np.ndarray) -> np.ndarray:
    scaled = np.floor(v * float(SCALE))
    if scaled.size and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"a component is {LIMIT / SCALE:.0f} or more in size: its squared distances may not fit a long")
    return scaled.astype(np.int64)


def _group_batches(dimensions: int, block: int, rows: int):
    """Vectors in groups of ``rows``: their ids and a binary a block of columns, row by row, in 32 bits."""

    def group(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        blocks = [x[:, at : at + block].astype("<i4").tobytes() for at in range(0, dimensions, block)]
        return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))], names=["ids", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids += part.column(0).to_pylist()
                held.append(_scaled(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)))
                size += part.num_rows
                if size >= rows:
                    x = np.concatenate(held)
                    yield group(ids[:rows], x[:rows])
                    ids, held, size = ids[rows:], [x[rows:]], size - rows
        if size:
            yield group(ids, np.concatenate(held))

    return run


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, salt: int = SALT) -> np.ndarray:
    """The ``clusters`` vectors of least SHA-256 of ``salt:vec_id``, in that order; fewer if there are fewer."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([_scaled(np.array(r.v)) for r in rows], np.int64)


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Numbers from 0 in four bytes each where they fit, else in eight."""
    width = 4 if not x.size or x.max() < 1 << 32 else 8
    return width, x.astype(f"<u{width}").tobytes()


def _partial_batches(centroids: np.ndarray, block: int):
    """(group, width, parts): squared distances over a block's columns; blocks of one group that follow each other are added here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def row() -> pa.RecordBatch:
            width, data = _narrow(held)
            return pa.record_batch([pa.array([at], pa.int64()), pa.array([width], pa.int32()), pa.array([data], pa.binary())], names=["group", "width", "parts"])

        for batch in batches:
            for group, number, data in zip(*(batch.column(c) for c in ("group", "block", "data")), strict=True):
                part = centroids[:, number.as_py() * block : (number.as_py() + 1) * block]
                x = np.frombuffer(data.as_buffer(), "<i4").reshape(-1, part.shape[1]).astype(np.int64)
                near = np.stack([((x - c) ** 2).sum(axis=1) for c in part], axis=1)
                if group.as_py() == at:
                    held = held + near
                    continue
                if at is not None:
                    yield row()
                at, held = group.as_py(), near
        if at is not None:
            yield row()

    return run


def _nearest(clusters: int):
    def nearest(parts: pa.Table) -> pa.Table:
        total = sum(
            np.frombuffer(data.as_buffer(), f"<u{width.as_py()}").astype(np.int64) for width, data in zip(parts.column("width"), parts.column("parts"), strict=True)
        ).reshape(-1, clusters)
        labels = total.argmin(axis=1)
        return pa.table(
            {
                "group": parts.column("group").slice(0, 1), "labels": pa.array([labels.astype("<u2").tobytes()], pa.binary()),
                "distances": pa.array([total[np.arange(len(total)), labels].astype("<i8").tobytes()], pa.binary()),
            }
        )

    return nearest


def assigned(blocks: DataFrame, centroids: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(group, labels, distances): the number of each row's nearest centroid, the smallest one at ties."""
    parts = blocks.select("group", "block", "data").mapInArrow(_partial_batches(centroids, block), "group long, width int, parts binary")
    return parts.groupBy("group").applyInArrow(_nearest(len(centroids)), "group long, labels binary, distances binary")


def _sum_batches(clusters: int, block: int):
    """(component, cluster, total, n) of a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, data, labels in zip(*(batch.column(c) for c in ("block", "data", "labels")), strict=True):
                number, label = number.as_py(), np.frombuffer(labels.as_buffer(), "<u2")
                x = np.frombuffer(data.as_buffer(), "<i4").reshape(len(label), -1).astype(np.int64)
                if number not in sums:
                    sums[number], counts[number] = np.zeros((clusters, x.shape[1]), np.int64), np.zeros(clusters, np.int64)
                np.add.at(sums[number], label, x)
                counts[number] += np.bincount(label, minlength=clusters)
        for number, total in sums.items():
            cluster, column = np.indices(total.shape)
            yield pa.record_batch(
                [
                    pa.array((column + number * block).ravel().astype(np.int32)), pa.array(cluster.ravel().astype(np.int32)), pa.array(total.ravel()),
                    pa.array(np.repeat(counts[number], total.shape[1])),
                ],
                names=["component", "cluster", "total", "n"],
            )

    return run


def floor_quotient(total: Column, n: Column) -> Column:
    """The exact floor of a quotient of whole numbers, n above 0."""
    return ((total - F.pmod(total, n)) / n).cast("long")


def moved(blocks: DataFrame, labels: DataFrame, centroids: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Centroids after a round: each block's slice is the floor of its rows' mean; a centroid without rows stays.

    Of each slice as many numbers are fetched as it has: clusters times columns.
    """
    count = -(-centroids.shape[1] // block)
    to_blocks = labels.select("group", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), "labels")
    sums = blocks.join(to_blocks, ["group", "block"]).select("block", "data", "labels").mapInArrow(
        _sum_batches(len(centroids), block), "component int, cluster int, total long, n long"
    )
    whole = "decimal(38,0)"
    slices = sums.groupBy("component", "cluster").agg(F.sum(F.col("total").cast(whole)).cast(whole).alias("total"), F.sum("n").cast(whole).alias("n")).where("n > 0")
    out = centroids.copy()
    for r in slices.select("component", "cluster", floor_quotient(F.col("total"), F.col("n")).alias("mean")).collect():
        out[r["cluster"], r["component"]] = r["mean"]
    return out


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, labels, distances in zip(*(batch.column(c) for c in ("ids", "labels", "distances")), strict=True):
            label = np.frombuffer(labels.as_buffer(), "<u2").astype(np.int32)
            yield pa.record_batch([ids.values, pa.array(label), pa.array(np.frombuffer(distances.as_buffer(), "<i8"))], names=["vec_id", "cluster", "distance"])


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, block: int = BLOCK, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector, and the final centroids.

    Vectors of another size, null ones and those with a null or not finite component are
    left out. Repeated rows are vectors of their own, a null vec_id counts as the empty
    text in the choice of the first centroids, whose ties are decided by components. An
    empty table gives no rows and no centroids. A component of 131,072 or more in size is an error.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dimensions)
    centroids = first_centroids(whole, clusters)
    if not len(centroids):
        return spark.createDataFrame([], RESULT), centroids
    groups = whole.mapInArrow(_group_batches(dimensions, block, group_rows), GROUP_SCHEMA).withColumn("group", F.monotonically_increasing_id())
    groups = materialise(groups, "lloyd-groups")
    count = groups.count() * -(-dimensions // block)
    parts = min(max(count * group_rows * block * 4 // TASK_BYTES, min(count, spark.sparkContext.defaultParallelism), 1), MAX_PARTITIONS)
    table = f"blocks_{uuid.uuid4().hex}"
    try:
        # In buckets, so that rounds move parts of distances and labels but no vectors.
        (
            groups.select("group", F.posexplode("blocks").alias("block", "data")).repartition(parts, "group", "block").sortWithinPartitions("group", "block")
            .write.option("path", scratch_path(spark, "lloyd-blocks")).option("compression", "zstd").bucketBy(parts, "group", "block").sortBy("group", "block").saveAsTable(table)
        )
        blocks = spark.table(table)
        for _ in range(rounds):
            centroids = moved(blocks, assigned(blocks, centroids, block), centroids, block)
        rows = groups.select("group", "ids").join(assigned(blocks, centroids, block), "group").select("ids", "labels", "distances")
        return materialise(rows.mapInArrow(_row_batches, RESULT), "lloyd-rows"), centroids
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole vector of ``embeddings`` with its cluster; vectors that are null, not finite or of another size are left out, repeated rows stay."""
    rows, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    per = [(i, sums.get(i, 0), sum(sums.values()), digest(c)) for i, c in enumerate(centroids)]
    # A row a cluster.
    figures = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds one after the other over lists."""
    steps = [
        f"""v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c
  FROM (SELECT sha256('{SALT}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {CLUSTERS}))""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT row, min(struct_pack(d := d, k := k)) AS near FROM (
  SELECT row, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r}) GROUP BY row)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT old.k, coalesce(new.c, old.c) AS c FROM c{r} old LEFT JOIN (
  SELECT k, list(m ORDER BY i) AS c FROM (
    SELECT k, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM (SELECT near.k AS k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM v JOIN a{r} USING (row)) GROUP BY k, i) GROUP BY k) new ON old.k = new.k)"""
            )
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(near.k AS INTEGER) AS cluster, CAST(near.d AS BIGINT) AS distance, CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} USING (row) JOIN c{ROUNDS} ON near.k = c{ROUNDS}.k"""


ORACLE = _oracle()
