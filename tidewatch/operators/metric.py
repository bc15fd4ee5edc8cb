"""Near pairs by a metric index: cells that no vector within reach can lie in are not multiplied.

The angle between vectors is a metric. Left rows are dealt to the nearest of some
pivots of their key, and a cell knows its radius, the greatest angle to its pivot.
A right row that looks no further than the angle of its floor can pass over every
cell whose pivot is further away than that and the radius together. Nothing is
estimated, so the outcome is that of all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialise
from . import product

#: Pivots of a key at most, each with a vector: a row of them meets every part of its key.
PIVOTS = 64
#: Left rows for each pivot.
CELL_ROWS = 4096
#: How far an angle may be off, many times over.
ANGLE_HAIR = 1e-6


def pivots(left: DataFrame, key: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, pivots): vectors of the rows of least hash, as many as a key has ``cell_rows``, ``PIVOTS`` at most."""
    order = Window.partitionBy(*key).orderBy(F.xxhash64("l"), "l")
    few = left.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PIVOTS)
    count = left.groupBy(*key).agg(F.ceil(F.count("*") / cell_rows).alias("wanted"))
    few = few.join(count, key).where(F.col("nth") <= F.greatest(F.col("wanted"), F.lit(1)))
    return few.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("nth", "v"))).alias("pivots"))


def _angles(rows: pa.ChunkedArray, centers: list) -> np.ndarray:
    units = product._units(rows)
    centers = product._units(pa.chunked_array([pa.array(centers, rows.type)]))
    with np.errstate(invalid="ignore"):
        return np.arccos(np.clip(units @ centers.T, -1.0, 1.0))


def _placed(rows: pa.Table, of_key: pa.Table) -> pa.Table:
    """(l, cell, angle): the nearest pivot of each row; rows without a direction are in no cell."""
    if not rows.num_rows or not of_key.num_rows:
        return pa.table({"l": rows.column("l").slice(0, 0), "cell": pa.array([], pa.int32()), "angle": pa.array([], pa.float64())})
    angles = _angles(rows.column("v"), [p["v"] for p in of_key.column("pivots")[0].as_py()])
    # A pivot without a direction holds nothing.
    angles = np.where(np.isnan(angles), np.inf, angles)
    cell = angles.argmin(axis=1)
    angle = angles[np.arange(len(cell)), cell]
    some = pa.array(np.flatnonzero(np.isfinite(angle)))
    return pa.table({"l": rows.column("l").take(some), "cell": pa.array(cell.astype(np.int32)).take(some), "angle": pa.array(angle).take(some)})


def _reached(rows: pa.Table, of_key: pa.Table) -> pa.Table:
    """(r, cell): the cells that may hold a vector within a row's floor."""
    if not rows.num_rows or not of_key.num_rows:
        return pa.table({"r": rows.column("r").slice(0, 0), "cell": pa.array([], pa.int32())})
    cells = of_key.column("cells")[0].as_py()
    angles = _angles(rows.column("v"), [c["v"] for c in cells])
    floor = np.clip(rows.column("floor").to_numpy().astype(np.float64) - product.HAIR, -1.0, 1.0)
    near = angles - np.array([c["radius"] for c in cells]) <= np.arccos(floor)[:, None] + ANGLE_HAIR
    i, j = np.nonzero(near)
    return pa.table({"r": rows.column("r").take(pa.array(i)), "cell": pa.array(np.array([c["cell"] for c in cells], np.int32)[j])})


def _parts(rows: DataFrame, key: list[str], block_bytes: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a part of bounded bytes within their key, and the number of parts of each key."""
    counts = rows.groupBy(*key).agg(F.ceil(F.count("*") / F.first(product._per_block(block_bytes))).cast("int").alias("parts"))
    return rows.join(counts, key).withColumn("part", F.pmod(F.xxhash64(name), F.col("parts")).cast("int")).drop("parts"), counts


def _beside(rows: DataFrame, of_key: DataFrame, key: list[str], block_bytes: int, name: str, columns: list[str], work, schema: list[T.StructField]) -> DataFrame:
    """Each part of the rows of a key with the one row of its key in ``of_key``."""
    parts, counts = _parts(rows, key, block_bytes, name)
    spread = of_key.join(counts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    group = [*key, "part"]
    return parts.select(*group, *columns).groupBy(*group).cogroup(spread.groupBy(*group)).applyInArrow(work, T.StructType(schema))


def dealt(left: DataFrame, right: DataFrame, key: list[str], block_bytes: int = product.BLOCK_BYTES, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Left rows with their cell, right rows with each cell they can reach, and (key, cell, radius, rows) of all cells."""
    left, right = product._fitting(left), product._fitting(right)
    chosen = materialise(pivots(left, key, cell_rows), "pivots")
    placed = _beside(
        left, chosen, key, block_bytes, "l", ["l", "v"], _placed,
        [left.schema["l"], T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())],
    )
    placed = materialise(placed, "cells")
    a = left.join(placed.select("l", "cell"), "l")
    cells = left.select("l", *key).join(placed, "l").groupBy(*key, "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("rows"))
    of_pivot = chosen.select(*key, F.posexplode("pivots").alias("cell", "p")).select(*key, "cell", F.col("p.v").alias("v"))
    packed = cells.join(of_pivot, [*key, "cell"]).groupBy(*key).agg(F.collect_list(F.struct("cell", "v", "radius")).alias("cells"))
    reached = _beside(
        right.withColumn("floor", F.col("floor").cast("double")), packed, key, block_bytes, "r", ["r", "v", "floor"], _reached,
        [right.schema["r"], T.StructField("cell", T.IntegerType())],
    )
    return a, right.join(materialise(reached, "reached"), "r"), cells


def near_pairs(
    left: DataFrame, right: DataFrame, key: list[str], block_bytes: int = product.BLOCK_BYTES, per: str | None = None, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """As ``product.near_pairs``, over the cells that each right row can reach. l and r are not null and tell rows apart."""
    a, b, _ = dealt(left, right, key, block_bytes, cell_rows)
    return product.near_pairs(a, b, [*key, "cell"], block_bytes, per)


def reach(left: DataFrame, right: DataFrame, key: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, cells, right_rows, meetings, skipped, pairs, pairs_skipped): how much of the product the index leaves out."""
    _, b, cells = dealt(left, right, key, cell_rows=cell_rows)
    all_cells = cells.groupBy(*key).agg(F.count("*").alias("cells"), F.sum("rows").alias("rows"))
    all_right = product._fitting(right).groupBy(*key).agg(F.count("*").alias("right_rows"))
    met = b.join(cells.select(*key, "cell", "rows"), [*key, "cell"]).groupBy(*key).agg(F.count("*").alias("meetings"), F.sum("rows").alias("pairs"))
    whole = all_cells.join(all_right, key).join(met, key, "left").na.fill(0, ["meetings", "pairs"])
    return whole.select(
        *key, "cells", "right_rows", "meetings", (F.col("cells") * F.col("right_rows") - F.col("meetings")).alias("skipped"), "pairs",
        (F.col("rows") * F.col("right_rows") - F.col("pairs")).alias("pairs_skipped"),
    )
