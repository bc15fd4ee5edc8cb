"""Pairs of vectors whose cosine reaches a floor, proposed by matrix products over blocks of both sides.

Where only the nearest few of each row are asked for, every block hands out no more
than these, with all that lie within a hair of the last of them, so pairs leave the
product in proportion to rows and not to pairs. Scores are carried on; the exact
expression is needed only for what is left in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of vectors in one block of a side. A task multiplies one block of each side.
BLOCK_BYTES = 8 << 20
#: How often a row is sent at most where blocks are smaller than that; where more of them would meet it, they are joined.
COPIES = 8
#: Scores that a task holds at once.
SCORES = 4 << 20
#: How far a score may lie from the exact one, many times over; within it the exact expression decides.
HAIR = 1e-9
#: Rows that a task hands on at once.
HANDED = 1 << 17


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size at length 1, in double precision; a zero vector gives no number."""
    v = _matrix(column)
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(length > 0, v / length, np.nan)


def _admits(tags: pa.ChunkedArray, lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """For each left row the number of its tag, and which of these each right row admits: all for an empty list, none for null."""
    known: dict = {}
    codes = np.array([known.setdefault(t, len(known)) for t in tags.to_pylist()], np.int64)
    admitted = np.zeros((max(len(known), 1), len(lists)), bool)
    for j, wanted in enumerate(lists.to_pylist()):
        if wanted is None:
            continue
        if not wanted:
            admitted[:, j] = True
        for tag in wanted:
            if tag is not None and tag in known:
                admitted[known[tag], j] = True
    return codes, admitted


def kth_best(scores: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th greatest score of each row, each row with its own k; minus infinity if it has fewer."""
    width = scores.shape[1]
    most = int(min(max(k.max(initial=0), 0), width))
    if not most:
        return np.full(len(scores), np.inf)
    best = np.sort(np.partition(scores, width - most, axis=1)[:, width - most :], axis=1)
    out = best[np.arange(len(scores)), np.clip(most - k, 0, most - 1)]
    out[k > width] = -np.inf
    out[k <= 0] = np.inf
    return out


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosine of row i of ``a`` and row j of ``b``, summed in order as the exact expression does."""
    in_order = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 14):
        x, y = a[i[at : at + (1 << 14)]], b[j[at : at + (1 << 14)]]
        out[at : at + (1 << 14)] = in_order(x * y) / (np.sqrt(in_order(x * x)) * np.sqrt(in_order(y * y)))
    return out


def _gathering(tagged: bool):
    """(l, r, weighted, weight, best) of a block of either side: sums over right rows of one r."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        left, right = whole.filter(pc.invert(whole.column("right"))), whole.filter(whole.column("right"))
        if not left.num_rows or not right.num_rows:
            return
        known: dict = {}
        of = np.array([known.setdefault(r, len(known)) for r in right.column("r").to_pylist()])
        order = np.argsort(of, kind="stable")
        right, starts = right.take(pa.array(order)), np.searchsorted(of[order], np.arange(len(known)))
        a, b = _matrix(left.column("v")), _matrix(right.column("v"))
        units, across = _units(left.column("v")), _units(right.column("v")).T
        floor = right.column("floor").to_numpy()
        weight = right.column("weight").to_numpy()
        weighs = right.column("weight").is_valid().to_numpy()
        codes, admitted = _admits(left.column("tag"), right.column("tags")) if tagged else (None, None)
        step = max(min(SCORES // len(b), HANDED // len(known)), 1)
        for at in range(0, len(a), step):
            with np.errstate(invalid="ignore", divide="ignore"):
                scores = units[at : at + step] @ across
                open_ = scores >= floor - HAIR
                if tagged:
                    open_ &= admitted[codes[at : at + step]]
                i, j = np.nonzero(open_ & (scores <= floor + HAIR))
                scores[i, j] = _exact(a, b, at + i, j)
                open_[i, j] = scores[i, j] >= floor[j]
                each = lambda x, how=np.add: how.reduceat(x, starts, axis=1)
                weighing = open_ & weighs
                weighted, total = each(np.where(weighing, scores * weight, 0.0)), each(np.where(weighing, weight, 0.0))
                best = each(np.where(open_, scores, -np.inf), np.maximum)
            none = ~each(weighing, np.logical_or)
            i, j = np.nonzero(each(open_, np.logical_or))
            number = lambda x: pa.array(x[i, j], mask=none[i, j])
            yield pa.record_batch(
                [
                    left.column("l").take(pa.array(at + i)).combine_chunks(), right.column("r").take(pa.array(starts[j])).combine_chunks(),
                    number(weighted), number(total), pa.array(best[i, j]),
                ],
                names=["l", "r", "weighted", "weight", "best"],
            )

    return gather


def _near(per: str | None, tagged: bool, ceiling: bool):
    """(l, r, score, sure, k) of a block of either side; ``per`` names the side whose rows have a number k of nearest ones."""

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        one, other = (right, left) if per == "r" else (left, right)
        if left.num_rows and right.num_rows:
            a, b = _units(one.column("v")), _units(other.column("v")).T
            floor = right.column("floor").to_numpy() - HAIR
            highest = right.column("ceiling").to_numpy(zero_copy_only=False).astype(np.float64) if ceiling else None
            codes, admitted = _admits(left.column("tag"), right.column("tags")) if tagged else (None, None)
            k = one.column("k").to_numpy() if per else None
            step = max(SCORES // other.num_rows, 1)
            for at in range(0, len(a), step):
                here = slice(at, at + step)
                # Rows are of the side that chooses; what belongs to right rows lies along it or across.
                across = (lambda x: x[here, None]) if per == "r" else (lambda x: x[None, :])
                with np.errstate(invalid="ignore"):
                    scores = a[here] @ b
                    open_ = scores >= across(floor)
                    if tagged:
                        open_ &= admitted[codes][:, here].T if per == "r" else admitted[codes[here]]
                    unsure = np.zeros_like(open_)
                    if ceiling:
                        top = across(np.where(np.isnan(highest), np.inf, highest))
                        unsure = open_ & (np.abs(scores - top) <= HAIR)
                        open_ &= scores < top - HAIR
                    if per:
                        kept = np.where(open_, scores, -np.inf)
                        open_ = (kept >= kth_best(kept, k[here])[:, None] - HAIR) & open_
                i, j = np.nonzero(open_ | unsure)
                found.append((i + at, j, scores[i, j], ~unsure[i, j]))
        i, j, score, sure = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
        l, r = (j, i) if per == "r" else (i, j)
        out = {"l": left.column("l").take(pa.array(l)), "r": right.column("r").take(pa.array(r)), "score": pa.array(score), "sure": pa.array(sure)}
        return pa.table(out | ({"k": one.column("k").take(pa.array(i)).cast(pa.int32())} if per else {}))

    return near


def _fitting(rows: DataFrame) -> DataFrame:
    """Rows whose vector has the size it says and no null in it."""
    return rows.where((F.size("v") == F.col("dimensions")) & F.forall("v", lambda x: x.isNotNull()))


def _per_block(block_bytes: int) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (F.col("dimensions") * 8 + 64)))


def _side(columns: list[str], names: list[str]) -> list[str]:
    return [c for c in names if c in columns]


def multiplied(a: DataFrame, b: DataFrame, group: list[str], per: str | None = None) -> DataFrame:
    """(l, r, score, sure[, k]) of all groups of rows of either side that meet."""
    tagged, ceiling = "tag" in a.columns, "ceiling" in b.columns
    own = [*group, *_side(a.columns, ["l", "v", "tag", "k"])]
    theirs = [*group, *_side(b.columns, ["r", "v", "floor", "tags", "ceiling", "k"])]
    fields = [T.StructField("l", a.schema["l"].dataType), T.StructField("r", b.schema["r"].dataType), T.StructField("score", T.DoubleType()), T.StructField("sure", T.BooleanType())]
    fields += [T.StructField("k", T.IntegerType())] if per else []
    b = b.withColumn("floor", F.col("floor").cast("double"))
    met = a.select(*own).groupBy(*group).cogroup(b.select(*theirs).groupBy(*group))
    return met.applyInArrow(_near(per, tagged, ceiling), T.StructType(fields))


def met(left: DataFrame, right: DataFrame, key: list[str], block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Both sides cut by a hash into blocks, each row once for each block of the other side: those that meet share key, row and column.

    Blocks have at most ``block_bytes``, or, where a side would have more than ``COPIES`` of
    these, a ``COPIES``th of the side, up to ``BLOCK_BYTES``: what is sent grows with the
    rows times the number of full blocks, and not with that of small ones.
    """
    return blocks(_fitting(left), _fitting(right), key, "l", "of" if "of" in right.columns else "r", block_bytes)


def blocks(left: DataFrame, right: DataFrame, key: list[str], of_left: str, of_right: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """As ``met``, of rows that are as they should be; ``of_left`` and ``of_right`` are hashed."""
    per = lambda n: F.ceil(F.count("*") / F.first(_per_block(n))).cast("int")
    pieces = F.greatest(F.least(per(block_bytes), F.lit(COPIES)), per(max(block_bytes, BLOCK_BYTES)))
    number = lambda df, name: df.groupBy(*key).agg(pieces.alias(name))
    counts = number(left, "rows").join(number(right, "columns"), key)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(counts, key).withColumn("row", place(of_left, "rows")).withColumn("column", all_of("columns"))
    b = right.join(counts, key).withColumn("column", place(of_right, "columns")).withColumn("row", all_of("rows"))
    return a, b


def near_pairs(left: DataFrame, right: DataFrame, key: list[str], block_bytes: int = BLOCK_BYTES, per: str | None = None) -> DataFrame:
    """(l, r, score, sure) of rows that share ``key`` and whose vectors' cosine may reach the right row's floor.

    ``left`` has the key, l and v, ``right`` the key, r, v and floor; l and r tell
    rows apart and dimensions is one of the key. Each side of a key is cut by a hash
    into blocks of bounded bytes (see ``met``), and every two blocks meet in a group of their own,
    so a key with most rows is spread over as many tasks as it has pairs of blocks.
    Vectors move once for each block that they meet. Rows whose vector has not the
    size it says, or a null in it, are in no pair.

    With ``per`` l or r each row of that side has a number k, and only its k nearest
    are proposed, block by block, with all within a hair of the last. What decides
    before the ranking is known to the blocks: a left row's tag must be in the right
    row's list of tags (none listed: any), and a right row's ceiling is the score of
    a cursor. Pairs that lie within a hair of it are all proposed, not sure and not counted.
    """
    a, b = met(left, right, key, block_bytes)
    return multiplied(a, b, [*key, "row", "column"], per)


def gathered(left: DataFrame, right: DataFrame, key: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(l, r, weighted, weight, best) of rows as in ``near_pairs``: over all right rows of one r that reach their own floor for an l.

    Right rows have a weight, and several may have the same r: what tells them apart is of. ``weighted`` is the sum of
    cosine times weight, ``weight`` that of the weights, null where all are null, and ``best``
    the greatest cosine. Pairs are summed up where they are multiplied, block by block, so
    rows come out in proportion to l and r and no pair leaves a task; whether a pair within a
    hair of its floor counts is decided by its exact cosine.
    """
    a, b = met(left, right, key, block_bytes)
    tagged, group = "tag" in a.columns, [*key, "row", "column"]
    kinds = {"l": a.schema["l"].dataType, "r": b.schema["r"].dataType}
    shared = {"right": F.lit(False), "l": F.lit(None).cast(kinds["l"]), "r": F.lit(None).cast(kinds["r"]), "floor": F.lit(None).cast("double"), "weight": F.lit(None).cast("double")}
    shared |= {"tag": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<string>")} if tagged else {}
    one = lambda df, own: df.select(*group, "v", *[own.get(c, x).alias(c) for c, x in shared.items()])
    ours = one(a, {c: F.col(c) for c in ("l", "tag")})
    theirs = one(b, {"right": F.lit(True), "r": F.col("r"), "floor": F.col("floor").cast("double"), "weight": F.col("weight").cast("double"), "tags": F.col("tags") if tagged else None})
    fields = [T.StructField(c, kind) for c, kind in kinds.items()] + [T.StructField(c, T.DoubleType()) for c in ("weighted", "weight", "best")]
    parts = ours.unionByName(theirs).groupBy(*group).applyInArrow(_gathering(tagged), T.StructType(fields))
    return parts.groupBy("l", "r").agg(F.sum("weighted").alias("weighted"), F.sum("weight").alias("weight"), F.max("best").alias("best"))


def nearest(pairs: DataFrame, per: str) -> DataFrame:
    """Of what all blocks propose for a row the k nearest, with all within a hair of the last, and those that are not sure."""
    order = Window.partitionBy(per, "sure").orderBy(F.col("score").desc())
    last = F.max(F.when(F.col("sure") & (F.col("nth") == F.col("k")), F.col("score"))).over(Window.partitionBy(per, "sure"))
    ranked = pairs.withColumn("nth", F.row_number().over(order)).withColumn("last", last)
    return ranked.where(F.col("last").isNull() | (F.col("score") >= F.col("last") - HAIR)).select("l", "r", "score")
