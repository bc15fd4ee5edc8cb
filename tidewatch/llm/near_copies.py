"""SimHash near-dedup completed to a Jaccard similarity, for the corpus pipeline.

Two texts are linked if at least four fifths of their distinct five-word shingles
are shared. The first candidates are what the fingerprints' grid join links: it
brings close copies together cheaply. A pair at similarity 0.8 lies about ten of
64 bits apart, beyond any grid of such fingerprints, so further candidates are
texts that share a band of their minima under random orders of the shingles. A
band's texts are compared within tasks, by counts of the shingles that they share,
and what comes out is a forest of links, at most one a text, not a row a pair. Each
of its links is compared shingle by shingle before it counts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import digest_of, materialise, renamed
from .components import connected_components
from .simhash import fingerprint_links, majority_bits, shingle_hashes

WIDTH = 5
#: Least similarity of a link, as a fraction so that it is compared in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: At similarity 0.8 a pair shares no band with a chance of (1 - 0.8^4)^32, or 5 in 10^8.
BANDS, ROWS = 32, 4
#: Shingles whose orders are computed at once, so that a very long text needs little memory.
CHUNK = 1 << 12
#: Texts of a band in one block, and about how many distinct shingles they have. Bands beyond either are compared as
#: pairs of blocks, so that no task holds more than two blocks, or two texts.
BLOCK_ROWS, BLOCK_SHINGLES = 400, 1 << 20
#: Hashes that a task keeps of texts that it may meet again in the next band.
HELD_HASHES = 1 << 22
#: Cells of a table of texts and shared shingles that a task fills at once.
TABLE_CELLS = 1 << 22

_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None]


def shingles(text: bytes | None, width: int = WIDTH) -> set[bytes]:
    """Distinct word shingles of a text; fewer words than ``width`` are one shingle, no words none."""
    words = (text or b"").lower().split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is 0.8 or more; two texts without words are alike."""
    return DENOMINATOR * len(a & b) >= NUMERATOR * len(a | b)


def bands(hashes: np.ndarray) -> list[int]:
    """A hash for each band of the minima of the shingles' hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[at : at + CHUNK] * FACTORS + SHIFTS).min(axis=1), out=least)
    part = least.tobytes()
    step = 8 * ROWS
    return [xxh64_intdigest(part[step * i : step * i + step], i) for i in range(BANDS)]


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, prints, sizes, cells = [], [], [], []
        for x in batch.column(1):
            text = x.as_py() or b""
            hashes = shingle_hashes(text, WIDTH)
            distinct = np.unique(hashes)
            digests.append(sha256(text).digest())
            prints.append(majority_bits(hashes))
            sizes.append(len(distinct))
            cells.append(np.array(bands(distinct), np.uint64).view(np.int64))
        flat = pa.array(np.concatenate(cells) if cells else np.empty(0, np.int64))
        bounds = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS)
        fp = pa.array(np.array(prints, np.uint64).view(np.int64))
        yield pa.record_batch(
            [pa.array(digests, pa.binary()), batch.column(0), fp, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(bounds, flat)],
            names=["digest", "doc_id", "fp", "n", "cells"],
        )


def _linked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = lru_cache(8)(lambda node, text: shingles(text))
    for batch in batches:
        near = [
            similar(held(a.as_py(), x.as_py()), shingles(y.as_py()))
            for a, x, y in zip(batch.column(0), batch.column(2), batch.column(3), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))


def shared_counts(hashes: list[np.ndarray]) -> np.ndarray:
    """For each two texts, how many of their distinct hashes they share."""
    k = len(hashes)
    flat, row = np.concatenate(hashes), np.repeat(np.arange(k), [len(h) for h in hashes])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    twice = count[column] > 1
    row, column = row[twice], column[twice]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1].reshape(-1)
    out = np.zeros((k, k), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    step = max(TABLE_CELLS // k, 1)
    for low in range(0, columns, step):
        high = min(low + step, columns)
        part = slice(*np.searchsorted(column, [low, high]))
        table = np.zeros((k, high - low), np.float32)
        table[row[part], column[part] - low] = 1
        out += table @ table.T
    return out


def block_forest(roots: np.ndarray, texts: list[bytes], hashed=None) -> list[tuple[int, int]]:
    """Links that join all texts that are similar, directly or through others, and not of one root already."""
    hashes = [np.unique(shingle_hashes(t, WIDTH)) for t in texts] if hashed is None else hashed
    n = np.array([len(h) for h in hashes])
    both = shared_counts(hashes)
    near = DENOMINATOR * both >= NUMERATOR * (n[:, None] + n[None, :] - both)
    label, links = np.unique(roots, return_inverse=True)[1].reshape(-1), []
    for i in range(len(texts)):
        own = None
        while True:
            others = np.flatnonzero(near[i] & (label != label[i]))
            if not len(others):
                break
            j = int(others[0])
            own = own or shingles(texts[i])
            if similar(own, shingles(texts[j])):
                links.append((i, j))
                label[label == label[j]] = label[i]
            else:
                near[i, j] = near[j, i] = False
    return links


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of groups of rows (cell, pair, node, root, text) that follow each other."""
    held: list[tuple] = []
    # A text is in many bands.
    kept: OrderedDict[int, np.ndarray] = OrderedDict()
    size = 0

    def hashes(node: int, text: bytes) -> np.ndarray:
        nonlocal size
        found = kept.pop(node, None)
        if found is None:
            found = np.unique(shingle_hashes(text, WIDTH))
            size += len(found)
        kept[node] = found
        while size > HELD_HASHES:
            size -= len(kept.popitem(last=False)[1])
        return found

    def linked() -> pa.RecordBatch:
        nodes, roots = (np.array([r[k] for r in held], np.int64) for k in (1, 2))
        texts = [r[3] for r in held]
        links = block_forest(roots, texts, [hashes(r[1], r[3]) for r in held]) if len(held) > 1 else []
        a, b = (pa.array([nodes[x[k]] for x in links], pa.int64()) for k in (0, 1))
        return pa.record_batch([a, b], names=["a", "b"])

    for batch in batches:
        for cell, pair, node, root, text in zip(*(batch.column(i) for i in range(5)), strict=True):
            key = cell.as_py(), pair.as_py()
            if held and held[0][0] != key:
                yield linked()
                held = []
            held.append((key, node.as_py(), root.as_py(), text.as_py() or b""))
    if held:
        yield linked()


def _cell_links(members: DataFrame, roots: DataFrame | None, texts: DataFrame) -> DataFrame:
    """(a, b): links between the groups that meet in a band.

    Texts that are alike share many bands; of bands that hold the same texts, told
    by 128 bits, one is compared.
    """
    if roots is None:
        placed = members.withColumn("root", F.col("node"))
    else:
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialise(placed.select("cell", "node", "root", "n"), "near-placed")
    held = [F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("node"), "node")).alias("x2"), F.count("*").alias("texts"), F.sum("n").alias("n")]
    apart = placed.groupBy("cell").agg((F.min("root") < F.max("root")).alias("apart"), *held).where("apart")
    apart = apart.groupBy("x1", "x2", "texts", "n").agg(F.min("cell").alias("cell"))
    blocks = F.ceil(F.greatest(F.col("texts") / BLOCK_ROWS, F.least(F.col("n") / BLOCK_SHINGLES, "texts")))
    apart = apart.select("cell", blocks.cast("int").alias("parts"))
    dealt = placed.drop("n").join(apart, "cell").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.least("p", "o").cast("long") * 1_000_000 + F.greatest("p", "o")
    rows = dealt.select("cell", pair.alias("pair"), "node", "root").join(texts, "node").select("cell", "pair", "node", "root", "text")
    return rows.repartition("cell", "pair").sortWithinPartitions("cell", "pair", "node").mapInArrow(_forest_batches, "a long, b long")


def _print_pairs(classes: DataFrame) -> DataFrame:
    """(a, b) of texts that share a fingerprint, each with the first of them, or whose fingerprints are linked."""
    firsts = materialise(classes.groupBy("fp").agg(F.min("node").alias("first")), "near-firsts")
    alike = classes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(firsts.select("fp")).distinct()
    left, right = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_node")) for x in ("a", "b"))
    near = links.join(left, "a").join(right, "b")
    return alike.unionByName(near.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")))


def groups(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, root) for each distinct text of ``docs``: its least id and its group.

    Groups are the connected components of the links. What fingerprints link comes
    first; bands are compared only where they still hold several groups.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = materialise(slim.mapInArrow(_band_batches, "digest binary, doc_id long, fp long, n long, cells array<long>"), "near-bands")
    one = [F.first(c).alias(c) for c in ("fp", "n", "cells")]
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *one)
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    cells = classes.select(F.explode("cells").alias("cell"), "node", "n")
    shared = materialise(cells.groupBy("cell").count().where("count > 1").select("cell"), "near-cells")
    members = materialise(cells.join(shared, "cell"), "near-members")
    pairs = materialise(_print_pairs(classes), "near-prints")
    nodes = members.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    named = nodes.join(classes.select("node", "digest"), "node")
    texts = slim.select(digest_of(F.col("text")).alias("digest"), "text").join(named, "digest")
    texts = materialise(texts.groupBy("node").agg(F.first("text").alias("text")), "near-texts")
    compared = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
    )
    roots = _joined(None, materialise(compared.mapInArrow(_linked_batches, "a long, b long"), "near-links"))
    roots = _joined(roots, materialise(_cell_links(members, roots, texts).distinct(), "near-links"))
    return classes.join(roots, "node", "left").select("digest", "doc_id", F.coalesce("root", "node").alias("root"))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of the groups that ``roots`` and further links make: only links between its groups are followed."""
    if roots is None:
        return materialise(connected_components(links, "a", "b"), "near-roots")
    for side in ("a", "b"):
        of = roots.select(F.col("node").alias(side), F.col("root").alias("of"))
        links = links.join(of, side, "left").withColumn(side, F.coalesce("of", side)).drop("of")
    moved = connected_components(links, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("to"))
    known = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = moved.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("to").alias("root"))
    return materialise(known.unionByName(fresh), "near-roots")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group of near copies, the one of least id; columns as they are.

    A null id is taken only where a group has no other. Rows are told apart by id
    and text, so rows that share an id but are in different groups all stay. Of rows
    that share id and text too, the first by the written form of its columns stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    keep = materialise(
        groups(docs).groupBy("root").agg(first).select(F.col("first.doc_id").alias("keep_id"), F.col("first.digest").alias("keep_digest")), "near-kept"
    )
    plain, named = renamed(docs)
    marked = plain.withColumns({"kept": F.col(named["doc_id"]).cast("long"), "digest": digest_of(F.col(named["text"]))})
    same = marked["digest"].eqNullSafe(keep["keep_digest"]) & marked["kept"].eqNullSafe(keep["keep_id"])
    # A null and an empty text have one digest, so the text's absence counts too.
    order = [F.col(c).cast("string") for c in plain.columns if c not in (named["doc_id"], named["text"])]
    first = F.min_by(F.struct(*plain.columns), F.struct(F.col(named["text"]).isNull(), *order)).alias("first")
    kept = marked.join(keep, same, "left_semi").groupBy("kept", "digest").agg(first)
    return kept.select(*[F.col(f"first.{c}") for c in plain.columns]).toDF(*docs.columns)
