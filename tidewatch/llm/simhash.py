"""Near-duplicate groups by SimHash fingerprints.

Fingerprints are embedded by counting the set bits of each two-bit segment.
The Manhattan distance of two embeddings is at most the Hamming distance of the
fingerprints, so links are looked for by a range join on a grid over the
embedding and verified on the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import documents, materialise, spread
from .components import connected_components

SEED = 42
LOW_BITS = 0x5555555555555555
#: Shingles whose bits are counted at once, so that a very long text needs little memory.
CHUNK = 1 << 15


def shingle_hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included.

    No words give none; fewer words than ``width`` are one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, "<u8")
    shingles = (
        map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        if len(words) >= width
        else iter([b" ".join(words)])
    )
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8", max(len(words) - width + 1, 1))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, unsigned; 0 for no hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, unsigned."""
    return majority_bits(shingle_hashes(text, width))


def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            prints = np.fromiter(
                (fingerprint(x.as_py(), width) for x in texts), np.uint64, len(texts)
            )
            yield pa.record_batch(
                [batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for each row; a null text counts as empty."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(_fingerprint_batches(width), "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of the two-bit segments of each choice of ``blocks - distance`` blocks.

    Two embeddings within ``distance`` differ in at most that many blocks, so
    they agree under at least one mask.
    """
    segments = np.array_split(np.arange(32), blocks)
    block = [sum(3 << (2 * int(s)) for s in part) for part in segments]
    return [sum(chosen) for chosen in combinations(block, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp):
    """Bits set in each two-bit segment, written in unary (00, 01, 11) within the segment.

    The Manhattan distance of two embeddings is then the number of bits in which
    their unary forms differ.
    """
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(LOW_BITS))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW_BITS))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cells(prints: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(mask, cell, fp): each fingerprint in one grid cell a mask."""
    masks = F.array(
        *[
            F.struct(F.lit(i).alias("mask"), F.lit(_signed(m)).alias("bits"))
            for i, m in enumerate(block_masks(blocks, distance))
        ]
    )
    return (
        prints.select("fp", embedding(F.col("fp")).alias("e"))
        .select("fp", "e", F.inline(masks))
        .select("mask", F.col("e").bitwiseAND(F.col("bits")).alias("cell"), "fp")
    )


def _settle(group: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """For each row, the index of a row that stands for its links within its group.

    Rows are sorted by group. Pairs are compared at growing offsets, so a group
    of n rows costs n^2 / 2 comparisons of plain integers but emits n rows.
    """
    n = len(fp)
    root = np.arange(n)
    low = np.uint64(LOW_BITS)
    one = np.uint64(1)
    some, both = (fp | fp >> one) & low, (fp & fp >> one) & low
    unary = some | both << one
    left, right = [], []
    offset, alive = 1, np.arange(n - 1)
    while len(alive):
        alive = alive[alive + offset < n]
        alive = alive[group[alive] == group[alive + offset]]
        near = alive[np.bitwise_count(unary[alive] ^ unary[alive + offset]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + offset]) <= distance]
        left.append(near)
        right.append(near + offset)
        offset += 1
    a = np.concatenate(left) if left else np.empty(0, np.int64)
    b = np.concatenate(right) if right else np.empty(0, np.int64)
    while len(a):
        least = np.minimum(root[a], root[b])
        changed = root[a] != root[b]
        if not changed.any():
            break
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def _star_batches(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def stars(rows: np.ndarray) -> pa.RecordBatch:
            change = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
            group = np.concatenate([[0], np.cumsum(change)])
            fp = rows[:, 3].view(np.uint64)
            root = _settle(group, fp, distance)
            moved = np.flatnonzero(root != np.arange(len(root)))
            out = rows[:, 3]
            return pa.record_batch([pa.array(out[moved]), pa.array(out[root[moved]])], names=["a", "b"])

        for batch in batches:
            rows = np.stack(
                [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1
            )
            if not len(rows):
                continue
            held.append(rows)
            rows = np.concatenate(held)
            same = np.all(rows[:, :3] == rows[-1, :3], axis=1)
            cut = len(rows) if not same.any() else int(np.argmax(same))
            held = [rows[cut:]]
            if cut > 1:
                yield stars(np.ascontiguousarray(rows[:cut]))
        if held and len(held[0]) > 1:
            yield stars(np.ascontiguousarray(np.concatenate(held)))

    return run


def fingerprint_links(
    prints: DataFrame, distance: int = 3, blocks: int = 6, cell_rows: int = 2048
) -> DataFrame:
    """(a, b): links that join every two fingerprints within ``distance`` through a path.

    ``prints`` has distinct fingerprints, null not among them; none give no links. A cell with more than ``cell_rows``
    of them is dealt out as pairs of blocks of about that size, so no task holds
    an unbounded cell and none is dropped. A cell yields at most one link a row,
    not a row a pair; each link joins fingerprints of one component.
    """
    cells = _cells(prints, blocks, distance)
    large = (
        cells.groupBy("mask", "cell").count().where(F.col("count") > cell_rows)
        .select("mask", "cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts"))
    )
    large = materialise(large, "simhash-large")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    split = (
        cells.join(large, ["mask", "cell"])
        .select("mask", "cell", "fp", part.alias("p"), F.col("parts"))
        .select("mask", "cell", "fp", "p", other.alias("o"))
        .select("mask", "cell", (F.least("p", "o") * 1_000_000 + F.greatest("p", "o")).alias("pair"), "fp")
    )
    whole = cells.join(large, ["mask", "cell"], "left_anti").select(
        "mask", "cell", F.lit(-1).alias("pair"), "fp"
    )
    dealt = (
        whole.unionByName(split)
        .repartition("mask", "cell", "pair")
        .sortWithinPartitions("mask", "cell", "pair", "fp")
    )
    return dealt.select(
        F.col("mask").cast("long"), "cell", F.col("pair").cast("long"), "fp"
    ).mapInArrow(_star_batches(distance), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    Rows with one fingerprint are a class, and links are sought between classes
    only, so copies cost nothing. ``component_id`` is the least doc_id that can
    be reached over links of ``distance`` bits or fewer; null ids are passed over
    unless a component has no other. Texts that are null, empty or without words
    share fingerprint 0. Repeated rows are returned as often as they occur.
    """
    prints = materialise(fingerprints(docs, width), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    links = fingerprint_links(classes.select("fp"), distance)
    roots = connected_components(links, "a", "b")
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = materialise(placed.join(least, "root").select("fp", "component_id"), "simhash-roots")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents`` with its fingerprint and group; null and empty texts are one group, repeated rows stay."""
    found = near_duplicates(spread(documents(spark, sf_dir)))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
