"""Benchmark decontamination with a positional inverted index over the training documents.

The index is sharded by document: a shard lists, for each term of its documents,
the positions at which it occurs. A search sends the test terms to every shard
and intersects offset-adjusted position lists there, rarest term first, so text
is never shuffled and a shard's answers concern its own documents only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest_of, documents, materialise, renamed, spread

#: Bytes of text after which a shard is closed. A longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: Benchmark text searched for at once. Larger benchmarks take more blocks, each a pass over the index.
BLOCK_BYTES = 8 << 20
#: Letters of words hashed at once: each takes some 40 bytes on the way.
LETTERS = 1 << 18

INDEX_SCHEMA = "doc_ids array<{kind}>, starts array<int>, terms array<long>, ends array<int>, gaps array<int>"
#: A shard is a row group of its own, so that writers and readers hold one shard and not a file's: Parquet looks at sizes every hundred rows only.
ROW_GROUPS = {"parquet.block.row.count.limit": "1"}
#: Types of ids that an index keeps as they are; other whole numbers are kept as long.
ID_KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

_rng = np.random.default_rng(20240229)
#: A random 64-bit value a byte; a term's hash is a polynomial over these.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[ord("0") : ord("9") + 1] = True
WORD_BYTE[ord("a") : ord("z") + 1] = True
WORD_BYTE[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def term_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a byte array.

    Words are runs of ASCII letters and digits and bytes from 128 on, A-Z read as a-z.
    """
    text = LOWER[text]
    word = np.zeros(len(text) + 2, bool)
    word[1:-1] = WORD_BYTE[text]
    edges = np.flatnonzero(word[1:] != word[:-1])
    first, last = edges[0::2], edges[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first
    lengths = last - first
    ends = np.cumsum(lengths)
    sums = np.empty(len(first), np.uint64)
    begin = done = 0
    while begin < len(first):
        end = max(int(np.searchsorted(ends, done + LETTERS, side="right")), begin + 1)
        piece = text[first[begin] : last[end - 1]]
        letters = BYTE_VALUE[piece[WORD_BYTE[piece]]]
        size = lengths[begin:end]
        at = ends[begin:end] - size - done
        depth = np.arange(len(letters)) - np.repeat(at, size)
        letters *= _powers(int(size.max()))[depth]
        sums[begin:end] = np.add.reduceat(letters, at)
        begin, done = end, int(ends[end - 1])
    sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    sums ^= sums >> np.uint64(32)
    return sums, first


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank after each, and the end of each in it."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    return buffer, np.cumsum([len(t) + 1 for t in texts])


def _shard(ids: list, texts: list[bytes]) -> dict:
    buffer, ends = _joined(texts)
    terms, first = term_hashes(buffer)
    starts = np.concatenate([[0], np.searchsorted(first, ends)])
    order = np.argsort(terms, kind="stable")
    ranked = terms[order]
    cut = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else order
    gaps = np.diff(order, prepend=0)
    gaps[cut] = order[cut]
    return {
        "doc_ids": ids,
        "starts": starts.astype(np.int32),
        "terms": ranked[cut].view(np.int64),
        "ends": np.append(cut[1:], len(ranked)).astype(np.int32) if len(ranked) else cut.astype(np.int32),
        "gaps": gaps.astype(np.int32),
    }


def _shard_batches(kind: pa.DataType):
    schema = pa.schema(
        [
            ("doc_ids", pa.list_(kind)), ("starts", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())),
            ("ends", pa.list_(pa.int32())), ("gaps", pa.list_(pa.int32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            row = _shard(ids, texts)
            return pa.record_batch([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                body = text.as_py() or b""
                if held and held + len(body) > SHARD_BYTES:
                    yield close()
                    ids, texts, held = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(body)
                held += len(body) + 1
        if ids:
            yield close()

    return run


def build_index(docs: DataFrame) -> DataFrame:
    """Postings of all words of all documents, a row a shard.

    ``starts[i]`` is the shard-wide position of document i's first word and
    ``starts[-1]`` the number of words. The postings of ``terms[j]`` (sorted
    hashes) end at ``ends[j]`` in ``gaps``, which holds a term's first position
    and then the steps between positions. ``shard`` numbers the rows and is stored
    with them, so that a document is the same one in every pass over the index. Null
    texts have no words; ids may be null, repeated, numbers, strings or binary.
    """
    kind = dict(docs.dtypes)["doc_id"]
    kind = kind if kind in ID_KINDS else "bigint"
    slim = docs.select(F.col("doc_id").cast(kind), F.col("text").cast("binary").alias("text"))
    shards = slim.mapInArrow(_shard_batches(ID_KINDS[kind]), INDEX_SCHEMA.format(kind=kind))
    return materialise(shards.withColumn("shard", F.monotonically_increasing_id()), "positional-index", **ROW_GROUPS)


class Block:
    """The windows of some items: word ``k`` of window ``i`` is ``terms[words[i, k]]``, for k under ``sizes[i]``.

    A window is ``size`` consecutive words of an item; an item of fewer is one window.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], size: int):
        flat, owners, rows = [], [], []
        self.ids = [item for item, _ in items]
        before = 0
        for number, (_, text) in enumerate(items):
            terms, _ = term_hashes(np.frombuffer(text or b"", np.uint8))
            if not len(terms):
                continue
            n = max(len(terms) - size + 1, 1)
            places = np.minimum(np.arange(n)[:, None] + np.arange(size), len(terms))
            places[places == len(terms)] = -1
            rows.append(np.where(places < 0, -1, places + before))
            before += len(terms)
            flat.append(terms)
            owners.append(np.full(n, number))
        terms = np.concatenate(flat) if flat else np.empty(0, np.uint64)
        self.terms, of_word = np.unique(terms, return_inverse=True)
        words = np.concatenate(rows) if rows else np.empty((0, size), np.int64)
        used = np.where(words < 0, -1, of_word.reshape(-1)[words] if len(terms) else -1)
        keyed = np.unique(np.column_stack([np.concatenate(owners) if owners else np.empty(0, np.int64), used]), axis=0)
        self.owners, self.words = keyed[:, 0].astype(np.int32), keyed[:, 1:].astype(np.int32)
        self.sizes = (self.words >= 0).sum(axis=1)

    def possible(self, terms: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, its rows in a shard's terms, their counts) of the windows all of whose words the shard has."""
        if not len(terms) or not len(self.owners):
            return
        row = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        known = np.append(terms[row] == self.terms, True)  # the last stands for no word
        counts = np.diff(ends, prepend=0)
        for at in range(0, len(self.owners), 1 << 16):
            for i in np.flatnonzero(known[self.words[at : at + (1 << 16)]].all(axis=1)) + at:
                rows = row[self.words[i, : self.sizes[i]]]
                yield int(i), rows, counts[rows]


class ShardSearch:
    """Position lists of one shard, decoded as they are asked for."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, gaps: np.ndarray):
        self.terms, self.ends, self.gaps = terms.view(np.uint64), ends, gaps
        self.lists: dict[int, np.ndarray] = {}

    def positions(self, row: int) -> np.ndarray:
        found = self.lists.get(row)
        if found is None:
            begin = self.ends[row - 1] if row else 0
            found = self.lists[row] = np.cumsum(self.gaps[begin : self.ends[row]], dtype=np.int64)
        return found

    def phrase(self, rows: np.ndarray, counts: np.ndarray, slop: int = 0) -> np.ndarray:
        """Shard-wide positions at which the terms of these rows, with these counts, occur in sequence.

        With ``slop`` each word may stand that many places from where the rarest
        word puts it; the position returned is where the phrase would begin.
        """
        order = np.argsort(counts, kind="stable")
        begin = self.positions(int(rows[order[0]])) - order[0]
        for k in order[1:]:
            if not len(begin):
                break
            others = self.positions(int(rows[k])) - k
            at = np.searchsorted(others, begin - slop)
            at[at == len(others)] = len(others) - 1
            begin = begin[np.abs(others[at] - begin) <= slop]
        return begin


def _search_batches(sent, slop: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(n)[row].values.to_numpy(zero_copy_only=False) for n in ("starts", "terms", "ends", "gaps")}
                ids = batch.column("doc_ids")[row].values
                starts = cell["starts"]
                n_docs = len(starts) - 1
                shard = ShardSearch(cell["terms"], cell["ends"], cell["gaps"])
                hit = np.zeros(int(starts[-1]) + 1, np.int32)
                found: list[set] = [set() for _ in range(n_docs)]
                for window, rows, counts in block.possible(shard.terms, shard.ends):
                    begin = shard.phrase(rows, counts, slop)
                    begin = begin[begin >= 0]
                    doc = np.searchsorted(starts, begin, side="right") - 1
                    whole = begin + len(rows) <= starts[np.minimum(doc + 1, n_docs)]
                    begin, doc = begin[whole], doc[whole]
                    np.add.at(hit, begin, 1)
                    np.add.at(hit, begin + len(rows), -1)
                    item = block.ids[block.owners[window]]
                    if item is not None:
                        for d in np.unique(doc):
                            found[d].add(item)
                covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
                of_doc = np.searchsorted(starts, covered, side="right") - 1
                bounds = np.searchsorted(of_doc, np.arange(n_docs + 1))
                local = (covered - starts[of_doc]).astype(np.int32)
                yield pa.record_batch(
                    [
                        ids.cast(kind),
                        pa.array(np.diff(starts).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(local)),
                        pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                        pa.array([batch.column("shard")[row].as_py()] * n_docs, pa.int64()),
                        pa.array(np.arange(n_docs, dtype=np.int32)),
                    ],
                    names=["doc_id", "n_words", "hits", "items", "shard", "place"],
                )

    return run


FOUND_SCHEMA = "doc_id {kind}, n_words long, hits array<int>, items array<string>, shard long, place int"


def search(index: DataFrame, items: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """A row for each indexed document: which of its words are hit and by which items.

    ``items`` has item_id and text. ``hits`` are the places of the document's words
    inside any occurrence of a window, ``items`` the sorted ids of the items with
    an occurrence; ``slop`` over 0 asks for proximity instead of phrases. Items
    whose text is null or has no words match nothing; the words of an item without
    an id are hit, but no id is listed; rows that share an id are one item of
    several texts. Items are sent to the shards in blocks of bounded text, one at
    a time, and a document's answers to several blocks are merged.
    """
    spark = index.sparkSession
    kind = dict(index.dtypes)["doc_ids"][6:-1]
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    total = asked.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n_blocks = -(-total // BLOCK_BYTES) or 1
    found = []
    for number in range(n_blocks):
        part = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == number)
        block = Block([(r["item_id"], bytes(r["text"])) for r in part.toLocalIterator()], size)
        sent = spark.sparkContext.broadcast(block)
        one = index.mapInArrow(_search_batches(sent, slop, ID_KINDS[kind]), FOUND_SCHEMA.format(kind=kind))
        if n_blocks == 1:
            return one.select("doc_id", "n_words", "hits", "items")
        found.append(materialise(one, "index-found"))
        sent.destroy()
    both = found[0]
    for one in found[1:]:
        both = both.unionByName(one)
    merged = both.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select("doc_id", "n_words", "hits", "items")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs; columns as they are.

    Rows are looked up by a SHA-256 of their text, on which alone the answer
    depends, so repeated and null ids make no difference.
    """
    plain, named = renamed(docs)
    text = F.col(named["text"])
    index = build_index(plain.select(digest_of(text).alias("doc_id"), text.alias("text")))
    hit = search(index, items, size).where(F.size("hits") > 0).select(F.col("doc_id").alias("hit")).distinct()
    return plain.join(materialise(hit, "index-hits"), digest_of(text) == F.col("hit"), "left_anti").toDF(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's words in each row of ``documents``; null and empty texts have none, repeated rows are answered each."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = search(build_index(spread(documents(spark, sf_dir))), items)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i:least(i + 9, len(w))], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.i, g.n, v.item_id FROM grams g JOIN wins v ON g.win = v.win AND g.n = v.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
