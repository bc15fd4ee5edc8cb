"""Language-model scores by a probabilistic suffix tree over bytes before words.

The query's tree is that of ``word_tree``, whose states are words. This one, whose
states are bytes, needs less disk; both read texts by the functions here.

A text is read as its lower-cased words and an end symbol. The events are the
words that training knows, the end among them, and one event "unseen" for all
others, as in the base score. States are the last 0 to ``DEPTH`` bytes before a
token, so they tell endings, languages and punctuation, and words of any length
share them. A state is kept if its distribution differs from that of its suffix,
by an absolute amount of information that every occurrence gains from the others
(leave-one-out), so the tree grows with the corpus. Each token is scored in the
longest kept suffix of what precedes it, smoothed by that state's suffixes with
as much weight as it has kinds of tokens.

"Unseen" is learned too: a word that occurs once would be unseen were it left out,
so in each state each such occurrence counts once for its word and once for the
event. With ``n1`` of them among ``n`` tokens of ``v`` kinds the root has
(c + 0.5) / (n + n1 + 0.5 (v + 1)), the base's form, and all events have 1.

Documents are held in shards of bounded text. The cells (word, state) of each
shard are counted by ranges of word hashes over the whole corpus and come back to
the shard that asked, in its own order, so the vocabulary is never sent anywhere
whole. Sent to all tasks are the kept states: at most 2 ** 24, as they have three
bytes, and in texts a few thousand.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, documents, materialise, scratch_path, spread
from .inverted_index import BYTE_VALUE, _powers

#: Bytes of the longest state.
DEPTH = 3
#: Least information, in nats over all training tokens, that a state adds to its suffix.
GAIN = 12.0
#: Bytes of text after which a shard is closed. Larger shards repeat fewer cells, smaller ones need less memory.
SHARD_BYTES = 16 << 20
#: Bytes of a shard that are hashed at once.
PIECE_BYTES = 1 << 20
#: Bytes of text for each range of word hashes.
RANGE_BYTES = 4 << 20
#: Most partitions to which shards and ranges are dealt.
MAX_PARTITIONS = 20_000
PAD, END, BLANK = 0x0B, 0x0A, 0x20
COUNTS, ASKED = 0, 1
CONTEXT_BITS = 8 * DEPTH

SHARD_SCHEMA = "doc_ids array<long>, held array<boolean>, ends array<int>, body binary"
CELL_SCHEMA = "range long, kind int, shard long, cells binary"


def normal_form(text: bytes | None) -> bytes:
    """Lower-cased words with one blank after each, and the end symbol, which no word contains."""
    return b" ".join([*(text or b"").lower().split(), b"\n"])


def _shard_batches(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list = []
        bodies: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(b) for b in bodies]).astype(np.int32)
            return pa.record_batch(
                [
                    pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                    pa.array([ends], pa.list_(pa.int32())), pa.array([b"".join(bodies)], pa.binary()),
                ],
                names=["doc_ids", "held", "ends", "body"],
            )

        for batch in batches:
            for doc_id, out, text in zip(*batch.columns, strict=True):
                body = normal_form(text.as_py())
                if size and size + len(body) > shard_bytes:
                    yield close()
                    ids, held, bodies, size = [], [], [], 0
                ids.append(doc_id.as_py())
                held.append(out.as_py())
                bodies.append(body)
                size += len(body)
        if ids:
            yield close()
        pa.default_memory_pool().release_unused()

    return run


def make_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents in normal form, a row a shard of about ``shard_bytes``; a longer document has its own."""
    slim = docs.select(
        F.col("doc_id").cast("long"), (crc_of_id(F.col("doc_id")) % 5 == 1).alias("held"),
        F.col("text").cast("binary").alias("text"),
    )
    return slim.mapInArrow(_shard_batches(shard_bytes), SHARD_SCHEMA).withColumn("shard", F.monotonically_increasing_id())


def pieces(body: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive parts of a shard of about ``PIECE_BYTES`` that end after a blank or an end symbol."""
    at, size = 0, len(body)
    while at < size:
        end = at + PIECE_BYTES
        while end < size:
            stops = np.flatnonzero((body[at:end] == BLANK) | (body[at:end] == END))
            if len(stops):
                end = at + int(stops[-1]) + 1
                break
            end += PIECE_BYTES
        end = min(end, size)
        yield at, end
        at = end


def _starts(body: np.ndarray) -> np.ndarray:
    """First byte of each token of a part that begins with one; the end symbol is a token."""
    symbol = (body != BLANK) & (body != END)
    symbol[1:] &= (body[:-1] == BLANK) | (body[:-1] == END)
    return np.flatnonzero(symbol | (body == END))


def _hash_piece(body: np.ndarray, begin: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.empty(0, np.uint64)
    inside = np.flatnonzero(body != BLANK)
    place = np.searchsorted(inside, begin)
    lengths = np.diff(place, append=len(inside))
    depth = np.arange(len(inside)) - np.repeat(place, lengths)
    sums = np.add.reduceat(BYTE_VALUE[body[inside]] * _powers(int(lengths.max()))[depth], place)
    sums ^= sums >> np.uint64(29)
    return sums * np.uint64(0xBF58476D1CE4E5B9)


def tokens(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of a shard: the word's hash, the ``DEPTH`` bytes before it (the last one lowest), its document.

    The blank just before a token says nothing and is left out. Before a document lies padding.
    """
    words, states, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for a, b in pieces(body):
        starts = _starts(body[a:b])
        words.append(_hash_piece(body[a:b], starts))
        starts = starts + a
        owner = np.searchsorted(ends, starts, side="right")
        state = np.zeros(len(starts), np.int64)
        for k in range(DEPTH):
            at = starts - 2 - k
            state |= np.where(at >= begin[owner], body[np.maximum(at, 0)], PAD).astype(np.int64) << (8 * k)
        states.append(state)
        owners.append(owner)
    return np.concatenate(words), np.concatenate(states), np.concatenate(owners)


def distinct(words: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and the place of each pair among them."""
    order = np.lexsort((states, words))
    words, states = words[order], states[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (states[1:] != states[:-1])
    where = np.empty(len(words), np.int64)
    where[order] = np.cumsum(new) - 1
    return words[new], states[new], where


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed bytes."""
    head = np.array([len(arrays), *(len(a) for a in arrays), *(ord(a.dtype.char) for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpacked(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 2 * count)
    at, out = head.nbytes, []
    for length, kind in zip(head[1 : 1 + count].tolist(), head[1 + count :].tolist(), strict=True):
        out.append(np.frombuffer(data, np.dtype(chr(kind)), length, at))
        at += out[-1].nbytes
    return out


class Cells:
    """Counts of pairs (word, state), in order of word and state."""

    def __init__(self, words: np.ndarray, states: np.ndarray, n: np.ndarray):
        self.words, self.states, self.n = words, states, n
        self.first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else np.empty(0, np.int64)

    @property
    def kinds(self) -> np.ndarray:
        """The distinct words."""
        return self.words[self.first]

    @property
    def index(self) -> np.ndarray:
        """The place of each cell's word among the distinct words."""
        return np.repeat(np.arange(len(self.first)), np.diff(self.first, append=len(self.words)))

    @property
    def per_word(self) -> np.ndarray:
        return np.add.reduceat(self.n, self.first) if len(self.first) else np.empty(0, np.int64)

    def to_bytes(self) -> bytes:
        return packed(self.kinds, np.diff(self.first, append=len(self.words)).astype(np.uint32), self.states.astype(np.uint32), self.n.astype(np.int64))

    @staticmethod
    def of_bytes(data: bytes) -> Cells:
        kinds, lengths, states, n = unpacked(data)
        return Cells(np.repeat(kinds, lengths), states.astype(np.int64), n)

    @staticmethod
    def sum_of(parts: list[Cells]) -> Cells:
        words, states, where = distinct(np.concatenate([p.words for p in parts]), np.concatenate([p.states for p in parts]))
        return Cells(words, states, np.bincount(where, np.concatenate([p.n for p in parts]), len(words)).astype(np.int64))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = []
            for name in names:
                cell = batch.column(name)[i]
                if name == "body":
                    row.append(np.frombuffer(cell.as_buffer(), np.uint8))
                elif isinstance(cell, pa.ListScalar):
                    row.append(cell.values.to_numpy(zero_copy_only=False) if cell.values is not None else np.empty(0))
                else:
                    row.append(cell.as_py())
            yield row


def _cell_rows(ranges: int, kind: int, shards: list, cells: list) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(ranges, pa.int64()), pa.array([kind] * len(cells), pa.int32()), pa.array(shards, pa.int64()), pa.array(cells, pa.binary())],
        names=["range", "kind", "shard", "cells"],
    )


def _asked_batches(bits: int):
    """The cells of each shard, a row a range of word hashes; held-out documents ask but do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, body, ends, held in _rows(batches, "shard", "body", "ends", "held"):
            words, states, owner = tokens(body, ends)
            counted = (~held.astype(bool))[owner]
            words, states, where = distinct(words, states)
            n = np.bincount(where, counted, len(words)).astype(np.int64)
            del where, counted, owner
            of = (words >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
            for some in np.array_split(np.arange(len(cuts)), max(len(cuts) // 32, 1)):
                bounds = [(int(cuts[k]), int(cuts[k + 1]) if k + 1 < len(cuts) else len(words)) for k in some.tolist()]
                cells = [Cells(words[a:b], states[a:b], n[a:b]).to_bytes() for a, b in bounds]
                yield _cell_rows(of[cuts[some]].tolist(), ASKED, [shard] * len(cells), cells)
            # What earlier shards took goes back to the system: executors count it.
            pa.default_memory_pool().release_unused()

    return run


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by range, and after those of a range its counts over all shards."""
    at, held, waiting, size = None, None, [], 0

    def settled() -> Cells:
        return Cells.sum_of([*([held] if held is not None else []), *waiting])

    for batch in batches:
        for i, data in zip(batch.column("range").to_pylist(), batch.column("cells"), strict=True):
            if i != at and at is not None:
                yield _cell_rows([at], COUNTS, [-1], [settled().to_bytes()])
                held, waiting, size = None, [], 0
            at = i
            waiting.append(Cells.of_bytes(data.as_py()))
            size += len(waiting[-1].words)
            # Merged whenever as much has come as is held, so each cell is merged few times and little waits.
            if size > max(1 << 18, 0 if held is None else len(held.words)):
                held, waiting, size = settled(), [], 0
        yield batch
    if at is not None:
        yield _cell_rows([at], COUNTS, [-1], [settled().to_bytes()])


def by_level(cells: Cells) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of a state from 1: word index, state and count of each pair, the pair it is in one level up, the pair of each cell."""
    index = cells.index
    above = np.arange(len(cells.first))
    for level in range(1, DEPTH + 1):
        keys, where = np.unique(index << CONTEXT_BITS | cells.states & ((1 << (8 * level)) - 1), return_inverse=True)
        where = where.reshape(-1)
        word, state = keys >> CONTEXT_BITS, keys & ((1 << CONTEXT_BITS) - 1)
        up = word if level == 1 else np.searchsorted(above, word << CONTEXT_BITS | state & ((1 << (8 * (level - 1))) - 1))
        yield word, state, np.bincount(where, cells.n, len(keys)), up, where
        above = keys


def _numbers(level: int, state: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    names = ["level", "state", *(f"v{i}" for i in range(len(values)))]
    return pa.record_batch([pa.array(np.full(len(state), level, np.int32)), pa.array(state.astype(np.int64)), *(pa.array(v.astype(np.float64)) for v in values)], names=names)


def _by_state(state: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, where = np.unique(state, return_inverse=True)
    return keys, [np.bincount(where.reshape(-1), v, len(keys)) for v in values]


def _total_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, state, tokens, kinds, tokens of words that occur once) of each range; level 0 is the root."""
    for (data,) in _rows(batches, "cells"):
        cells = Cells.of_bytes(data)
        c = cells.per_word
        yield _numbers(0, np.zeros(1), np.array([c.sum()]), np.array([(c > 0).sum()]), np.array([(c == 1).sum()]))
        for level, (word, state, n, _, _) in enumerate(by_level(cells), 1):
            yield _numbers(level, *(lambda k, v: (k, *v))(*_by_state(state, n, n > 0, n * (c[word] == 1))))


class Tree:
    """Totals of the states of each length, and the probability of "unseen" in each.

    ``levels[d]`` has, for the states of d bytes in order: the state, its events
    (tokens and unseen ones), its kinds of events, its unseen ones. A state's suffix
    is the longest shorter one that is here.
    """

    def __init__(self, n: int, words: int, once: int, levels: dict[int, tuple[np.ndarray, ...]]):
        self.n, self.words, self.once = n, words, once
        self.whole = n + once + 0.5 * (words + 1)
        self.levels, self.unseen = levels, {}
        for d, (state, events, kinds, once_here) in levels.items():
            self.unseen[d] = (once_here + kinds * self.unseen_after(state, d)) / (events + kinds)

    def unseen_after(self, states: np.ndarray, below: int = DEPTH + 1) -> np.ndarray:
        """The probability of "unseen" in the longest suffix of each state that is here and has less than ``below`` bytes."""
        p = np.full(len(states), (self.once + 0.5) / self.whole)
        for d in range(1, min(below, len(self.levels) + 1)):
            here, place = self.find(d, states & ((1 << (8 * d)) - 1))
            p[here] = self.unseen[d][place]
        return p

    def root(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / self.whole

    def find(self, d: int, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states are here, and the place of each that is."""
        keys = self.levels[d][0]
        place = np.searchsorted(keys, states)
        here = place < len(keys)
        here[here] = keys[place[here]] == states[here]
        return here, place[here]


def _gain(m, events, kinds, up):
    """Information that occurrences of an event gain in a state over its suffix, each predicted from the others."""
    some = m > 0
    m, events, kinds = (np.where(some, x, 1.0) for x in (m, events, kinds))
    ratio = (m - 1 + kinds * up) / (events - 1 + kinds) / up
    return np.where(some, m * np.log(ratio), 0.0)


def probabilities(cells: Cells, tree: Tree) -> Iterator[tuple[np.ndarray, ...]]:
    """For each level of the tree: count of its pairs, each word's probability in the suffix and here, the pair of each cell, which pairs have a state here and where it is."""
    p = tree.root(cells.per_word)
    for level, (_, state, n, up, where) in zip(tree.levels, by_level(cells), strict=False):
        above = p[up]
        here, place = tree.find(level, state)
        _, events, kinds, _ = tree.levels[level]
        p = above.copy()
        p[here] = (n[here] + kinds[place] * above[here]) / (events[place] + kinds[place])
        yield n, above, p, where, here, place


def _gain_batches(sent):
    """(level, state, gain) of each range for the longest states of a tree: the sum over its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = sent.value
        level = len(tree.levels)
        states, events, kinds, _ = tree.levels[level]
        for (data,) in _rows(batches, "cells"):
            *_, (n, above, _, _, here, place) = probabilities(Cells.of_bytes(data), tree)
            keys, (gain,) = _by_state(place, _gain(n[here], events[place], kinds[place], above[here]))
            yield _numbers(level, states[keys], gain)

    return run


def _values(cells: Cells, tree: Tree) -> np.ndarray:
    """log10 of the probability of each cell's word in its state; words without a count are the unseen event."""
    *_, (_, _, p, where, _, _) = probabilities(cells, tree)
    p = p[where]
    unknown = (cells.per_word == 0)[cells.index]
    p[unknown] = tree.unseen_after(cells.states[unknown])
    return np.log10(p)


def _answer_batches(sent):
    """(shard, range, answer): to each shard the counts of its words and the values of its cells, in its own order.

    Rows come sorted by range, the range's counts first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = sent.value
        kinds = count = keys = values = None
        for batch in batches:
            shards, ranges, answers = [], [], []
            for i, kind, shard, data in _rows([batch], "range", "kind", "shard", "cells"):
                cells = Cells.of_bytes(data)
                if kind == COUNTS:
                    kinds, count, values = cells.kinds, cells.per_word, _values(cells, tree)
                    keys = cells.index << CONTEXT_BITS | cells.states
                    continue
                word = np.searchsorted(kinds, cells.kinds)
                place = np.searchsorted(keys, word[cells.index] << CONTEXT_BITS | cells.states)
                shards.append(shard)
                ranges.append(i)
                answers.append(packed(count[word], values[place]))
            yield pa.record_batch([pa.array(shards, pa.int64()), pa.array(ranges, pa.int64()), pa.array(answers, pa.binary())], names=["shard", "range", "answer"])

    return run


def _collected(rows: DataFrame, values: int) -> dict[int, list[np.ndarray]]:
    """The sums of (level, state, values) over all ranges, by level and in order of the state: at most 2 ** 24 states a level."""
    summed = rows.groupBy("level", "state").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(values))).toArrow()
    columns = [summed.column(c).to_numpy() for c in summed.column_names]
    out = {}
    for level in range(DEPTH + 1):
        own = columns[0] == level
        order = np.argsort(columns[1][own])
        out[level] = [c[own][order] for c in columns[1:]]
    return out


def grown(counts: DataFrame, gain: float = GAIN) -> Tree:
    """The tree that the counted cells of all ranges teach: its states gain at least ``gain`` over their suffix.

    Levels are decided one after the other, as a state's suffix is the longest kept one.
    Without training there is only the root, where nothing is known.
    """
    context = counts.sparkSession.sparkContext
    totals = _collected(counts.mapInArrow(_total_batches, "level int, state long, v0 double, v1 double, v2 double"), 3)
    n, words, once = (int(x.sum()) for x in totals.pop(0)[1:])
    tree = Tree(n, words, once, {})
    for d, (state, here, kinds, once_here) in totals.items():
        some = here > 0
        level = tuple(a[some] for a in (state, here + once_here, kinds + (once_here > 0), once_here))
        tried = Tree(n, words, once, tree.levels | {d: level})
        sent = context.broadcast(tried)
        found, gained = _collected(counts.mapInArrow(_gain_batches(sent), "level int, state long, v0 double"), 1)[d]
        sent.destroy()
        total = _gain(level[3], level[1], level[2], tried.unseen_after(level[0], d))
        total[np.searchsorted(level[0], found)] += gained
        tree = Tree(n, words, once, tree.levels | {d: tuple(a[total >= gain] for a in level)})
    return tree


def _score_groups(n_train: int, n_words: int):
    """Scores of the documents of a shard from the answers to its cells."""

    def scored(shard: pa.Table, answers: pa.Table) -> pa.Table:
        row = {n: shard.column(n)[0] for n in ("doc_ids", "held", "ends", "body")}
        body, ends = np.frombuffer(row["body"].as_buffer(), np.uint8), row["ends"].values.to_numpy()
        words, states, owner = tokens(body, ends)
        words, _, where = distinct(words, states)
        order = np.argsort(answers.column("range").to_numpy())
        found = [unpacked(answers.column("answer")[int(i)].as_py()) for i in order]
        count, value = (np.concatenate(x) for x in zip(*found, strict=True))
        index = np.cumsum(np.concatenate([[False], words[1:] != words[:-1]]))
        c = count[index][where]
        sums = lambda x=None: np.bincount(owner, x, len(ends))
        return pa.table(
            {
                "doc_id": row["doc_ids"].values, "held_out": row["held"].values, "n_tokens": sums().astype(np.int64),
                "n_known": sums(c > 0).astype(np.int64), "train_tokens": np.full(len(ends), n_train, np.int64),
                "base_score": sums(np.log10((c + 0.5) / (n_train + 0.5 * (n_words + 1)))), "score": sums(value[where]),
            }
        )

    return scored


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score(docs: DataFrame, gain: float = GAIN, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Scores of each row of ``docs``; a null or empty text is its end symbol alone.

    Learned from the rows whose crc32(doc_id) mod 5 is not 1; a null id counts
    as the empty text. Repeated rows count as often as they occur, an empty table
    gives no rows. Shards lie in buckets, so that answers come to them and texts are not shuffled.
    """
    spark = docs.sparkSession
    table = f"shards_{uuid.uuid4().hex}"
    parts = min(4 * max(docs.rdd.getNumPartitions(), 1), MAX_PARTITIONS)
    try:
        make_shards(docs, shard_bytes).write.option("path", scratch_path(spark, "lm-shards")).option("compression", "zstd").bucketBy(parts, "shard").saveAsTable(table)
        shards = spark.table(table)
        size = shards.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
        bits = max(int(size // range_bytes).bit_length(), 1)
        ranges = min(1 << bits, MAX_PARTITIONS)
        path = scratch_path(spark, "lm-cells")
        asked = shards.select("shard", "body", "ends", "held").mapInArrow(_asked_batches(bits), CELL_SCHEMA)
        dealt = asked.repartition(ranges, "range").sortWithinPartitions("range")
        dealt.mapInArrow(_count_batches, CELL_SCHEMA).write.partitionBy("kind").option("compression", "uncompressed").parquet(path)
        cells = spark.read.schema(CELL_SCHEMA).parquet(path)
        tree = grown(cells.where(F.col("kind") == COUNTS).select("cells"), gain)
        sent = spark.sparkContext.broadcast(tree)
        answers = cells.select("range", "kind", "shard", "cells").repartition(ranges, "range").sortWithinPartitions("range", "kind").mapInArrow(
            _answer_batches(sent), "shard long, range long, answer binary"
        )
        met = shards.groupBy("shard").cogroup(answers.repartition(parts, "shard").groupBy("shard"))
        return materialise(met.applyInArrow(_score_groups(tree.n, tree.words), SCORES), "lm-scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each row of ``documents`` by the tree whose states are words; null and empty texts are their end symbol, repeated rows score alike."""
    from . import word_tree  # it reads texts as this module does

    return word_tree.score(spread(documents(spark, sf_dir)))
