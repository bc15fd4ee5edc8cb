"""A probabilistic suffix tree whose states are the words before a token.

Events are those of ``suffix_tree_lm``: the words that training knows, the end
among them, and "unseen". A state is the last word, or the last ``DEPTH`` words,
or the start of the text where that is nearer. A state is kept if its occurrences,
each predicted from the others, gain ``GAIN`` nats over the longest kept shorter
state, and a token is scored in its longest kept state, smoothed by the shorter ones.

There are as many states as texts have different word sequences, so neither
driver nor tasks ever hold them all. Each length is one exchange: shards of texts
ask for their cells (state, event), ranges of states add up the cells of all
shards, decide which states stay and answer with their counts, from which shards
make probabilities. Beside these comes the cell's number, which is the state of the
token after it one length up, and whether training has the cell twice: a state that
occurs once gains nothing, so its cells need not be asked for. What a shorter state
says of an event goes with the cells that training has, as a count or a 32-bit float.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, scratch_path
from .suffix_tree_lm import GAIN, MAX_PARTITIONS, SCORES, _gain, _hash_piece, _shard_batches, _starts, pieces

#: Words of the longest state.
DEPTH = 2
#: Bytes of text after which a shard is closed. Larger shards repeat fewer cells, smaller ones need less memory.
SHARD_BYTES = 6 << 20
#: Bytes of stored shards for each range. Larger ranges have fewer and larger blocks of cells, smaller ones need less memory.
RANGE_BYTES = 12 << 20
#: Shuffle files go once what was made of them is stored: each exchange is read once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Cells that wait before they are merged; a range of fewer is merged once.
MERGE_CELLS = 1 << 20
#: Cells whose gain is computed at once.
GAIN_CELLS = 1 << 18

SHARD = "doc_ids array<long>, held array<boolean>, body binary"
ASK = "range long, shard long, cells binary"
ANSWER = "range long, shard long, answer binary, n long, words long, once long, size long"
FIGURES = [x.split()[0] for x in SCORES.split(", ")]
NAMES = ["range", "shard", "answer", "n", "words", "once", "size"]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte plane by byte plane, compressed."""
    parts = [np.array([len(arrays), *(len(a) for a in arrays), *(ord(a.dtype.char) for a in arrays)], np.int64).tobytes()]
    for a in arrays:
        bits = a.view(f"u{a.itemsize}")
        parts += [(bits >> 8 * k).astype(np.uint8).data for k in range(a.itemsize)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 2 * count)
    at, out = head.nbytes, []
    for length, kind in zip(head[1 : 1 + count].tolist(), head[1 + count :].tolist(), strict=True):
        size = np.dtype(chr(kind)).itemsize
        planes = np.frombuffer(data, np.uint8, length * size, at).reshape(size, length)
        bits = planes[0].astype(f"u{size}")
        for k in range(1, size):
            bits |= planes[k].astype(bits.dtype) << 8 * k
        out.append(bits.view(chr(kind)))
        at += length * size
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers of at least 0 in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as the differences to those before."""
    return narrow(np.diff(x, prepend=0))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, which are at least 0, in order, and the place of each key among them. ``keys`` itself is spent."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()) >> (63 - bits):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    else:
        # Keys with their places in the lower bits: numbers are sorted faster than places by their numbers.
        keys <<= bits
        keys |= np.arange(len(keys))
        keys.sort()
        order = keys & ((1 << bits) - 1)
        keys >>= bits
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    rank = np.cumsum(new, dtype=np.int32)
    rank -= 1
    where = np.empty(len(keys), np.int32)
    where[order] = rank
    return keys[new], where


def _inverse(order: np.ndarray) -> np.ndarray:
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return place


def root(count, totals: tuple[int, int, int]):
    """The probability of an event that occurs so often; "unseen" occurs as often as there are words that occur once."""
    n, words, once = totals
    return ((count + 0.5) / (n + once + 0.5 * (words + 1))).astype(np.float32)


def _read_shards(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard of texts in normal form: its words in order of their hashes, the place of each token's word, where documents end."""
    body = np.frombuffer(batch.column("body")[0].as_buffer(), np.uint8)
    ends = batch.column("ends")[0].values.to_numpy()
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in pieces(body):
        begin = _starts(body[a:b])
        hashes.append(_hash_piece(body[a:b], begin))
        starts.append(begin + a)
    vocab, words = np.unique(np.concatenate(hashes), return_inverse=True)
    return vocab, words.reshape(-1), np.searchsorted(np.concatenate(starts), ends)


def _word_shard_batches(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shard_batches(shard_bytes)(batches):
            vocab, words, ends = _read_shards(batch)
            # Frequent words first: most places are small numbers.
            order = np.argsort(-np.bincount(words, minlength=len(vocab)), kind="stable")
            body = packed(vocab[order], narrow(_inverse(order)[words]), steps(ends))
            yield pa.record_batch([batch.column("doc_ids"), batch.column("held"), pa.array([body], pa.binary())], names=["doc_ids", "held", "body"])
            pa.default_memory_pool().release_unused()

    return run


class Shard:
    """The tokens of a shard, and what the answers so far say of them."""

    def __init__(self, held, body: bytes):
        vocab, words, ends = unpacked(body)
        order = np.argsort(vocab)
        self.vocab, self.words = vocab[order], _inverse(order)[words]
        ends = np.cumsum(ends.astype(np.int64))
        self.lengths = np.diff(ends, prepend=0)
        self.begin = ends - self.lengths
        self.counted = np.repeat(~np.asarray(held, bool), self.lengths)

    def know(self, count: np.ndarray, number: np.ndarray, totals: tuple[int, int, int]) -> None:
        """Take the words' counts and numbers: tokens get the root's probabilities, and the last word as their state.

        From here on the words' order is that of their numbers.
        """
        order = np.argsort(number)
        count, number, self.words = count[order], number[order], _inverse(order)[self.words]
        n, words, once = totals
        self.count, self.whole = count, n + 0.5 * (words + 1)
        # Places in the vocabulary from 1 on; 0 is "unseen" as an event and the start as a state.
        self.numbers = self.names = np.append(0, number + 1)
        self.uses = np.append(once, count)
        self.event = np.where(count > 0, np.arange(1, len(count) + 1, dtype=np.int32), 0).astype(np.int32)[self.words]
        self.p = root(self.uses, totals)[self.event]
        self.twice = (count > 1)[self.words]
        # A word that training has once would be unseen were it left out.
        self.once = np.flatnonzero((count == 1)[self.words] & self.counted)
        self.p_unseen = np.full(len(self.once), root(self.uses[:1], totals)[0], np.float32)
        self.state = self._after(self.words + 1, self.twice)
        self.state[self.begin] = 0

    def _after(self, place: np.ndarray, twice: np.ndarray) -> np.ndarray:
        """The state of each token: what the one before it is, or -1 for none or one that can't be kept."""
        state = np.full(len(place), -1, np.int32)
        state[1:] = np.where(twice, place, -1)[:-1]
        state[self.begin] = -1
        return state

    def cells(self, ranges: int) -> tuple[np.ndarray, ...]:
        """Range, state, event, count, and what the shorter state says of each cell, in this order."""
        self.at = np.flatnonzero(self.state >= 0)
        self.at_once = np.flatnonzero(self.state[self.once] >= 0)
        m = len(self.at)
        state = np.concatenate([self.state[self.at], self.state[self.once[self.at_once]]])
        used = np.zeros(len(self.names), bool)
        used[state] = True
        used = np.flatnonzero(used)
        of = range_of(self.names[used], ranges)
        order = np.argsort(of, kind="stable")
        of, used = of[order], used[order]
        place = np.zeros(len(self.names), np.int64)
        place[used] = np.arange(len(used)) * len(self.numbers)
        keys = place[state]
        del state, place
        keys[:m] += self.event[self.at]
        keys, self.cell = distinct(keys)
        n = np.bincount(self.cell[:m][self.counted[self.at]], minlength=len(keys))
        n += np.bincount(self.cell[m:], minlength=len(keys))
        self.above = np.empty(len(keys), np.float32)
        self.above[self.cell[:m]] = self.p[self.at]
        self.above[self.cell[m:]] = self.p_unseen[self.at_once]
        self.of_state, what = np.divmod(keys, len(self.numbers))
        above = self.uses[what] if self.names is self.numbers else self.above
        return of[self.of_state], self.names[used][self.of_state], self.numbers[what], n, above

    def take(self, n: np.ndarray, total: np.ndarray, kinds: np.ndarray, number: np.ndarray | None = None) -> None:
        """Take the answers to the cells and their states: better probabilities, and states that are one word longer."""
        m = len(self.at)
        total, kinds = (x.astype(np.float64)[self.of_state] for x in (total, kinds))
        here = np.where(total > 0, (n + kinds * self.above) / np.maximum(total + kinds, 1), self.above).astype(np.float32)
        self.p[self.at] = here[self.cell[:m]]
        self.p_unseen[self.at_once] = here[self.cell[m:]]
        if number is None:
            return
        place, again = np.full(len(self.words), -1, np.int32), np.zeros(len(self.words), bool)
        place[self.at], again[self.at] = self.cell[:m], (n > 1)[self.cell[:m]]
        self.names = number
        self.state = self._after(place, again & self.twice)

    def sums(self) -> dict[str, np.ndarray]:
        """The figures of each document; each has its end symbol at least."""
        each = lambda x: np.add.reduceat(x, self.begin)
        return {
            "n_tokens": self.lengths, "n_known": each((self.count > 0)[self.words].astype(np.int64)),
            "base_score": each(np.log10((self.count + 0.5) / self.whole)[self.words]), "score": each(np.log10(self.p.astype(np.float64))),
        }


def range_of(states: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each state: states of one last word are spread, so a frequent word's longer states are in many."""
    x = states.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _blocks(of: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)][: len(cuts)], strict=True))


def _asked(shard: int, of: np.ndarray, pack) -> pa.Table:
    blocks = _blocks(of)
    return pa.table(
        {
            "range": pa.array([int(of[a]) for a, _ in blocks], pa.int64()), "shard": pa.array([shard] * len(blocks), pa.int64()),
            "cells": pa.array([pack(a, b) for a, b in blocks], pa.binary()),
        }
    )


def _word_asks(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, held, body in zip(*(batch.column(n) for n in ("shard", "held", "body")), strict=True):
                s = Shard(held.values.to_numpy(zero_copy_only=False), body.as_py())
                n = np.bincount(s.words, s.counted, len(s.vocab)).astype(np.int64)
                of = ((s.vocab >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                yield from _asked(shard.as_py(), of, lambda a, b, s=s, n=n: packed(s.vocab[a:b], narrow(n[a:b]))).to_batches()

    return run


def cell_block(states: np.ndarray, events: np.ndarray, n: np.ndarray, above: np.ndarray) -> bytes:
    first = _runs(states)
    step = np.diff(events, prepend=0)
    step[first] = events[first]
    above = above[n > 0]
    return packed(steps(states[first]), narrow(np.diff(first, append=len(states))), narrow(step), narrow(n), above if above.dtype.kind == "f" else narrow(above))


class WordRange:
    """What is done with a range of words: parts are words in order and their counts."""

    @staticmethod
    def read(data: bytes) -> tuple[np.ndarray, ...]:
        return tuple(unpacked(data))

    @staticmethod
    def merge(parts: list) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """The parts as one, and the place in it of each word of all parts."""
        words, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        where = where.reshape(-1)
        return (words, np.bincount(where, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)), where

    @staticmethod
    def finder(merged: tuple[np.ndarray, ...]):
        return lambda part: np.searchsorted(merged[0], part[0])

    @staticmethod
    def settle(merged: tuple[np.ndarray, ...]):
        """Counts and ranks of words, and the range's tokens, kinds, words that occur once and ranks."""
        words, count = merged
        # Frequent words have small numbers, so cells need few bytes.
        rank = _inverse(np.argsort(-count, kind="stable"))
        answer = lambda place, _: packed(narrow(count[place]), narrow(rank[place]))
        return answer, (int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), len(words))


class CellRange:
    """What is done with a range of states: parts are states in order, how many events each has, these, their counts and what the shorter state says."""

    def __init__(self, level: int, last: bool, gain: float, totals: tuple[int, int, int], span: int):
        self.level, self.last, self.gain, self.totals, self.span = level, last, gain, totals, span

    def read(self, data: bytes) -> tuple[np.ndarray, ...]:
        states, size, step, n, above = unpacked(data)
        size, step = size.astype(np.int64), step.astype(np.int64)
        events = np.cumsum(step)
        first = np.cumsum(size) - size
        events -= np.repeat(events[first] - step[first], size)
        p = np.zeros(len(n), np.float32)
        p[n > 0] = above if self.level > 1 else root(above, self.totals)
        return np.cumsum(states.astype(np.int64)), size, events, n, p

    def _keys(self, states: np.ndarray, part: tuple[np.ndarray, ...]) -> np.ndarray:
        return np.repeat(np.searchsorted(states, part[0]) * self.span, part[1]) + part[2]

    def merge(self, parts: list) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """The parts as one, and the place in it of each cell of all parts."""
        states = np.unique(np.concatenate([p[0] for p in parts]))
        keys, at = np.empty(sum(len(p[2]) for p in parts), np.int64), 0
        for part in parts:
            keys[at : at + len(part[2])] = self._keys(states, part)
            at += len(part[2])
        keys, where = distinct(keys)
        n = np.bincount(where, np.concatenate([p[3] for p in parts]), len(keys)).astype(np.int64)
        given, p = np.concatenate([p[4] for p in parts]), np.zeros(len(keys), np.float32)
        some = np.flatnonzero(given)
        p[where[some]] = given[some]
        of, events = np.divmod(keys, self.span)
        return (states, np.bincount(of, minlength=len(states)), events, n, p), where

    def finder(self, merged: tuple[np.ndarray, ...]):
        keys = self._keys(merged[0], merged)
        return lambda part: np.searchsorted(keys, self._keys(merged[0], part))

    def settle(self, merged: tuple[np.ndarray, ...]):
        """Counts of cells; tokens and kinds of their states, 0 if these are not kept."""
        states, size, _, n, p = merged
        first = np.cumsum(size) - size
        total, kinds = np.add.reduceat(n, first), np.add.reduceat((n > 0).astype(np.int64), first)
        of, gained = np.repeat(np.arange(len(states), dtype=np.int32), size), np.zeros(len(n))
        some = np.flatnonzero(n)
        for k in range(0, len(some), GAIN_CELLS):
            i = some[k : k + GAIN_CELLS]
            gained[i] = _gain(*(x.astype(np.float64) for x in (n[i], total[of[i]], kinds[of[i]], p[i])))
        kept = np.add.reduceat(gained, first) >= self.gain
        total, kinds = total * kept, kinds * kept
        told = narrow(np.where(kept[of], n, 0 if self.last else np.minimum(n, 2)))
        # Only cells that training has twice can be states, so only they have numbers of their own.
        rank = np.cumsum(n > 1) - (n > 1)

        def answer(place: np.ndarray, part: tuple[np.ndarray, ...]) -> bytes:
            at = np.searchsorted(states, part[0])
            return packed(*(narrow(x) for x in (told[place], total[at], kinds[at])), *([] if self.last else [steps(rank[place])]))

        return answer, (0, 0, 0, int((n > 1).sum()))


def _answers(kind):
    """Answers to rows that come sorted by range. A large range's rows are held as they came, its cells merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, held, waiting, size = None, [], [], [], 0

        def settled() -> Iterator[pa.RecordBatch]:
            merged, where = kind.merge([*held, *waiting])
            if held:
                # Its rows are read again one by one.
                del where
                waiting.clear()
            answer, totals = kind.settle(merged)
            if held:
                find = kind.finder(merged)
                parts = (kind.read(data) for _, data in rows)
                told = (answer(find(part), part) for part in parts)
            else:
                ends = np.cumsum([len(part[-1]) for part in waiting])
                told = (answer(place, part) for place, part in zip(np.split(where, ends[:-1]), waiting, strict=True))
            for k in range(0, len(rows), 64):
                some = rows[k : k + 64]
                figures = [totals if k == 0 and i == 0 else (0, 0, 0, 0) for i in range(len(some))]
                yield pa.record_batch(
                    [
                        pa.array([at] * len(some), pa.int64()), pa.array([s for s, _ in some], pa.int64()), pa.array([next(told) for _ in some], pa.binary()),
                        *(pa.array([t[i] for t in figures], pa.int64()) for i in range(4)),
                    ],
                    names=NAMES,
                )

        for batch in batches:
            for i, shard, data in zip(batch.column("range").to_pylist(), batch.column("shard").to_pylist(), batch.column("cells"), strict=True):
                if i != at and at is not None:
                    yield from settled()
                    rows, held, waiting, size = [], [], [], 0
                # Merged whenever as much has come as is held, so each cell is merged few times and little waits.
                if size > max(MERGE_CELLS, len(held[0][-1]) if held else 0):
                    held, waiting, size = [kind.merge([*held, *waiting])[0]], [], 0
                at, data = i, data.as_py()
                rows.append((shard, data))
                waiting.append(kind.read(data))
                size += len(waiting[-1][-1])
        if at is not None:
            yield from settled()
        pa.default_memory_pool().release_unused()

    return run


def _told(answers: pa.ListScalar, ranges: int, width: int) -> list[np.ndarray]:
    """The answers to a shard on one level in its own order; ranks, which come last and are below ``width``, become numbers."""
    rows = answers.values
    if rows is None or not len(rows):
        return []
    of, data = (pc.struct_field(rows, n) for n in ("range", "answer"))
    of = of.to_numpy()
    order = np.argsort(of, kind="stable")
    found = [unpacked(data[int(i)].as_py()) for i in order]
    for r, x in zip(of[order].tolist(), found, strict=True):
        if len(x) == 2:  # words
            x[1] = x[1].astype(np.int64) * ranges + r
        elif len(x) == 4:  # cells, but for the last level's
            x[3] = np.cumsum(x[3].astype(np.int64)) + r * width
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _informed(held: pa.ListScalar, body: pa.Scalar, told: list, totals, widths: list[int], ranges: int) -> Shard:
    """A shard that has taken the answers of the levels so far."""
    s = Shard(held.values.to_numpy(zero_copy_only=False), body.as_py())
    count, number = _told(told[0], ranges, widths[0])
    s.know(count.astype(np.int64), number, totals)
    for answers, width in zip(told[1:], widths[1:], strict=True):
        s.cells(ranges)
        found = _told(answers, ranges, width)
        if found:
            s.take(*found)
        else:
            s.state[:] = -1  # it has no state of this length, nor a longer one
    return s


def _cell_asks(level: int, totals, widths: list[int], ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, held, body, *told in zip(*(batch.column(n) for n in ("shard", "held", "body", *(f"a{k}" for k in range(level)))), strict=True):
                of, states, events, n, above = _informed(held, body, told, totals, widths, ranges).cells(ranges)
                block = lambda a, b: cell_block(states[a:b], events[a:b], n[a:b], above[a:b])  # noqa: B023, E731
                yield from _asked(shard.as_py(), of, block).to_batches()
            # What earlier shards took goes back to the system: executors count it.
            pa.default_memory_pool().release_unused()

    return run


def _score_batches(totals, widths: list[int], ranges: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, body, *told in zip(*(batch.column(n) for n in ("doc_ids", "held", "body", *(f"a{k}" for k in range(depth + 1)))), strict=True):
                s = _informed(held, body, told, totals, widths, ranges)
                own = s.sums()
                own |= {"doc_id": ids.values, "held_out": held.values, "train_tokens": np.full(len(s.lengths), totals[0], np.int64)}
                yield pa.record_batch([pa.array(own[f]) for f in FIGURES], names=FIGURES)
            pa.default_memory_pool().release_unused()

    return run


def score(docs: DataFrame, gain: float = GAIN, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Scores of each row of ``docs``, stored; columns and rows are those of ``suffix_tree_lm.score``.

    ``gain`` is over 0: so a state that training has once is never kept.
    """
    spark = docs.sparkSession
    parts = min(4 * max(docs.rdd.getNumPartitions(), 1), MAX_PARTITIONS)
    tables: list[str] = []

    def bucketed(df: DataFrame, kind: str) -> DataFrame:
        """Stored in buckets by shard: texts and answers meet there without another shuffle."""
        tables.append(f"{kind}_{uuid.uuid4().hex}")
        writer = df.write.option("path", scratch_path(spark, f"lm-{kind}")).option("compression", "uncompressed")
        writer.bucketBy(parts, "shard").saveAsTable(tables[-1])
        return spark.table(tables[-1])

    slim = docs.select(
        F.col("doc_id").cast("long"), (crc_of_id(F.col("doc_id")) % 5 == 1).alias("held"), F.col("text").cast("binary").alias("text")
    )
    cleanup = spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, "true")
        made = slim.mapInArrow(_word_shard_batches(shard_bytes), SHARD).withColumn("shard", F.monotonically_increasing_id())
        shards = bucketed(made, "shards")
        size = shards.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
        # Small tables have a range or two for each core, if these have a megabyte.
        ranges = min(max(size // range_bytes, min(2 * spark.sparkContext.defaultParallelism, size >> 20), 1), MAX_PARTITIONS)

        def answered(asks: DataFrame, kind) -> DataFrame:
            dealt = asks.repartition(ranges, "range").sortWithinPartitions("range")
            return dealt.mapInArrow(_answers(kind), ANSWER).repartition(parts, "shard")

        def told(known: DataFrame, level: int, answers: DataFrame) -> DataFrame:
            """Shards with the answers of one more level, an array a shard."""
            return known.join(answers.groupBy("shard").agg(F.collect_list(F.struct("range", "answer")).alias(f"a{level}")), "shard", "left")

        words = shards.select("shard", "held", "body").mapInArrow(_word_asks(ranges), ASK)
        answers = bucketed(answered(words, WordRange()), "answers")
        *totals, width = (int(x or 0) for x in answers.agg(F.sum("n"), F.sum("words"), F.sum("once"), F.max("size")).first())
        # All numbers of events, "unseen" among them, are below span.
        widths, span = [width], 1 + ranges * width
        known = told(shards, 0, answers)
        for level in range(1, depth + 1):
            last = level == depth
            asks = known.drop("doc_ids").mapInArrow(_cell_asks(level, totals, list(widths), ranges), ASK)
            found = answered(asks, CellRange(level, last, gain, totals, span))
            if not last:
                found = bucketed(found, "answers")
            widths.append(0 if last else int(found.agg(F.max("size")).first()[0] or 0))
            known = told(known, level, found)
        path = scratch_path(spark, "lm-scores")
        known.mapInArrow(_score_batches(totals, widths, ranges, depth), SCORES).write.option("compression", "zstd").parquet(path)
        return spark.read.schema(SCORES).parquet(path)
    finally:
        spark.conf.set(CLEANUP, cleanup)
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
