"""Encoding and decoding with a SentencePiece model of byte-pair merges.

Texts are cut where no piece can reach over: before a space that follows something
else, and around characters of no piece. The distinct parts of many texts are
encoded at once, in flat arrays of symbols: each round finds every part's pair of
least rank, merges its leftmost non-overlapping places, and closes the gaps, until
no pair is left. A part then stands in the texts as often as it occurs.

Merging several places of a part in one round equals merging them one after the
other only if no pair that the new symbol makes is better. Pieces of which that
can't be said merge at one place a round, the leftmost.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, spread

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: Characters of texts that are cut at once; a longer text is cut alone.
TEXT_CHARS = 1 << 20
#: Distinct parts that a task remembers before it starts anew.
PARTS = 300_000
#: Parts of more symbols are merged by a queue: their rounds would be as many as their different merges.
LONG = 512
NEVER = np.iinfo(np.int32).max


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def wire_fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tidewatch-each-byte", _each_byte)


class Pieces:
    """The pieces of a model file and their merges, as arrays."""

    def __init__(self, model: bytes):
        top: dict[int, list] = {}
        for number, value in wire_fields(model):
            top.setdefault(number, []).append(value)
        trainer = dict(wire_fields(top.get(2, [b""])[-1]))
        normal = dict(wire_fields(top.get(3, [b""])[-1]))
        rows = [dict(wire_fields(p)) for p in top.get(1, [])]
        self.text = [r[1].decode() for r in rows]
        kinds = [r.get(3, NORMAL) for r in rows]
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or {USER, UNUSED} & set(kinds):
            raise ValueError("needs byte-pair merges with byte fallback, texts taken as they are and only normal pieces")
        self.size = len(rows)
        self.prefix = " " if normal.get(3, 1) else ""
        unknown = trainer.get(44, b" \xe2\x81\x87 ")
        self.byte_id = np.zeros(256, np.int32)
        shown: list[bytes] = []
        for i, (piece, kind) in enumerate(zip(self.text, kinds, strict=True)):
            if kind == BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
            shown.append({BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: unknown}.get(kind, lambda p: p.replace(SPACE, " ").encode())(piece))
        self.kinds = np.array(kinds)
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(self.text, kinds, strict=True)])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size

        self.ids = {p: i for i, (p, k) in enumerate(zip(self.text, kinds, strict=True)) if k == NORMAL}
        #: The symbol of each character; those of no piece are numbered after all pieces.
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        letters = {c for p in self.ids for c in p}
        for c in letters:
            if c not in self.ids:
                raise ValueError("a character of a piece is no piece")
            self.symbol[ord(" " if c == SPACE else c)] = self.ids[c]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on after a space")
        self.newline_alone = "\n" not in letters
        self._merges([r.get(2, 0.0) for r in rows])

    def _merges(self, score: list[float]) -> None:
        """All pairs that make a piece, in order of their key; ``rank`` counts distinct scores from the best."""
        order = {s: n for n, s in enumerate(sorted({score[i] for i in self.ids.values()}, reverse=True))}
        pairs = sorted((self.ids[p[:k]] * self.size + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.key = np.array([k for k, _ in pairs], np.int64)
        # One more entry stands for a pair that makes nothing.
        self.made = np.array([*(i for _, i in pairs), -1], np.int32)
        self.rank = np.array([*(order[score[i]] for _, i in pairs), NEVER], np.int32)
        uses = np.bincount([order[score[i]] for i in self.ids.values()])
        #: Least rank of the pairs that a piece is part of.
        best = np.full(self.size, NEVER, np.int64)
        for side in (self.key // self.size, self.key % self.size):
            np.minimum.at(best, side, self.rank[:-1])
        #: Whether all places of a rank may merge at once.
        self.together = np.zeros(len(order), bool)
        for i in self.ids.values():
            self.together[order[score[i]]] = uses[order[score[i]]] == 1 and best[i] > order[score[i]]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair of symbols in the tables."""
        known = (left < self.size) & (right < self.size)
        key = left.astype(np.int64) * self.size + right
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(known & (self.key[place] == key), place, len(self.key))

    @cached_property
    def _by_key(self) -> dict[int, int]:
        return {int(k): n for n, k in enumerate(self.key)}

    def queued(self, symbols: list[int]) -> list[int]:
        """The symbols of one part after all merges, best pair first, by a queue."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] < self.size and symbols[j] < self.size:
                place = self._by_key.get(symbols[i] * self.size + symbols[j])
                if place is not None:
                    heapq.heappush(heap, (int(self.rank[place]), i, symbols[j], int(self.made[place])))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while heap:
            _, i, right, made = heapq.heappop(heap)
            j = after[i]
            # What was offered may be gone, or one of its sides may have grown.
            if not alive[i] or j >= n or symbols[j] != right or int(self.made[self._by_key.get(symbols[i] * self.size + right, -1)]) != made:
                continue
            symbols[i], alive[j] = made, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, a in zip(symbols, alive, strict=True) if a]

    def merged(self, symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their parts after all merges; ``part`` numbers the parts in order."""
        out = []
        none = len(self.key)
        pairs = np.append(self.pair(symbols[:-1], symbols[1:]), none) if len(symbols) else np.empty(0, np.int64)
        pairs[:-1][part[1:] != part[:-1]] = none
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            size = np.diff(first, append=len(part))
            rank = self.rank[pairs]
            least = np.minimum.reduceat(rank, first)
            over = least == NEVER
            if over.any():
                gone = np.repeat(over, size)
                out.append((symbols[gone], part[gone]))
                symbols, part, pairs, rank = (a[~gone] for a in (symbols, part, pairs, rank))
                least, size = least[~over], size[~over]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            owner = part[at]
            # Of places that follow each other every second one merges, from the left.
            new_run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])
            run = np.flatnonzero(new_run)
            place_in_run = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            leftmost = np.concatenate([[True], owner[1:] != owner[:-1]])
            at = at[leftmost | (self.together[rank[at]] & (place_in_run % 2 == 0))]
            symbols[at] = self.made[pairs[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, part, pairs = symbols[keep], part[keep], pairs[keep]
            at -= np.arange(len(at))
            near = np.unique(np.concatenate([at, at[at > 0] - 1]))
            pairs[near] = none
            near = near[near < len(symbols) - 1]
            near = near[part[near] == part[near + 1]]
            pairs[near] = self.pair(symbols[near], symbols[near + 1])
        if not out:
            return symbols, part
        symbols, part = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(part, kind="stable")
        return symbols[order], part[order]

    def to_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in a row, and how many each has."""
        letters = self.symbol[np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        part = np.repeat(np.arange(len(parts)), size)
        long = np.repeat(size > LONG, size)
        symbols, owner = self.merged(letters[~long], part[~long])
        if long.any():
            apart = [(self.queued(letters[part == i].tolist()), i) for i in np.flatnonzero(size > LONG).tolist()]
            symbols = np.concatenate([symbols, *(np.array(s, np.int32) for s, _ in apart)])
            owner = np.concatenate([owner, *(np.full(len(s), i) for s, i in apart)])
            order = np.argsort(owner, kind="stable")
            symbols, owner = symbols[order], owner[order]
        other = np.flatnonzero(symbols >= self.size)
        if len(other):
            symbols, owner = self._as_bytes(symbols, owner, other)
        return symbols.astype(np.int32), np.bincount(owner, minlength=len(parts))

    def _as_bytes(self, symbols: np.ndarray, owner: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters of no piece as the ids of their bytes."""
        spelled = [chr(c).encode("utf-8", "replace") for c in (symbols[other] - self.size).tolist()]
        size = np.ones(len(symbols), np.int64)
        size[other] = [len(s) for s in spelled]
        first = np.cumsum(size) - size
        ids = np.repeat(symbols, size)
        flat = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        counts = size[other]
        within = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        ids[np.repeat(first[other], counts) + within] = flat
        return ids, np.repeat(owner, size)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts that consecutive ``sizes`` ids stand for."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the model")
        length = self.shown_size[ids]
        end = np.cumsum(length)
        begin = end - length
        data = self.shown[np.repeat(self.shown_at[ids] - begin, length) + np.arange(int(end[-1]) if len(end) else 0)].tobytes()
        stop = np.cumsum(sizes)
        edges = np.concatenate([[0], end])
        bounds = edges[np.concatenate([[0], stop])].tolist()
        drop = self._leading_space(ids, sizes, stop)
        out = []
        for i, skip in enumerate(drop):
            text = data[bounds[i] + skip : bounds[i + 1]]
            out.append(text.decode("utf-8", "tidewatch-each-byte"))
        return out

    def _leading_space(self, ids: np.ndarray, sizes: np.ndarray, stop: np.ndarray) -> list[int]:
        """1 for each text whose first id that is no control starts with the space that encoding puts before a text."""
        drop = []
        for a, b in zip((stop - sizes).tolist(), stop.tolist(), strict=True):
            while a < b and self.kinds[ids[a]] == CONTROL:
                a += 1
            drop.append(int(bool(self.prefix) and a < b and bool(self.spaced[ids[a]])))
        return drop


class Encoder:
    """Encodes texts part by part and remembers parts."""

    def __init__(self, pieces: Pieces, remembered: int = PARTS):
        self.pieces, self.remembered = pieces, remembered
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.at, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def parts_of(self, text: str) -> list[str]:
        """The parts of a text in order, spaces written as such; empty parts may lie between them."""
        if not text:
            return []
        text = self.pieces.prefix + text.replace(SPACE, " ")
        line = self.pieces.newline_alone
        if "  " in text:
            return re.findall(r"\n| *[^ \n]+| +" if line else r" *[^ ]+| +", text)
        if line:
            text = text.replace("\n", f"{SPACE}\n{SPACE}")
        return text.replace(" ", f"{SPACE} ").split(SPACE)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        parts: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self.parts_of(text)
            counts[i] = len(own)
            parts += own
        new = set(parts).difference(self.number)
        if len(new) + len(self.number) > self.remembered:
            self._forget()
            new = set(parts)
        if new:
            ordered = sorted(new)
            ids, size = self.pieces.to_ids(ordered)
            self.at = np.concatenate([self.at, np.cumsum(size) - size + len(self.ids)])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
            self.number.update(zip(ordered, range(len(self.number), len(self.number) + len(ordered)), strict=True))
        which = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        size = self.size[which]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[which] - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]
        upto = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(upto)


def _some(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about ``TEXT_CHARS`` together."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > TEXT_CHARS:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def _encoded_batches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Pieces(sent.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _some(texts):
                ids, sizes = encoder.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])

    return run


def _decoded_batches(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            column = batch.column(1)
            sizes = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
            texts = pieces.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digest_batches(sent):
    """Per text the number of its ids, the digest of the ids and that of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        encoder = Encoder(pieces)
        decimal = [str(i) for i in range(pieces.size)]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _some(texts):
                ids, sizes = encoder.encode(texts[a:b])
                stop = np.cumsum(sizes)
                listed = [ids[e - n : e].tolist() for e, n in zip(stop.tolist(), sizes.tolist(), strict=True)]
                of_ids = [hashlib.sha256(",".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in listed]
                del listed
                of_text = [hashlib.sha256(t.encode()).hexdigest() for t in pieces.decode(ids, sizes)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _model(spark: SparkSession, path: str):
    """The model file, as it is; its size is that of the vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row of ``docs``, as the SentencePiece library encodes with the model at ``path``.

    A null or empty text has no ids; repeated rows are encoded each; other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(_encoded_batches(_model(docs.sparkSession, path)), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ids; a null or empty list is an empty text, an id outside of the model an error."""
    slim = rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return slim.mapInArrow(_decoded_batches(_model(rows.sparkSession, path)), "doc_id long, text string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs``: its ids and the text that they decode to, as digests."""
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(_digest_batches(_model(docs.sparkSession, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Each row of ``documents`` encoded and decoded again; null and empty texts have no ids, repeated rows give equal rows, texts of any length are whole."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return round_trips(spread(documents(spark, sf_dir)), path)
