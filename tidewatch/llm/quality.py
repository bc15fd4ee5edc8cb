"""Text quality by supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character
n-grams; a softmax over two classes reads that average. The vectors are trained
with numpy by stochastic gradient descent on a bounded sample of labelled rows.
Because both layers are linear, scoring needs one number a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, documents, materialise, spread
from .inverted_index import BYTE_VALUE, _powers

#: Hash buckets of words and n-grams, a power of two.
BUCKETS = 1 << 18
DIMENSIONS = 8
#: Most labelled rows that the classifier is fitted on, least hash of the id first.
SAMPLE_ROWS = 4096
EPOCHS = 6
RATE = 4.0
#: Score from which a document counts as good.
GOOD = 0.7
#: Distances, in words, at which a repeated word is a feature.
LAGS = 24
#: Bytes of text whose features are hashed at once: about a hundred times as much memory.
CHUNK = 1 << 20

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - (BUCKETS - 1).bit_length())


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of each word and 3- and 4-byte gram of the texts, in no given order.

    Grams may begin or end with the blank before or after a word but do not cross one.
    A word that stood up to ``LAGS`` words earlier also gives a feature for that distance.
    """
    padded = b" " + b" ".join(texts) + b" "
    t = np.frombuffer(padded, np.uint8)
    owner_ends = np.cumsum([len(x) + 1 for x in texts])
    blank = BLANK[t]
    wide = t.astype(np.uint64)
    three = wide[:-2] | wide[1:-1] << np.uint64(8) | wide[2:] << np.uint64(16)
    at3 = np.flatnonzero(~blank[1:-1])
    four = three[:-1] | wide[3:] << np.uint64(24)
    at4 = np.flatnonzero(~(blank[1:-2] | blank[2:-1]))
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    first, last = edges[0::2], edges[1::2]
    hashes = [(three[at3] | np.uint64(3) << np.uint64(56)) * _MIX, (four[at4] | np.uint64(4) << np.uint64(56)) * _MIX]
    places = [at3 + 1, at4 + 1]
    if len(first):
        lengths = last - first
        letters = BYTE_VALUE[t[~blank]]
        begin = np.cumsum(lengths) - lengths
        depth = np.arange(len(letters)) - np.repeat(begin, lengths)
        words = np.add.reduceat(letters * _powers(int(lengths.max()))[depth], begin)
        hashes.append((words ^ words >> np.uint64(31)) * _MIX)
        places.append(first)
        owner = np.searchsorted(owner_ends, first - 1, side="right")
        for lag in range(1, min(LAGS, len(words) - 1) + 1):
            again = np.flatnonzero((words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag])) + lag
            hashes.append(np.full(len(again), np.uint64(lag) << np.uint64(40), np.uint64) * _MIX)
            places.append(first[again])
    bucket = np.concatenate([h >> _SHIFT for h in hashes]).astype(np.int32)
    return bucket, np.searchsorted(owner_ends, np.concatenate(places) - 1, side="right")


def _pieces(text: bytes) -> list[bytes]:
    """The text in parts of about ``CHUNK`` bytes that end at a blank where there is one."""
    parts = []
    while len(text) > CHUNK:
        cut = text.rfind(b" ", 0, CHUNK) + 1 or CHUNK
        parts.append(text[:cut])
        text = text[cut:]
    return [*parts, text]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, share, labels = [], [], []
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            total: dict[int, int] = {}
            for piece in _pieces(text.as_py() or b""):
                bucket, n = np.unique(features([piece])[0], return_counts=True)
                for b, k in zip(bucket.tolist(), n.tolist(), strict=True):
                    total[b] = total.get(b, 0) + k
            size = max(sum(total.values()), 1)
            ids.append(np.fromiter(total, np.int32, len(total)))
            share.append(np.fromiter(total.values(), np.float32, len(total)) / size)
            labels.append(label.as_py())
        yield pa.record_batch(
            [pa.array(ids, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32())), pa.array(labels, pa.int32())],
            names=["ids", "share", "label"],
        )


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Score change of each bucket, and last the bias: the log odds of label 1."""
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = max(epochs * len(bags), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share, label = bags[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIMENSIONS, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= step * 0.1 * np.outer(mean, p)
            bias -= step * 0.01 * p
            if len(ids):
                vectors[ids] -= (step * 20) * share[:, None] * back[None, :]
    odds = out[:, 1] - out[:, 0]
    return np.append(vectors @ odds, bias[1] - bias[0]).astype(np.float32)


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bags = []
    for batch in batches:
        for ids, share, label in zip(*batch.columns, strict=True):
            bags.append((ids.values.to_numpy(), share.values.to_numpy(), label.as_py()))
    yield pa.record_batch([pa.array([train(bags)], pa.list_(pa.float32()))], names=["weights"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from at most ``sample_rows`` labelled rows that are not held out.

    The sample is the labelled ids of least hash; its bound is the only one that
    this operator has, and one task trains on it. Labels that are null or for
    absent documents are passed over; of repeated labels the lower counts, and of
    rows that share an id the text of least hash. Without labels all scores are 0.5.
    """
    chosen = (
        labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(crc_of_id(F.col("doc_id")) % 4 != 2)
        .groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    )
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = (
        docs.select(F.col("doc_id"), text.alias("text")).join(chosen, F.col("doc_id") == F.col("__id"))
        .groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"), F.min("__label").alias("label"))
        .select("least.text", "label")
    )
    bags = materialise(rows.mapInArrow(_bags, "ids array<int>, share array<float>, label int"), "quality-bags")
    # Ties are broken by content so that the order of training is the same in every run.
    ordered = bags.orderBy(F.xxhash64("ids", "label")).coalesce(1)
    row = ordered.mapInArrow(_train_batches, "weights array<float>").first()
    return np.array(row["weights"], np.float64) if row else np.zeros(BUCKETS + 1)


def scores_of(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The chance of label 1 of each text: the average of its features' weights and the bias, as a logistic."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    group: list[bytes] = []
    owner: list[int] = []
    held = 0

    def add() -> None:
        bucket, number = features(group)
        np.add.at(total, owner, np.bincount(number, weights[bucket], len(group)))
        np.add.at(count, owner, np.bincount(number, minlength=len(group)))

    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if group and held + len(piece) > CHUNK:
                add()
                group, owner, held = [], [], 0
            group.append(piece)
            owner.append(i)
            held += len(piece)
    if group:
        add()
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + weights[-1])))


def score_column(docs: DataFrame, weights: np.ndarray) -> Column:
    """The score of each row's text as a column: only the text goes to Python, the row stays where it is."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(scores_of([x.as_py() or b"" for x in batch], sent.value))

    return scored(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) for each row: the chance of label 1. Null and empty texts get the prior's."""
    return docs.select(F.col("doc_id").cast("long"), score_column(docs, weights).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, good: float = GOOD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``good`` or more; columns as they are.

    Each row is judged by its own text, so repeated and null ids and clashing
    names make no difference. Without labels to learn from all rows stay.
    """
    weights = fit(docs, labels)
    return docs.where(score_column(docs, weights) >= good) if weights.any() else docs


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of ``documents``; null and empty texts get the prior's, repeated rows equal scores."""
    docs = spread(documents(spark, sf_dir))
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, weights).select(
        "doc_id", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
