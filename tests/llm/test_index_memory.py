"""The positional index in bounded memory: words are hashed in pieces, a stored shard is read by itself."""

import tracemalloc

import numpy as np
import pyarrow.parquet as pq

from tidewatch.llm import inverted_index


def text_of(n, blanks, seed=0):
    rng = np.random.default_rng(seed)
    return np.where(rng.random(n) < blanks, 32, rng.integers(97, 123, n)).astype(np.uint8)


def test_hashing_takes_little_more_than_the_text(monkeypatch):
    text = text_of(8 << 20, 0.16)
    tracemalloc.start()
    whole = inverted_index.term_hashes(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 14 * len(text)
    small = text[:20_000]
    want = inverted_index.term_hashes(small)
    monkeypatch.setattr(inverted_index, "LETTERS", 7)
    for got, one in zip(inverted_index.term_hashes(small), want, strict=True):
        assert (got == one).all()
    assert (whole[0][: len(want[0]) - 1] == want[0][:-1]).all()


def test_a_shard_is_a_row_group(spark, monkeypatch):
    monkeypatch.setattr(inverted_index, "SHARD_BYTES", 1000)
    docs = spark.createDataFrame([(i, "some words of a text " * 10) for i in range(40)], "doc_id long, text string").coalesce(1)
    index = inverted_index.build_index(docs)
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")) for f in index.inputFiles()]
    shards = sum(f.metadata.num_rows for f in files)
    assert shards > 5 and sum(f.num_row_groups for f in files) == shards
