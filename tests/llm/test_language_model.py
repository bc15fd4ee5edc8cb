"""The suffix tree against plain counts, its sums, and its bounds."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import suffix_tree_lm as lm

DEPTH, UNSEEN = lm.DEPTH, "unseen"


def tokens(text):
    """(word, the bytes before it) of a text."""
    body = lm.normal_form(text)
    padded, at, out = b"\x0b" * DEPTH + body, 0, []
    for word in [*body[:-1].split(b" ")[:-1], b"\n"]:
        end = at - 1 if at else 0
        out.append((word, padded[end : end + DEPTH]))
        at += len(word) + 1
    return out


class Plain:
    """All states and their tests, one dictionary a state."""

    def __init__(self, texts, gain):
        read = [t for text in texts for t in tokens(text)]
        self.c = Counter(w for w, _ in read)
        self.n, self.v, self.once = len(read), len(self.c), sum(x == 1 for x in self.c.values())
        seen = defaultdict(Counter)
        for w, before in read:
            for d in range(1, DEPTH + 1):
                seen[before[-d:]][w] += 1
                seen[before[-d:]][UNSEEN] += self.c[w] == 1
        self.states = {}
        for state in sorted(seen, key=len):
            events = Counter({w: m for w, m in seen[state].items() if m})
            total, kinds = sum(events.values()), len(events)
            gained = sum(m * math.log((m - 1 + kinds * (q := self.p(w, state[1:]))) / (total - 1 + kinds) / q) for w, m in events.items())
            if gained >= gain:
                self.states[state] = events, total, kinds

    def p(self, word, state):
        word = word if word in self.c or word == UNSEEN else UNSEEN
        if not state:
            return ((self.once if word == UNSEEN else self.c[word]) + 0.5) / (self.n + self.once + 0.5 * (self.v + 1))
        if state not in self.states:
            return self.p(word, state[1:])
        events, total, kinds = self.states[state]
        return (events[word] + kinds * self.p(word, state[1:])) / (total + kinds)

    def score(self, text):
        return sum(math.log10(self.p(w, s)) for w, s in tokens(text))


def split(rows):
    return [(r[1] or "").encode() for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]


@pytest.fixture(scope="module")
def sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000").orderBy("doc_id").limit(120).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()] + [(900, "zzqx yy zzqx"), (901, None), (902, "ÉTÉ a b c " * 300), (903, "ÉTÉ a b c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("gain", [lm.GAIN, 2.0])
def test_scores_against_a_plain_tree(sample, gain):
    rows, docs = sample
    plain = Plain(split(rows), gain)
    assert {len(s) for s in plain.states} == {1, 2, 3}
    got = {r.doc_id: r.score for r in lm.score(docs, gain).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        assert math.isclose(got[doc_id], plain.score((text or "").encode()), rel_tol=1e-9), doc_id


def test_all_events_have_one(sample):
    plain = Plain(split(sample[0]), 2.0)
    states = random.Random(1).sample(sorted(plain.states), 20) + [b"", b"\x0b\x0b\x0b", b"zzz", b"q\xffe"]
    for state in states:
        assert math.isclose(sum(plain.p(w, state) for w in [*plain.c, UNSEEN]), 1.0, rel_tol=1e-9)


def test_most_held_out_documents_gain(spark):
    rows = lm.op8_language_model(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score > r.base_score for r in rows) >= 0.95 * len(rows)
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_bounds_change_nothing(sample):
    """Several shards with words in common, a document longer than a shard, many ranges."""
    rows, docs = sample
    want = {r.doc_id: r for r in lm.score(docs).collect()}
    shards = lm.make_shards(docs, 3000).collect()
    assert len(shards) > 40 and max(len(s.body) for s in shards) > 3000
    body, ends = np.frombuffer(bytes(shards[0].body), np.uint8), np.array(shards[0].ends)
    assert len(lm.tokens(body, ends)[0]) == sum(len(tokens((t or "").encode())) for i, t in rows if i in set(shards[0].doc_ids))
    for r in lm.score(docs, shard_bytes=3000, range_bytes=2000).collect():
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (w.held_out, w.n_tokens, w.n_known, w.train_tokens)
        assert math.isclose(r.score, w.score, rel_tol=1e-9) and math.isclose(r.base_score, w.base_score, rel_tol=1e-9)


def test_pieces_change_nothing(sample, monkeypatch):
    bodies = [lm.normal_form((t or "").encode()) for _, t in sample[0]]
    body, ends = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([len(b) for b in bodies])
    whole = lm.tokens(body, ends)
    monkeypatch.setattr(lm, "PIECE_BYTES", 7)
    assert all((a == b).all() for a, b in zip(whole, lm.tokens(body, ends), strict=True))


def test_nothing_is_left_behind(spark, sample):
    before = {t.name for t in spark.catalog.listTables()}
    lm.score(sample[1]).count()
    with pytest.raises(Exception, match="text"):
        lm.score(sample[1].drop("text"))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_cells_are_stored_as_they_are():
    words = np.array([3, 3, 9, 1 << 63], np.uint64)
    cells = lm.Cells(words, np.array([1, 2, 1, 5]), np.array([0, 4, 1, 1 << 40]))
    again = lm.Cells.of_bytes(cells.to_bytes())
    assert (again.words == words).all() and again.states.tolist() == [1, 2, 1, 5] and again.n.tolist() == [0, 4, 1, 1 << 40]
    both = lm.Cells.sum_of([cells, again])
    assert both.n.tolist() == [0, 8, 2, 1 << 41] and both.per_word.tolist() == [8, 2, 1 << 41]
    assert lm.Cells.of_bytes(lm.Cells(words[:0], words[:0].astype(int), words[:0].astype(int)).to_bytes()).per_word.tolist() == []
