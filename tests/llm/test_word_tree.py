"""The tree of words against plain counts, and its bounds."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import suffix_tree_lm, word_tree

START, UNSEEN = "start", "unseen"


def tokens(text):
    """(word, its states from short to long) of a text."""
    read = [START, *(text or "").encode().lower().split(), b"\n"]
    return [(read[k], [tuple(read[k - d : k]) for d in range(1, min(k, word_tree.DEPTH) + 1)]) for k in range(1, len(read))]


class Plain:
    def __init__(self, texts, gain):
        read = [t for text in texts for t in tokens(text)]
        self.c = Counter(w for w, _ in read)
        self.n, self.v, self.once = len(read), len(self.c), sum(x == 1 for x in self.c.values())
        seen = defaultdict(Counter)
        for w, states in read:
            for state in states:
                seen[state][w] += 1
                seen[state][UNSEEN] += self.c[w] == 1
        self.states = {}
        for state in sorted(seen, key=len):
            events = {w: m for w, m in seen[state].items() if m}
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
        return (events.get(word, 0) + kinds * self.p(word, state[1:])) / (total + kinds)

    def score(self, text):
        return sum(math.log10(self.p(w, states[-1])) for w, states in tokens(text))


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("the of and to Ab é x1 yy q --".split()) if rng.random() < 0.7 else f"w{rng.randrange(400)}"
    texts = [" ".join(word() for _ in range(rng.randrange(80))) for _ in range(120)]
    texts += [None, "", " \t", "new York city " * 30, "in new York city", "once-only words here", texts[3], texts[3]]
    texts += [" ".join(rng.choice(["red sits left", "blue sits right"]) for _ in range(30)) for _ in range(10)]
    rows = list(enumerate(texts))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("gain", "bounds"), [(word_tree.GAIN, {}), (1.0, {}), (1.0, {"shard_bytes": 900, "range_bytes": 300})])
def test_scores_against_a_plain_tree(sample, gain, bounds, monkeypatch):
    monkeypatch.setattr(word_tree, "MERGE_CELLS", 10)
    rows, docs = sample
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    plain = Plain([t for i, t in rows if not held[i]], gain)
    assert {len(s) for s in plain.states} == {1, 2}
    got = {r.doc_id: r for r in word_tree.score(docs, gain, **bounds).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        read = [w for w, _ in tokens(text)]
        base = sum(math.log10((plain.c[w] + 0.5) / (plain.n + 0.5 * (plain.v + 1))) for w in read)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(read), sum(w in plain.c for w in read), plain.n)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and math.isclose(got[i].score, plain.score(text), rel_tol=1e-6), i


def test_words_before_a_word_are_its_state(spark, tmp_path):
    """Words with the same three last bytes are different states of the query's tree."""
    rng = random.Random(2)
    texts = [" ".join(f"{a} {b}" for a, b in (rng.choice([("station", "one"), ("nation", "two")]) for _ in range(40))) for _ in range(60)]
    rows = [*enumerate(texts), (1000, "station one " * 40), (1001, "station two " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in suffix_tree_lm.op8_language_model(spark, str(tmp_path)).collect()}
    assert got[1000] > got[1001] + 40


def test_odd_tables(spark, sample):
    before = {t.name for t in spark.catalog.listTables()}
    assert word_tree.score(sample[1].limit(0)).count() == 0
    rows = word_tree.score(spark.createDataFrame([(None, None), (None, "a"), (3, "a")], "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 2, 2] and all(math.isfinite(r.score) for r in rows)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_ranges_merged_once_and_in_parts_agree(sample, monkeypatch):
    rows, docs = sample
    plain = Plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], 1.0)
    got = {}
    for cells in (10, word_tree.MERGE_CELLS):
        monkeypatch.setattr(word_tree, "MERGE_CELLS", cells)
        got[cells] = {r.doc_id: r.score for r in word_tree.score(docs, 1.0, shard_bytes=900, range_bytes=2000).collect()}
    one, other = got.values()
    assert one == other and all(math.isclose(one[i], plain.score(text), rel_tol=1e-6) for i, text in rows)


@pytest.mark.parametrize("top", [50, 1 << 40, 1 << 60])
def test_distinct_keys(top):
    keys = np.random.default_rng(3).integers(0, top, 400)
    keys[200:] = keys[:200]
    own, where = word_tree.distinct(keys.copy())
    assert own.tolist() == sorted(set(keys.tolist())) and (own[where] == keys).all()
    assert [len(x) for x in word_tree.distinct(keys[:0])] == [0, 0]


def test_answers_hold_counts_not_a_probability_a_cell(spark, tmp_path, monkeypatch):
    """What shards are told of states, most of which are not kept, is stored in under a byte a token; it took 3.5."""
    paths = []
    monkeypatch.setattr(word_tree, "scratch_path", lambda _, name: paths.append(tmp_path / f"{name}-{len(paths)}") or str(paths[-1]))
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(3000 * rng.random() ** 3)}" for _ in range(400))) for i in range(500)]
    tokens = word_tree.score(spark.createDataFrame(rows, "doc_id long, text string"), shard_bytes=1 << 18).agg({"n_tokens": "sum"}).first()[0]
    told = [p for p in paths if p.name.startswith("lm-answers")]
    assert len(told) == word_tree.DEPTH and sum(x.stat().st_size for x in told[1].glob("*.parquet")) < tokens
