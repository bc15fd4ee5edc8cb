"""Scores, stages and repeats against plain versions that share no code with them beyond the hash's constants."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import inverted_index, quality, repeats, suffix_sort

MASK = (1 << 64) - 1


def plain_score(text, weights):
    """The logistic of the mean weight of a text's words, grams and repeated words, one feature at a time."""
    t = b" " + text + b" "
    blank = set(b" \t\n\x0b\x0c\r")
    mix, shift = int(quality._MIX), int(quality._SHIFT)
    codes = [(t[i] | t[i + 1] << 8 | t[i + 2] << 16 | 3 << 56) * mix for i in range(len(t) - 2) if t[i + 1] not in blank]
    codes += [
        (t[i] | t[i + 1] << 8 | t[i + 2] << 16 | t[i + 3] << 24 | 4 << 56) * mix
        for i in range(len(t) - 3) if t[i + 1] not in blank and t[i + 2] not in blank
    ]
    words = []
    for word in re.findall(rb"[^ \t\n\x0b\x0c\r]+", text):
        h = sum(int(inverted_index.BYTE_VALUE[b]) * pow(int(inverted_index.BASE), i, 1 << 64) for i, b in enumerate(word)) & MASK
        words.append(word)
        codes.append((h ^ h >> 31) * mix)
    for lag in range(1, quality.LAGS + 1):
        codes += [(lag << 40) * mix for i in range(lag, len(words)) if words[i] == words[i - lag]]
    total = sum(weights[(c & MASK) >> shift] for c in codes)
    return 1 / (1 + math.exp(-(total / max(len(codes), 1) + weights[-1])))


def test_scores_against_one_feature_at_a_time(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").limit(60)
    rng = np.random.default_rng(2)
    weights = rng.normal(size=quality.BUCKETS + 1)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in quality.score(docs, weights).collect():
        assert math.isclose(r.score, plain_score(texts[r.doc_id], weights), rel_tol=1e-9, abs_tol=1e-12)


def has_window(text, items):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sizes = {len(x) for x in items}
    return any(tuple(words[i : i + n]) in items for n in sizes for i in range(len(words) - n + 1))


def test_pipeline_against_plain_stages(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    weights = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = [i for i, r in rows.items() if plain_score((r.text or "").encode(), weights) >= quality.GOOD]
    assert 0 < len(left) < len(rows)

    sets = {}
    for i in left:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), rows[i].text or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            if j < i and root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    left = [i for i in left if root[i] == i]

    items = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        items |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))} if w else set()
    left = [i for i in left if not has_window(rows[i].text, items)]

    placed = Counter(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())
    size = {i: len(re.findall(r"[^ \t\n\x0b\x0c\r]+", rows[i].text or "")) for i in left}
    assert set(placed) <= set(left) and max(placed.values()) <= 2
    per = Counter()
    for i in left:
        per[rows[i].source] += size[i]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, total, capped = {}, 1.5 * sum(per.values()), set()
    while True:
        open_sources = [s for s in order if s not in capped]
        share = total - sum(2 * per[s] for s in capped)
        target = {s: share * weight[s] / sum(weight[o] for o in open_sources) for s in open_sources}
        over = {s for s in open_sources if target[s] > 2 * per[s]}
        if not over:
            break
        capped |= over
    target |= {s: 2 * per[s] for s in capped}
    for s in order:
        taken = sum(n * size[i] for i, n in placed.items() if rows[i].source == s)
        assert abs(taken - target[s]) <= max((size[i] for i in left if rows[i].source == s), default=0)


def test_starts_under_colliding_hashes(monkeypatch):
    """Hashes of three bits only: bytes decide which strings are equal."""
    of = suffix_sort.PrefixHash.of
    monkeypatch.setattr(suffix_sort.PrefixHash, "of", lambda self, begin, length: of(self, begin, length) & np.uint64(7))
    rng = random.Random(5)
    length = 6
    for _ in range(40):
        n = rng.randrange(2, 7)
        back = np.array([-rng.randrange(6) for _ in range(n)])
        front = np.array([rng.randrange(b, 1) for b in back])
        bodies = [bytes(rng.choice(b"ab") for _ in range(f - b + length)) for b, f in zip(back, front, strict=True)]
        anchor, copies = np.zeros(n, np.int64), np.ones(n, np.int64)
        marks = repeats.repeated_starts(anchor, back, front, copies, bodies, length)
        count = Counter((int(b) + i, body[i : i + length]) for b, f, body in zip(back, front, bodies, strict=True) for i in range(int(f - b) + 1))
        for b, body, mark in zip(back, bodies, marks, strict=True):
            want = [count[(int(b) + i, body[i : i + length])] > 1 for i in range(len(mark))]
            assert mark.tolist() == want
