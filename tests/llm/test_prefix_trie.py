"""The trie against plain sets of prefixes, and the rounds against plain sums."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string, node string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """All nodes from whole prefixes."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((role or "", text or "", turn))
    for turns in own.values():
        turns.sort(key=lambda t: (t[2] is not None, t[2] or 0, sha(f"{len(t[0])}:{t[0]}{t[1]}")))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(t[:2] for t in own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = lambda k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k]
        words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        ends = sorted(c for c in convs if len(whole[c]) == len(key))
        out.append((
            min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(kids(key)), sum(not kids(k) for k in below),
            sum((len(members[k]) - 1) * words(k) for k in below), sha(",".join(map(str, ends))),
        ))
    return sorted(out, key=repr)


def got(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = trie.prefix_trie(frame, **more)
    assert found.columns == COLUMNS and all(t == "bigint" for c, t in found.dtypes if c != "ends_sha256")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def conversations(seed, n, turns=4, words=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot", None]), " ".join("ab"[: rng.randrange(1, 3)] for _ in range(rng.randrange(words)))) for c in rng.sample(range(3 * n), n) for t in range(rng.randrange(1, turns))]


@pytest.mark.parametrize("local", [1, 7, 2000])
def test_nodes_equal_plain_prefixes(spark, local):
    rows = conversations(1, 50)
    rows += [(None, 1, "user", "lost"), (45, None, "user", "first"), (45, None, "user", "first"), (45, 1, "bot", "tie b"), (45, 1, "bot", "tie a"), (999, 3, None, None), (1000, 0, "", "")]
    rows += [(-7, 0, "user", "below zero")]
    want = plain(rows)
    assert got(spark, rows, local=local) == want
    assert any(r[3] == 1 for r in want) and any(r[4] > 3 for r in want)


def test_copies_and_a_long_conversation(spark):
    """Many members of one sequence, and a path of many chunks with branches."""
    rows = [(c, t, "user", f"turn {t}") for c in range(2000, 2060) for t in range(3)]
    rows += [(5000 + 20 * k, t, "user", f"word {min(t, 6 * k + 5)}" if t <= 6 * k + 5 else f"own {k} {t}") for k in range(4) for t in range(40)]
    want = plain(rows)
    assert got(spark, rows, local=3, chunk=4, ids=5) == want
    assert got(spark, rows, local=1, chunk=7) == want


def test_turnless_conversations_and_none(spark):
    """Conversations whose run has no first one and whose turns are all given up."""
    rows = [(c, 0, "user", "only") for c in range(21, 40)]
    want = plain(rows)
    assert want[0][1] == 0 and want[0][7] != sha("") and got(spark, rows) == want
    assert got(spark, []) == []


def test_query_equals_plain_prefixes(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if r.conv_id < 60]
    want = plain(rows)
    assert got(spark, rows) == want
    found = sorted((tuple(r[c] for c in COLUMNS) for r in trie.op11_prefix_trie(spark, sf).collect()), key=repr)
    assert len(found) >= len(want)


def test_rounds_equal_plain_sums():
    rng = random.Random(8)
    for shape in range(40):
        n = rng.randrange(1, 120)
        parent = np.array([-1 if i == 0 or rng.random() < 0.05 else (i - 1 if shape % 3 == 0 else rng.randrange(max(0, i - 3) if shape % 3 == 1 else 0, i)) for i in range(n)])
        values = [np.array([rng.randrange(9) for _ in range(n)]) for _ in range(2)]
        weight = np.array([rng.randrange(1, 5) for _ in range(n)])
        want = [v.copy() for v in values]
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                weight[parent[i]] += weight[i]
                for v in want:
                    v[parent[i]] += v[i]
        mixed = np.array(rng.sample(range(n), n))
        place = np.empty(n, np.int64)
        place[mixed] = np.arange(n)
        up = np.where(parent[mixed] >= 0, place[parent[mixed]], -1)
        found = trie.decomposed(up, weight[mixed], [v[mixed] for v in values])
        assert all((f == w[mixed]).all() for f, w in zip(found, want, strict=True))


def test_running_sums_in_any_chunks(spark):
    rows = [(g, i, (g * 7 + i * 3) % 11) for g in range(3) for i in range(20 * g + 1)]
    frame = spark.createDataFrame(rows, "g long, i long, v long")
    for chunk in (1, 6, 1000):
        for backwards in (False, True):
            sums = {(r.g, r.i): r.v for r in trie.running(frame, "g", "i", ["v"], backwards, chunk).collect()}
            assert sums == {(g, i): sum(v for h, j, v in rows if h == g and (j >= i if backwards else j <= i)) for g, i, _ in rows}


def test_turns_are_numbered_over_partitions(spark):
    rows = [(5, i // 3, "user", f"t {i % 7}", "x", "y") for i in range(200)] + [(6, 0, "user", "x", "x", "y")]
    turns = trie.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    found = turns.where("conv_id = 5").orderBy("pos").select("pos", "turn_hash").collect()
    assert [r.pos for r in found] == list(range(200))
    want = [sha(f"4:user{t}") for _, t in sorted((r[1], r[3]) for r in rows[:200])]
    assert sorted(r.turn_hash for r in found) == sorted(want)
    assert turns.agg(F.count_distinct("conv_id", "pos")).first()[0] == 201
