"""The near-dedup stage against a comparison of all pairs."""

import random

import pytest

from tidewatch.llm import near_copies


def brute_force(rows):
    """Ids kept of (id, text): the least of each component of pairs with five-word Jaccard 0.8 or more."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            small, large = sorted((len(a), len(b)))
            if 5 * small >= 4 * large and 5 * len(a & b) >= 4 * len(a | b):
                links += a != b
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted(least.values()), links


def test_stage_against_all_pairs(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, links = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert links > 0
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want


@pytest.mark.parametrize(("rows_a_block", "shingles_a_block"), [(400, 1 << 20), (7, 1 << 20), (400, 500)])
def test_changed_words(spark, monkeypatch, rows_a_block, shingles_a_block):
    """Bands in one block, in blocks of few rows and in blocks of few shingles give the same rows."""
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", shingles_a_block)
    rng = random.Random(4)
    rows = []
    for k in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(len(base) // 15)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    want, links = brute_force(rows)
    assert links > 100 and 6 < len(want) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == want


def test_rows_that_share_an_id(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "ONE"), (None, "one"), (5, "x y"), (5, "other words"), (None, "p q"), (None, "r s"), (None, "r  s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, (r.text or "").lower().split()) for r in near_copies.keep_one(docs).collect())
    assert got == [(-1, ["p", "q"]), (-1, ["r", "s"]), (1, []), (4, ["one"]), (5, ["other", "words"]), (5, ["x", "y"])]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_a_task_holds_hashes_up_to_a_bound(monkeypatch):
    """With hardly a hash kept, links come out as with all of them."""
    import pyarrow as pa

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:50], str(i % 3)]).encode() for i in range(6)] + [b"other words altogether here now"]
    rows = [(c, 0, n, n, texts[n]) for c in range(3) for n in range(7)]
    batch = pa.record_batch([pa.array([r[k] for r in rows]) for k in range(5)], names=["cell", "pair", "node", "root", "text"])
    show = lambda: [b.to_pydict() for b in near_copies._forest_batches(iter([batch]))]
    want = show()
    monkeypatch.setattr(near_copies, "HELD_HASHES", 1)
    assert show() == want and sum(len(x["a"]) for x in want) == 3 * 5


def test_very_long_texts(spark):
    """Texts longer than a chunk and a block: near copies are found, others stay."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(50_000)}" for _ in range(30_000)]
    near, far = list(base), list(base)
    for i in range(0, len(near), 60):
        near[i] = "v"
    for i in range(0, len(far), 8):
        far[i] = "v"
    rows = [(3, " ".join(base)), (2, " ".join(near)), (1, " ".join(far)), (4, "w1 " * 40_000)]
    assert brute_force(rows)[0] == [1, 2, 4]
    assert sorted(r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 2, 4]


def test_repeated_rows_with_other_columns(spark):
    """Which of several rows of one id and text stays does not depend on where they lie."""
    rows = [(1, "a b c d e f", c, {c: 1}, [n, None]) for n, c in enumerate("qprs")] + [(2, None, "x", None, None), (2, "", "w", None, None)]
    kept = set()
    for n in (1, 2, 3, 5):
        docs = spark.createDataFrame(rows[n % 4 :] + rows[: n % 4], "doc_id long, text string, source string, tags map<string,int>, more array<int>").repartition(n)
        out = near_copies.keep_one(docs)
        assert out.dtypes == docs.dtypes
        kept.add(tuple(sorted((r.doc_id, r.text, r.source) for r in out.collect())))
    assert kept == {((1, "a b c d e f", "p"), (2, "", "w"))}
