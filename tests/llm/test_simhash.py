"""SimHash groups against all-pairs comparison."""

import random

import numpy as np
from xxhash import xxh64_intdigest

from tidewatch.llm import components, simhash


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """{id: least id reachable} by comparing all pairs."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_documents_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = simhash.op1_simhash(spark, sf).collect()
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = groups(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_fingerprint_is_spark_hash(spark):
    row = spark.sql("select xxhash64('a b c') as h").first()
    assert row.h & (2**64 - 1) == xxh64_intdigest(b"a b c", 42) == simhash.fingerprint(b"A b\tC")


def random_prints(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        base.append(x)
    return sorted(set(base))


def component_map(spark, prints, **kw):
    df = spark.createDataFrame([(simhash._signed(x),) for x in prints], "fp long")
    links = simhash.fingerprint_links(df, **kw)
    return {r.node: r.root for r in components.connected_components(links, "a", "b").collect()}


def check_components(prints, found):
    want = groups({simhash._signed(x): x for x in prints})
    sizes = {}
    for root in want.values():
        sizes[root] = sizes.get(root, 0) + 1
    grouped = {n for n, r in want.items() if sizes[r] > 1}
    assert set(found) == grouped
    name = {}
    for n, r in found.items():
        assert name.setdefault(want[n], r) == r
    assert len(set(name.values())) == len(name)


def test_planted_links_are_all_found(spark):
    prints = random_prints(150, 1)
    check_components(prints, component_map(spark, prints))


def test_large_cells_are_split_without_loss(spark):
    # All within a few bits of each other: every cell is crowded.
    prints = sorted({0xF0F0 ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a, a + 3) if b < 64})
    check_components(prints, component_map(spark, prints, cell_rows=16))


def test_lower_bound():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    low, one = np.uint64(simhash.LOW_BITS), np.uint64(1)
    unary = ((fp | fp >> one) & low) | ((fp & fp >> one & low) << one)
    counts = np.array([[bin(int(x) >> 2 * s & 3).count("1") for s in range(32)] for x in fp])
    manhattan = np.abs(counts[1:] - counts[:-1]).sum(axis=1)
    assert (np.bitwise_count(unary[1:] ^ unary[:-1]) == manhattan).all()
    assert (manhattan <= np.bitwise_count(fp[1:] ^ fp[:-1])).all()


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \n", 7), (4, "one", 7), (4, "one", 7), (None, "one", 7), (5, "x y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnRenamed("fp", "component_id")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in components.connected_components(links, "a", "b").collect()} == {0}
