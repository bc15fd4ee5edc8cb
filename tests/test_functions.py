"""Expressions against the cases of the public fixtures."""

import hashlib
import itertools
import json
import struct

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions import ids, scope, text, urls, vectors

QUERY = "Notify me when Acme Corporation launches renewable energy tools in Colombia."


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_content_hash_ignores_white_space(spark):
    a, b = one(spark, text.content_sha256(F.lit("alpha\n beta\t gamma")), text.content_sha256(F.lit(" alpha beta gamma ")))
    assert a == b == hashlib.sha256(b"alpha beta gamma").hexdigest()


def test_query_views(spark):
    r = one(spark, text.keywords(F.lit(QUERY)), text.entities(F.lit(QUERY)), text.query_inputs(F.lit(QUERY)))
    assert r[0] == ["acme", "corporation", "launches", "renewable", "energy", "colombia"]
    assert r[1] == ["Acme Corporation", "Colombia"]
    assert r[2][0]["text"] == QUERY and [x["kind"] for x in r[2]] == ["query"] + ["keyword"] * 6 + ["entity"] * 2


def test_repeated_keyword_and_instruction(spark):
    r = one(spark, text.keywords(F.lit("Track Rust rust Rust releases from Acme Labs")), text.entities(F.lit("Track Rust rust Rust Ünder Acme, Colombia")))
    assert r[0] == ["track", "rust", "releases", "acme", "labs"]
    assert r[1] == ["Rust", "Rust Ünder Acme Colombia"]


def test_text_bounds(spark):
    r = one(spark, *[text.query_inputs(F.lit(t)) for t in ("   ", "ab", "abc", "x" * 700, "x" * 701)])
    assert [x is None for x in r] == [True, True, False, False, True]


URL_CASES = [
    ("https://blog.rust-lang.org:443/inside/item#fragment", "https://blog.rust-lang.org/inside/item", None),
    ("https://blog.rust-lang.org/inside-item", None, "path_not_allowed"),
    ("https://user:pw@blog.rust-lang.org/inside", None, "credentials"),
    ("http://127.0.0.1/inside", None, "ip_literal"),
    ("http://127.1/inside", None, "ip_literal"),
    ("https://[::1]/inside", None, "ip_literal"),
    ("https://example.com/inside", None, "host_not_allowed"),
    ("https://updates.blog.rust-lang.org/inside", None, "host_not_allowed"),
    ("https://notblog.rust-lang.org/inside", None, "host_not_allowed"),
    ("HTTPS://Blog.Rust-Lang.ORG./inside/../inside/a b?q=é#x", "https://blog.rust-lang.org./inside/a%20b?q=%C3%A9", None),
    ("http://localhost/inside", None, "not_public_host"),
    ("ftp://blog.rust-lang.org/inside", None, "scheme_not_allowed"),
    ("relative/path", None, "invalid_url"), ("", None, "invalid_url"), (None, None, "invalid_url"),
    ("https://blog.rust-lang.org:8443/inside", "https://blog.rust-lang.org:8443/inside", None),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(URL_CASES)], "i int, u string")
    policy = (F.array(F.lit("blog.rust-lang.org")), F.lit(False), F.array(F.lit("/inside")))
    got = {r.i: (r.x.canonical, r.x.reject_reason) for r in urls.with_canonical_url(df, "x", F.col("u"), *policy).collect()}
    assert [got[i] for i in range(len(URL_CASES))] == [(c, e) for _, c, e in URL_CASES]


def test_subdomains_are_opt_in(spark):
    df = spark.createDataFrame([("https://updates.example.com/",), ("https://notexample.com/",)], "u string")
    policy = (F.array(F.lit("Example.com.")), F.lit(True), F.array(F.lit("/")))
    got = [r.x.reject_reason for r in urls.with_canonical_url(df, "x", F.col("u"), *policy).orderBy("u").collect()]
    assert got == ["host_not_allowed", None]


def test_vector_text_and_hash(spark):
    v = F.array(*[F.lit(x).cast("float") for x in (0.25, -0.5, 1.0)])
    z = F.array(F.lit(0.0).cast("float"), F.lit(1.0).cast("float")), F.array(F.lit(-0.0).cast("float"), F.lit(1.0).cast("float"))
    r = one(spark, vectors.to_text(v), vectors.from_text(vectors.to_text(v)), vectors.embedding_sha256(v), *[vectors.embedding_sha256(x) for x in z])
    assert r[0] == "[0.25,-0.5,1]" and r[1] == [0.25, -0.5, 1.0] and r[3] == r[4]
    assert r[2] == hashlib.sha256(struct.pack(">3f", 0.25, -0.5, 1.0)).hexdigest()


def test_hash_equals_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").limit(50).select("embedding", vectors.embedding_sha256(F.col("embedding")).alias("h")).collect()
    assert all(r.h == hashlib.sha256(np.array(r.embedding, ">f4").tobytes()).hexdigest() for r in rows)


def test_centroid(spark):
    rows = [("a", 0, [1.0, 0.0], 1.0), ("a", 1, [0.0, 1.0], 0.5), ("b", 0, [0.0, 0.0], 1.0), ("c", 0, [1.0, 0.0], 0.0), ("d", 0, [1.0], 1.0), ("d", 1, [-1.0], 1.0)]
    df = spark.createDataFrame(rows, "k string, o int, v array<float>, w double")
    got = {r.k: (r.status, r.centroid) for r in vectors.weighted_centroid(df, "k", "o", "v", "w").collect()}
    assert got["a"][0] == "ok" and abs(np.linalg.norm(got["a"][1]) - 1) < 1e-6 and got["a"][1][0] > got["a"][1][1]
    assert [got[k] for k in "bcd"] == [("zero_vector", None), ("zero_weight", None), ("zero_centroid", None)]


def test_all_scope_states(spark):
    sources = [f"00000000-0000-0000-0000-00000000000{i}" for i in range(3)]
    subsets = [list(c) for n in range(4) for c in itertools.combinations(sources, n)]
    df = spark.createDataFrame([(r, q) for r in subsets for q in subsets], "rule array<string>, req array<string>")
    got = df.select("rule", "req", scope.constrain(F.col("rule"), F.col("req")).alias("x")).collect()
    assert len(got) == 64
    for r in got:
        want = sorted(r.req) if not r.rule else sorted(r.rule) if not r.req else sorted(r.req) if set(r.req) <= set(r.rule) else None
        assert r.x == want


def test_filters(spark):
    u = "0000000A-0000-0000-0000-000000000001"
    cases = [[u, f"source:{u.lower()}", f" {u} "], ["nope"], [u] * 101, []]
    r = one(spark, *[scope.normalize_filters(F.array(*[F.lit(x) for x in c]).cast("array<string>")) for c in cases])
    assert r[0] == [f"source:{u.lower()}"] and r[1] is None and r[2] is None and r[3] == []


def test_match_key(spark):
    fields = ["t", "r", "rr", "p", "c", "m", "v", "3", "l2"]
    key = lambda xs: ids.match_key(*[F.lit(x) for x in xs])
    moved = [*fields[:5], "m\nv", "", *fields[7:]], [*fields[:5], "m", "\nv", *fields[7:]]
    r = one(spark, key(fields), key(moved[0]), key(moved[1]), *[key([*fields[:i], "other", *fields[i + 1 :]]) for i in range(9)])
    assert r[0] == hashlib.sha256(json.dumps(fields, separators=(",", ":")).encode()).hexdigest()
    assert len(set(r)) == 12
