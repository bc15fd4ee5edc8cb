"""Ids and texts against the SentencePiece library."""

import hashlib
import random

import numpy as np
import pytest

from tidewatch.llm import piece_codec

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        return piece_codec.Pieces(f.read())


ODD = [
    "", " ", "  ", "   \n  ", "\n", "a", " a", "a ", "thethethe the", "Hello  world ▁x\né\x00 　 日本", "▁▁", "\t\ttabs\t", "\U0001f600\U0001f600 ok", "a" * 700,
    "ab" * 900 + " tail", " " * 1500 + "x" + " " * 33, "é́​", "<s></s><unk><0x0A>", "aaa aaaa aaaaa", "�", "x\n\n\ny", "inging" * 80, "1234567890" * 120, "\r\nline\r\n", "nan" * 200,
]


def texts_of(rng, pieces, n):
    """Texts of random characters, random pieces and repeats of them."""
    some = [p.replace("▁", " ") for p in pieces.ids]
    letters = [c for p in rng.sample(some, 300) for c in p] + list(" \n\té漢\U0001f600the")
    for _ in range(n):
        kind = rng.randrange(3)
        if kind == 0:
            yield "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        elif kind == 1:
            yield "".join(rng.choice(some) for _ in range(rng.randrange(20)))
        else:
            yield rng.choice(some) * rng.randrange(1, 40) + rng.choice(some)


def test_ids_and_texts_equal_the_library(library, pieces):
    rng = random.Random(11)
    texts = ODD + list(texts_of(rng, pieces, 3000))
    want = library.encode(texts, num_threads=1)
    ids, sizes = piece_codec.Encoder(pieces).encode(texts)
    got = np.split(ids, np.cumsum(sizes)[:-1])
    for text, a, b in zip(texts, want, got, strict=True):
        assert a == b.tolist(), text
    assert pieces.decode(ids, sizes) == library.decode(want)


def test_rounds_equal_the_queue(pieces):
    """Each part by rounds and, whatever its length, by the queue."""
    rng = random.Random(3)
    parts = [p for t in [*ODD, *texts_of(rng, pieces, 500)] for p in piece_codec.Encoder(pieces).parts_of(t) if p and len(p) <= piece_codec.LONG]
    letters = pieces.symbol[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    symbols, after = pieces.merged(letters.copy(), owner)
    for i in range(len(parts)):
        assert symbols[after == i].tolist() == pieces.queued(letters[owner == i].tolist()), parts[i]
    assert not pieces.together.all() and pieces.together.any()


def test_any_ids_decode_as_in_the_library(library, pieces):
    rng = random.Random(5)
    lists = [[rng.choice([0, 1, 2, 3 + rng.randrange(256), rng.randrange(259, pieces.size), 28705, 259]) for _ in range(rng.randrange(9))] for _ in range(2000)]
    flat = np.array([i for x in lists for i in x], np.int64)
    got = pieces.decode(flat, np.array([len(x) for x in lists]))
    for ids, text in zip(lists, got, strict=True):
        assert text == library.decode(ids), ids
    with pytest.raises(ValueError, match="not in the model"):
        pieces.decode(np.array([pieces.size]), np.array([1]))


def test_a_forgetful_encoder_gives_the_same(pieces):
    texts = ODD * 2
    want = piece_codec.Encoder(pieces).encode(texts)
    small = piece_codec.Encoder(pieces, 5)
    parts = [small.encode([t]) for t in texts]
    assert np.concatenate([i for i, _ in parts]).tolist() == want[0].tolist() and [int(n[0]) for _, n in parts] == want[1].tolist()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_the_library(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = piece_codec.op12_sentencepiece(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_odd_rows_and_round_trips(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, "y"), (None, "a b", "z"), (3, ODD[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = piece_codec.encoded(docs, PATH)
    assert sorted((repr(r.doc_id), r.ids) for r in ids.collect()) == sorted((repr(i), library.encode(t or "")) for i, t, _ in rows)
    texts = sorted((repr(r.doc_id), r.text) for r in piece_codec.decoded(ids, PATH).collect())
    assert texts == sorted((repr(i), (t or "").replace("▁", " ")) for i, t, _ in rows)
    assert piece_codec.encoded(docs.limit(0), PATH).count() == piece_codec.round_trips(docs.limit(0), PATH).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.text for r in piece_codec.decoded(nothing, PATH).collect()] == ["", ""]
    assert piece_codec.round_trips(docs, PATH).count() == len(rows)


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="byte-pair"):
        piece_codec.Pieces(b"")
