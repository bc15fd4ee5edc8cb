"""Media, shards, mixing, language model, classifier and the pipeline."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import jpeg, mixing, quality, shards, suffix_tree_lm
from tidewatch.llm.common import scratch_path

DOC = "doc_id long, text string, source string"
ODD = [(1, None, None), (2, "", "s"), (3, "plain words here", "s"), (3, "plain words here", "s"), (None, "été \x00 long " * 50, "t"), (4, " \n ", "é")]


def odd_docs(spark):
    return spark.createDataFrame(ODD, DOC).withColumn("key", F.lit("clash"))


# media


def scalar_jpeg(blocks, width, height, sampling, interval, quant):
    """A baseline JPEG written symbol by symbol, with runs, end-of-block and any sampling."""
    dc = ([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12)))
    ac_symbols = [0x01, 0x02, 0x03, 0x00, 0x11, 0x12, 0xF0, 0x04, 0x21, 0x31, 0x05, 0x06, 0x41, 0x51, 0x22, 0x0A]
    ac = ([0, 2, 1, 2, 3, 3, 2, 2, 1] + [0] * 7, ac_symbols)
    code = [{s: (c, n) for s, c, n in jpeg.huffman_codes(*t)} for t in (dc, ac)]
    out, bits, before, marker = bytearray(), "", [0] * len(sampling), 0

    def size_bits(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        out.extend(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00"))
        bits = ""

    for n, mcu in enumerate(blocks):
        if interval and n and n % interval == 0:
            flush()
            out.extend(b"\xff" + bytes([0xD0 + marker % 8]))
            marker, before = marker + 1, [0] * len(sampling)
        for component, block in mcu:
            size, extra = size_bits(block[0] - before[component])
            before[component] = block[0]
            c, length = code[0][size]
            bits += format(c, f"0{length}b") + extra
            run = 0
            last = max((k for k in range(1, 64) if block[k]), default=0)
            for k in range(1, last + 1):
                if block[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    c, length = code[1][0xF0]
                    bits += format(c, f"0{length}b")
                    run -= 16
                size, extra = size_bits(block[k])
                c, length = code[1][run << 4 | size]
                bits += format(c, f"0{length}b") + extra
                run = 0
            if last < 63:
                c, length = code[1][0x00]
                bits += format(c, f"0{length}b")
    flush()
    frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    parts = [b"\xff\xd8", jpeg._segment(0xDB, b"\x00" + bytes([quant] * 64)), jpeg._segment(0xC0, frame)]
    parts += [jpeg._segment(0xC4, bytes([k << 4]) + bytes(t[0]) + bytes(t[1])) for k, t in enumerate((dc, ac))]
    parts += [jpeg._segment(0xDD, struct.pack(">H", interval))] if interval else []
    scan = bytes([len(sampling)]) + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + b"\x00\x3f\x00"
    return b"".join(parts) + jpeg._segment(0xDA, scan) + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("sampling,interval", [([(2, 2), (1, 1), (1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 2), ([(1, 1)], 3), ([(2, 1), (1, 1), (1, 1)], 1)])
def test_any_baseline_jpeg_is_decoded(sampling, interval):
    rng = random.Random(1)
    h, v = sampling[0] if len(sampling) > 1 else (1, 1)
    width, height = 8 * h * 3 - 5, 8 * v * 2 - 3
    allowed = {0: [-3, -2, -1, 1, 2, 3, 7, -7, 12, -20, 1000], 1: [1, -1, 2, -2], 2: [1, -1, 3], 3: [1, -1], 4: [1], 5: [1]}

    def block():
        b, k = [rng.randrange(-200, 200)] + [0] * 63, 1
        while k < 64 and rng.random() < 0.8:
            run = rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 16, 17])
            if k + run > 63:
                break
            k += run
            b[k] = rng.choice(allowed[run % 16])
            k += 1
        return b

    mcus = [[(c, block()) for c, (x, y) in enumerate(sampling) for _ in range(x * y if len(sampling) > 1 else 1)] for _ in range(6)]
    body = scalar_jpeg(mcus, width, height, sampling, interval, 4)
    head, got = next(jpeg.read_back([body]))
    assert (head.width, head.height) == (width, height)
    assert got.tolist() == [[b for _, b in m] for m in mcus]
    picture = jpeg.thumbnail(head, got)
    assert picture.shape == (-(-height // 8), -(-width // 8))
    assert picture[0, 0] == np.clip((mcus[0][0][1][0] * 4 >> 3) + 128, 0, 255)
    assert len(jpeg.difference_hash(picture)) == 16


def test_payloads_round_trip():
    rng = random.Random(3)
    texts = [b"", b"x", bytes(range(256)), b"\xff" * 500, "ça va".encode() * 100, bytes(rng.randrange(256) for _ in range(5000))]
    payloads = [jpeg.payload_of(t) for t in texts]
    assert [len(p) % 192 for p in payloads] == [0] * 6 and payloads[0] == b" " * 192
    for p, (head, c) in zip(payloads, jpeg.read_back(jpeg.encode_all(payloads)), strict=True):
        assert jpeg.BYTE_OF_VALUE[c.reshape(-1)[: len(p)] + 128].tobytes() == p == jpeg.BYTE_OF_VALUE[c.reshape(-1)[: int(head.comment.split()[1])] + 128].tobytes()


def test_media_of_odd_rows(spark):
    got = jpeg.media_features(jpeg.store(odd_docs(spark))).collect()
    assert len(got) == len(ODD)
    want = sorted((len((t or "").encode()), hashlib.sha256(jpeg.payload_of((t or "").encode())).hexdigest(), zlib.crc32(jpeg.payload_of((t or "").encode())[-16:])) for _, t, _ in ODD)
    assert sorted((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 2)}) == 1
    assert jpeg.media_features(jpeg.store(odd_docs(spark).limit(0))).count() == 0


# shards


def test_compaction_keeps_every_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = shards.ShardTable(spark, scratch_path(spark, "shards"))
    target = 60_000
    for part in range(3):
        table.append(docs.where(F.col("doc_id") % 3 == part), arrival_rows=5)
    appended = table.version()
    while True:
        before = table.version()
        if table.compact(docs.schema, target) == before:
            break
    final = table.manifest().collect()
    rows = table.read(docs.schema)
    count = Counter(r["__shard"] for r in rows.select("__shard").collect())
    assert {r.shard: r.n_docs for r in final} == dict(count)
    assert sorted(map(tuple, rows.drop("__shard").collect())) == sorted(map(tuple, docs.collect()))
    largest = max(r.n_bytes for r in table.manifest(appended).collect())
    assert all(r.n_bytes < target + largest for r in final) and len(final) < table.manifest(appended).count() / 2
    assert table.read(docs.schema, appended).count() == docs.count()
    with pytest.raises(shards.CommitConflict):
        table.commit(table.manifest(), table.version() - 1)
    assert table.version() == before


def test_shards_of_odd_rows(spark):
    got = shards.placed(odd_docs(spark), scratch_path(spark, "shards"))
    assert sorted((r.n_bytes) for r in got.collect()) == sorted(len((t or "").encode()) for _, t, _ in ODD)
    assert shards.placed(odd_docs(spark).limit(0), scratch_path(spark, "shards")).count() == 0


# mixing


def plain_targets(sizes):
    """Share by weight, cut at the caps, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(rows, sizes):
    want = plain_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(want[r.source], 1)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    return want, taken


def test_mix_of_documents(spark, sf):
    rows = mixing.op7_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len(d.text.encode().split())
    assert len(rows) == len(docs)
    want, taken = check_mix(rows, sizes)
    smallest = {}
    for r in rows:
        if r["size"]:
            smallest[r.source] = min(smallest.get(r.source, 1 << 60), r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= max(smallest[s], 0.02 * want[s])
    again = {(r.doc_id, r.taken) for r in mixing.op7_mixing(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mix_of_one_size(spark):
    rows = [(i, "a b c", "big" if i < 900 else None if i < 930 else f"s{i % 3}") for i in range(1000)]
    got = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += 3
    want, taken = check_mix(got, sizes)
    assert all(abs(taken[s] - want[s]) <= 3 for s in want)


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert len(got) == len(ODD) and {r.source for r in got} == {None, "s", "t", "é"}
    assert all(r.copies == 0 for r in got if r["size"] == 0)
    assert mixing.mix(odd_docs(spark).limit(0)).count() == 0
    rows = mixing.mixed_rows(odd_docs(spark))
    assert rows.columns == ["doc_id", "text", "source", "key"]
    assert rows.count() == sum(r.copies for r in got)


# language model


def test_base_scores_and_counts(spark, sf):
    docs = {r.doc_id: r.text.encode().lower().split() + [b"\n"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    count = Counter()
    for i, w in docs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(w)
    n, v = sum(count.values()), len(count)
    rows = suffix_tree_lm.op8_language_model(spark, sf).collect()
    assert len(rows) == len(docs)
    gain = 0.0
    for r in rows:
        w = docs[r.doc_id]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and abs(r.base_score - base) < 1e-6 * abs(base)
        gain += (r.score - r.base_score) if r.held_out else 0
    assert gain > 0


def test_model_of_odd_rows(spark):
    got = suffix_tree_lm.score(odd_docs(spark)).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").encode().split()) + 1 for _, t, _ in ODD)
    assert all(math.isfinite(r.score) for r in got)
    assert suffix_tree_lm.score(odd_docs(spark).limit(0)).count() == 0


# classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op9_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 50 and sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_features_stay_with_their_text():
    texts = [b"", b"one two", b" ", "été one".encode(), b"x" * 40, b"a b a b a b"]
    bucket, owner = quality.features(texts)
    for i, t in enumerate(texts):
        alone, _ = quality.features([t])
        assert sorted(bucket[owner == i].tolist()) == sorted(alone.tolist())


def test_classifier_of_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, 0), (None, 1, 0), (9, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    weights = quality.fit(odd_docs(spark), labels)
    got = quality.score(odd_docs(spark), weights).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = quality.fit(odd_docs(spark), labels.limit(0))
    assert {r.score for r in quality.score(odd_docs(spark), none).collect()} == {0.5}
    assert quality.score(odd_docs(spark).limit(0), weights).count() == 0


# pipeline


def test_stages(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf).cache()
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "shard":
            assert docs.columns == columns
        if name not in ("shard", "mix"):
            assert len(kept[name]) == len(set(kept[name])) and docs.exceptAll(before).count() == 0
    assert sorted(kept["shard"]) == sorted(kept["mix"]) and set(kept["mix"]) <= set(kept["decontaminate"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in kept["quality"]) <= 0.3 * sum(q == 0 for q in labels.values())


def test_stages_take_odd_rows(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], DOC + ", n_chars long").selectExpr("doc_id", "text", "'en' as lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() <= 2 * len(ODD)
        assert stage(spark, docs.limit(0), sf).count() == 0
