"""Extraction, line dedup, repeats and decontamination against plain versions."""

import hashlib
import html
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import html_text, inverted_index, lines, repeats, suffix_sort

DOC = "doc_id long, text string, source string"


def test_markup_that_is_not_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
    <nav><ul><li>Menu</li></ul></nav><header>Site</header><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
    <article><h1>Title &amp; more</h1><p>First <b>bold</b>
      line.<br>same block<p>Second &lt;x&gt;<aside>Side</aside><form><p>Name</p><input></form><div class="ad">Buy</div></article>
    <section id="comments"><p>Nice!</p></section><footer>&copy; me</footer></body></html>"""
    assert [t for own, t in html_text.lines_of(page) if own] == ["Title & more", "First bold line. same block", "Second <x>"]


def test_broken_markup():
    for page in (None, "", "<", "<p", "<article><p>a<b>b", "</p></div>a", "<article><script>x", "a < b", "<p title='>'>q</p>"):
        html_text.lines_of(page)
    assert html_text.lines_of("<article><p>a<b>b") == [(True, "ab")]
    assert html_text.lines_of("a < b &am") == [(False, "a < b &am")]


def test_marks_that_say_and_marks_that_hint():
    story = "A long story that goes on and on for quite a while, as stories do."
    own = lambda page: [t for inside, t in html_text.lines_of(page) if inside]
    assert own(f'<article><p>{story}</p></article><article class="comment"><p>{story}</p></article>') == [story]
    assert own(f'<article><p class="ad">Buy</p><p>{story}</p><p class="cookie-notice">We use cookies</p></article>') == [story]
    assert own(f'<article><div class="body share-enabled"><p>{story}</p></div></article>') == [story]
    assert own(f'<article><div class="content related-topics-on"><p>{story}</p></div></article>') == [story]
    assert own(f'<article><header>Section</header><p>{story}</p></article>') == [story]
    assert own(f'<article><p>{story}</p><div class="post-share-bar">Like it</div></article>') == [story]
    assert own(f'<article class="promo-story"><p>{story}</p></article>') == [story]
    assert own(f'<div class="related-reads"><a href="/x">{story}</a></div><article><p>Short.</p></article>') == ["Short."]


def test_lines_of_long_pages_take_linear_memory(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(html_text, "TABLE_CELLS", 30)
    for _ in range(30):
        a, b = (np.array([rng.randrange(9) for _ in range(rng.randrange(60))], np.int64) for _ in range(2))
        left, right = html_text.common_lines(a, b)
        monkeypatch.setattr(html_text, "TABLE_CELLS", 1 << 20)
        assert len(left) == len(html_text.common_lines(a, b)[0]) and (a[left] == b[right]).all()
        assert left == sorted(set(left)) and right == sorted(set(right))
        monkeypatch.setattr(html_text, "TABLE_CELLS", 30)


def test_shared_lines_of_neighbours_go(spark):
    own = [f"Page number {i} says something of its own here." for i in range(5)]
    body = "<body><div>Top line</div><div>{}</div><p>Extra {}</p><div>All rights reserved</div></body>"
    rows = [(i, f"http://h.example/a/{i}", body.format(t, i * i + 10)) for i, t in enumerate(own)]
    rows += [(7, "http://h.example/a/1", rows[1][2]), (8, None, None), (9, "", ""), (10, "http://lonely.example/x", "<p>Alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(pages).collect()}
    want = {i: f"{t}\nExtra {i * i + 10}" for i, t in enumerate(own)} | {8: "", 9: "", 10: "Alone"}
    want[7] = want[1]
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_common_lines():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(9))] for _ in range(2))
        left, right = html_text.common_lines(np.array(a, np.int64), np.array(b, np.int64))
        assert [a[i] for i in left] == [b[i] for i in right] and left == sorted(left) and right == sorted(right)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(left) == best[-1][-1]


def test_pages_against_the_documents_they_show(spark, sf):
    """The title, then a document's text with white space as one blank within its paragraphs: nothing more, nothing less."""
    texts = {r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    titles = {r.page_id: re.search("<h1>(.*?)</h1>", r.html, re.S)[1] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text.op2_html_text(spark, sf).collect():
        title, _, rest = r.text.partition("\n")
        assert rest in texts and title == " ".join(html.unescape(titles[r.page_id]).split())


def line_oracle(rows, sites):
    of = {}
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                of.setdefault(line, set()).add(source)
    gone = {x for x, s in of.items() if len(s) >= sites}
    return sorted((-1 if i is None else i, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if x not in gone)) for i, t, _ in rows)


def test_lines(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(f"line {rng.randrange(12)}" for _ in range(rng.randrange(5))), f"s{rng.randrange(6)}") for i in range(40)]
    rows += [(40, None, None), (41, "", "s1"), (41, "\n \nline 1\n", None), (None, "line 2", "s9")]
    docs = spark.createDataFrame(rows, DOC).withColumn("line", F.lit(1))
    for sites in (2, 4):
        got = lines.remove_shared_lines(docs, sites=sites).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.kept) for r in got) == line_oracle(rows, sites)
    assert lines.remove_shared_lines(docs.limit(0)).count() == 0


def repeat_oracle(texts, n):
    count = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            count[t[i : i + n]] = count.get(t[i : i + n], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def test_repeats_against_all_windows(spark):
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("ab") for _ in range(k))
    shared = [word(60), "é" * 30, word(25)]
    texts = [word(rng.randrange(80)) + rng.choice(shared) + word(rng.randrange(40)) + rng.choice(["", rng.choice(shared)]) for _ in range(40)]
    texts += ["", None, "a" * 100, texts[0], texts[0][:50], shared[0] + shared[0]]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOC).withColumn("rid", F.lit(1))
    want = repeat_oracle([(t or "").encode() for t in texts], 24)
    for group_rows in (2048, 2):
        got = repeats.remove_repeats(docs, length=24, gram=8, group_rows=group_rows).orderBy("doc_id").collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == want
    assert repeats.remove_repeats(docs.limit(0), length=24, gram=8).count() == 0


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 50)
    text = bytes(random.Random(4).randrange(256) for _ in range(400))
    parts = list(repeats._parts(text, 24))
    starts = [o + i for o, p in parts for i in range(len(p) - 24 + 1)]
    assert starts == list(range(400 - 24 + 1))


def test_suffix_sort():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    begin = rng.integers(0, 380, 90)
    length = np.minimum(rng.integers(0, 40, 90), 400 - begin)
    group = np.sort(rng.integers(0, 7, 90))
    order = suffix_sort.sort_suffixes(suffix_sort.PrefixHash(data), begin, length, group)
    want = sorted(range(90), key=lambda i: (group[i], data[begin[i] : begin[i] + length[i]].tobytes(), i))
    assert order.tolist() == want


def index_oracle(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, it in items:
            x = words(it)
            for k in range(max(len(x) - size + 1, 1)) if x else ():
                run = x[k : k + size]
                for p in range(len(w) - len(run) + 1):
                    if w[p : p + len(run)] == run:
                        hit |= set(range(p, p + len(run)))
                        found.add(str(item))
        out[i] = (len(w), sorted(hit), sorted(found))
    return out


def found_rows(df):
    return {r.doc_id: (r.n_words, sorted(r.hits), r["items"]) for r in df.collect()}


def test_index_against_scan(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: rng.choice(["Ab", "cd", "é", "x1", "yy"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(30)] + [(30, None), (31, ""), (32, "--- ,,")]
    items = [(f"i{k}", "-".join(word() for _ in range(rng.randrange(1, 7)))) for k in range(12)] + [("none", None), ("blank", " "), (None, "ab")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    want = index_oracle(docs, [x for x in items if x[0] is not None], 4)
    index = inverted_index.build_index(d)
    assert found_rows(inverted_index.search(index, b, size=4)) == want
    monkeypatch.setattr(inverted_index, "BLOCK_BYTES", 200)
    assert found_rows(inverted_index.search(index, b, size=4)) == want
    kept = inverted_index.decontaminate(d, b, size=4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if not x[1])
    assert inverted_index.search(inverted_index.build_index(d.limit(0)), b).count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "one big two three"), (2, "one two three"), (3, "one a b c two three")], "doc_id long, text string")
    b = spark.createDataFrame([("p", "one two three")], "item_id string, text string")
    index = inverted_index.build_index(d)
    hit = lambda slop: sorted(r.doc_id for r in inverted_index.search(index, b, slop=slop).collect() if r.hits)
    assert hit(0) == [2] and hit(1) == [1, 2]


def test_cut_digest(spark, sf):
    got = repeats.op5_repeats(spark, sf).where("n_removed = 0").limit(3).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.kept_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)


def test_repeats_where_joins_become_broadcasts(spark):
    """Joins planned as sorts and made broadcasts at run time, as on large tables, must leave an anchor's group in one task."""
    rng = random.Random(12)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    shared = [word(30) for _ in range(30)]
    texts = [word(rng.randrange(20, 60)) + s + word(rng.randrange(20, 60)) for s in shared * 2 + shared[:1] * 6]
    want = repeat_oracle([t.encode() for t in texts], 24)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "1g",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOC).repartition(4, "doc_id")
        got = repeats.remove_repeats(docs, length=24, gram=8, group_rows=3).orderBy("doc_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == want
