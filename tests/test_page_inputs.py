"""All kinds of page views against a plain version."""

import re

from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import views
from tidewatch.plans import alerting


def distinct(items, key=lambda x: x):
    out = {}
    for x in items:
        out.setdefault(key(x), x)
    return list(out.values())


def plain(markup):
    out = re.sub(r"<[^>]*>", " ", markup, flags=re.S)
    for reference, character in views._ENTITIES:
        out = out.replace(reference, character)
    return " ".join(out.split())


def every(html, pattern):
    return [x for x in map(plain, re.findall(pattern, html, re.I | re.S)) if x]


def low(word):
    return word.translate(str.maketrans(text.UPPER, text.LOWER))


def inputs(html, url):
    html = re.sub(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html, flags=re.I | re.S)
    content = " ".join(every(html, r"<p\b[^>]*>(.*?)(?=</?p\b|</?article\b|</?div\b|$)"))
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", content) if len(s) >= 3]
    tokens = [w for w in (re.sub(r"^[^\w-]+|[^\w-]+$", "", w) for w in content.split()) if w]
    keywords = distinct([w for w in map(low, tokens) if len(w) >= 3 and w not in text.STOPWORDS])[:24]
    runs, run = [], []
    for i, w in enumerate([*tokens, ""]):
        if w and w[0].isupper() and any(c.islower() for c in w[1:]) and not (i == 0 and low(w) in text.INSTRUCTIONS):
            run.append(w)
        elif run:
            runs.append(" ".join(run))
            run = []
    entities = distinct(runs, low)[:12]
    path = re.match(r"[^:]+://[^/?#]*([^?#]*)", url)
    words = distinct([w for w in re.split(r"[^a-z0-9]+", low(path[1] if path else "")) if len(w) >= 2 and not w.isdigit()])
    tagged = lambda kind, items: distinct([(kind, x[:700], views.WEIGHTS[kind]) for x in items])
    first = tagged("title", every(html, r"<title\b[^>]*>(.*?)</title")[:1]) + tagged("heading", every(html, r"<h[1-3]\b[^>]*>(.*?)</h[1-3]")) + tagged("summary", sentences[:1])
    last = tagged("keyword", keywords) + tagged("entity", entities) + tagged("url_signal", words)
    found = first + tagged("sentence", sentences)[: max(96 - len(first) - len(last), 0)] + last
    return (found or tagged("document", [content] if content else []))[:96]


def test_all_kinds_against_a_plain_version(spark, sf):
    got = {}
    for r in alerting.QUERIES["page_inputs"](spark, sf).orderBy("page_id", "ordinal").collect():
        got.setdefault(r.page_id, []).append((r.kind, r.text, r.weight))
    want = {r.page_id: inputs(r.html, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert got == {i: x for i, x in want.items() if x}
    assert {"title", "heading", "summary", "sentence", "keyword", "entity", "url_signal"} <= {k for x in got.values() for k, _, _ in x}


def test_sentences_fill_the_room(spark):
    html = "<p>" + " ".join(f"Sentence {i} is short." for i in range(180)) + "</p>"
    got = [r.kind for r in views.with_page_inputs(spark.range(1), "x", F.lit(html), F.lit("https://e.com/a-news")).select(F.inline("x")).collect()]
    assert len(got) == 96 and got[-1] == "url_signal" and got.count("sentence") == 69
