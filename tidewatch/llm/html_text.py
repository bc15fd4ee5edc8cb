"""Main text of web pages by nearest-URL differencing.

Pages are cut into text lines at block elements. Within a host, pages follow
each other by URL path; each page's lines are aligned with those of three
neighbours on either side by longest common subsequence, and lines that the
neighbours share are the site's, not the page's. Markup that says what it is
(nav, footer, form, advert classes and so on) is left out before lines are
compared; lines inside an article or main element go only if every neighbour
has them.

Where a page has no such element, the neighbours tell which block stands for it:
the sequences of blocks (their path of elements) are aligned in the same way, each
block is weighed by its text here and in the neighbours, and the block with most
of it is the article. Blocks outside it that the neighbours have too are slots of
the site's template and go, though their text differs from page to page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialise, spread

#: Elements whose content is never main text.
SKIPPED = {
    "head", "title", "script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "nav", "menu",
    "footer", "aside", "form", "button", "select", "textarea", "datalist", "dialog", "audio", "video",
}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Words of a class, id or role that mark a block as not being main text.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination",
    "popup", "promo", "promotion", "recommended", "related", "reply", "replies", "respond", "search", "share", "sharing",
    "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "header",
}
#: Words beside a mark that make it say how a block is set up, not what it is ("has-sidebar", "share-enabled").
STATES = {"active", "closed", "disabled", "enabled", "has", "is", "no", "off", "on", "open", "visible", "with", "without"}
OWN = {"article", "main"}
#: Block elements that hold a line, never other parts of a page.
LEAVES = {"address", "caption", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "legend", "li", "p", "pre", "summary", "td", "th"}
#: Elements that a mark in their class or id does not hide.
TRUSTED = {"html", "body", "main", "h1"}
#: A block that a mark names only in part stays if it has over this share of a page's text, and links have no such share of it.
MOST = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _mark(name: str, attributes: str) -> int:
    """2 if the attributes say that the element is hidden or not main text, 1 if they hint at it, else 0.

    A class, id or role whose words are all marks says so; a mark among other words
    is a hint, and with a word of state it is neither.
    """
    if not attributes.strip() or name in ("html", "body"):
        return 0
    found = 0
    for key, value in ATTRIBUTE.findall(attributes):
        key = key.lower()
        value = value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN.search(value)):
            return 2
        if key in ("class", "id", "role") and name not in TRUSTED:
            for token in value.split():
                words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
                marks = [w for w in words if w in MARKS]
                if marks and not STATES & set(words):
                    found = max(found, 2 if len(marks) == len(words) else 1)
    return found


def lines_of(page: str | None) -> list[tuple[bool, str]]:
    """(inside an article or main element, text) of each line of a page that is not skipped."""
    return [line[:2] for line in placed_lines(page)[0]]


def placed_lines(page: str | None) -> tuple[list[tuple[bool, str, int, str]], list[tuple[int, str, int]]]:
    """Lines as (inside an article or main element, text, block, element in it), and blocks as (block around it, element, hash of its path).

    A block is an element that holds other block elements; one that holds text only is an
    element of the block around it. Block 0 is the page.

    White space within a line is one blank, character references are decoded and
    empty lines are left out. End tags close what they name; unclosed elements end
    with the element around them, and a cut-off page ends where it ends. A block
    that a class hints at goes unless most of the page's text is in it.
    """
    page = page or ""
    out: list[tuple[bool, str, int, tuple, int, str]] = []
    stack: list[tuple[str, bool, bool, tuple, bool, int, str]] = []  # what held before: name, skipped, own, hints, link, block, leaf
    blocks: list[tuple[int, str, int]] = [(-1, "", 0)]
    parted = {0}
    block, leaf = 0, ""
    words: list[str] = []
    linked = 0
    skipped = own = link = False
    hints: tuple = ()

    def close_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(words)).split()) if words else ""
        words.clear()
        if text:
            out.append((own, text, min(linked, len(text)), hints, block, leaf))
        linked = 0

    at, size, hinted = 0, len(page), 0
    while at < size:
        token = TOKEN.match(page, at)
        at = token.end()
        name = token[2]
        if name is None:
            text = token[0]
            if not skipped and not (text[0] == "<" and len(text) > 1):
                words.append(text)
                linked += len(text) if link else 0
            continue
        name = name.lower()
        if name in BLOCKS or name in SKIPPED:
            close_line()
        elif name == "br":
            words.append(" ")
        if token[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    _, skipped, own, hints, link, block, leaf = stack[i]
                    del stack[i:]
                    break
            continue
        if name in VOID or (token[3].rstrip().endswith("/") and name not in BLOCKS):
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:
            _, skipped, own, hints, link, block, leaf = stack.pop()
        stack.append((name, skipped, own, hints, link, block, leaf))
        if name in BLOCKS and name not in ("html", "body"):
            parted.add(block)
            if name in LEAVES:
                leaf = name
            else:
                blocks.append((block, name, xxh64_intdigest(name.encode(), blocks[block][2])))
                block, leaf = len(blocks) - 1, ""
        mark = _mark(name, token[3])
        article = name in OWN or bool(re.search(r"role\s*=\s*[\"']?main\b", token[3]))
        skipped = skipped or name in SKIPPED or name == "header" or mark == 2
        if mark == 1 and not skipped:
            hints = (*hints, hinted)
            hinted += 1
        own = (own or article) and not skipped
        link = link or name == "a"
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]|</{re.escape(name)}\Z", re.I).search(page, at)
            at = end.start() if end else size
    close_line()
    sizes, links = [0] * hinted, [0] * hinted
    for _, text, n, of, _, _ in out:
        for h in of:
            sizes[h] += len(text)
            links[h] += n
    whole = sum(len(text) for _, text, *_ in out)
    gone = {h for h in range(hinted) if not (sizes[h] > MOST * whole and links[h] < MOST * sizes[h])}
    found = []
    for inside, text, _, of, at, part in out:
        if not gone.intersection(of):
            if at not in parted:
                at, part = blocks[at][:2]
            found.append((inside, text, at, part))
    return found, blocks


def runs_of(lines: list[tuple[bool, str, int, str]], blocks: list[tuple[int, str, int]]) -> tuple[list, list, list, list]:
    """Lines of one block and element that follow each other are a run: (run of each line, slot, size and block of each run).

    A slot is a hash of the path of elements to a run. A main heading, which is never outside the
    article, has its block's complement.
    """
    run_of, slots, spans, places = [], [], [], []
    before = None
    for _, text, block, leaf in lines:
        if (block, leaf) != before:
            before = block, leaf
            slots.append(xxh64_intdigest(f"/{leaf}".encode(), blocks[block][2]) - (1 << 63))
            spans.append(0)
            places.append(~block if leaf == "h1" else block)
        run_of.append(len(slots) - 1)
        spans[-1] += len(text)
    return run_of, slots, spans, places


def article_runs(places: list[int], parents: list[int], weights: list[int], slots: list[int]) -> set[int]:
    """The runs of the block that has most of the weight: from the page inwards while one block in a block has over half of it.

    Blocks of one make that stand side by side are parts of one article, so none is picked of these. Where no block has
    over half, there is none.
    """
    weight, make = [0] * len(parents), [0] * len(parents)
    held = [~place if place < 0 else place for place in places]
    for run, block in enumerate(held):
        weight[block] += weights[run]
        make[block] += slots[run]
    within: dict[int, list[int]] = {}
    for block in range(len(parents) - 1, 0, -1):  # a block comes after the one around it
        weight[parents[block]] += weight[block]
        make[parents[block]] += make[block]
        within.setdefault(parents[block], []).append(block)
    at = 0
    while at in within:
        best = max(within[at], key=lambda b: (weight[b], -b))
        if 2 * weight[best] <= weight[at] or any(b != best and make[b] == make[best] for b in within[at]):
            break
        at = best
    if at == 0:
        return set()
    inside = [False] * len(parents)
    for block in range(at, len(parents)):
        inside[block] = block == at or (block > at and inside[parents[block]])
    return {run for run, block in enumerate(held) if inside[block]}


def template_lines(runs: list[int], places: list[int], parents: list[int], slots: list[int], spans: list[int], votes: dict) -> tuple[set[int], set[int]]:
    """(places of lines in the article, places of lines in the template's slots) of a page that does not mark its article.

    ``votes`` holds, for each run, how many neighbours have it and their text in it,
    and how many neighbours there are, one or more. A slot is in half of three or more
    neighbours, or in all of fewer.
    """
    n = votes["n"]
    weights = [own + more for own, more in zip(spans, votes["text"], strict=True)]
    article = article_runs(places, parents, weights, slots)
    if not article:
        return set(), set()
    slot = {r for r in range(len(slots)) if r not in article and places[r] >= 0 and (2 * votes["have"][r] >= n if n >= 3 else votes["have"][r] == n)}
    kept = {i for i, r in enumerate(runs) if r in article or places[r] < 0}
    return kept, {i for i, r in enumerate(runs) if r in slot}


def _ahead(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each length of a beginning of y, the longest common subsequence of it and all of x."""
    best = np.zeros(len(y) + 1, np.int32)
    for line in x:
        best[1:] = np.maximum.accumulate(np.maximum(np.where(y == line, best[:-1] + 1, 0), best[1:]))
    return best


def _table_pairs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        row = np.where(y == x[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    found, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return found


#: Cells of a table of two parts of pages; larger ones are halved first, so that memory is linear in the lines.
TABLE_CELLS = 1 << 20


def _pairs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by halving x where the best ways through both halves meet."""
    if not len(x) or not len(y):
        return []
    if len(x) * len(y) <= TABLE_CELLS or len(x) == 1:
        return _table_pairs(x, y)
    half = len(x) // 2
    cut = int(np.argmax(_ahead(x[:half], y) + _ahead(x[half:][::-1], y[::-1])[::-1]))
    return _pairs(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in _pairs(x[half:], y[cut:])]


def common_lines(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of a longest common subsequence of two lists of line hashes."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    # Lines that the other side lacks are in no common subsequence.
    i_of, j_of = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    found = _pairs(x[i_of], y[j_of])
    left = [*range(head), *(int(i_of[i]) + head for i, _ in found), *range(len(a) - tail, len(a))]
    right = [*range(head), *(int(j_of[j]) + head for _, j in found), *range(len(b) - tail, len(b))]
    return left, right


PAGE_SCHEMA = (
    "page_id long, url string, host string, path string, own array<boolean>, lines array<string>, "
    "runs array<int>, slots array<long>, spans array<int>, places array<int>, parents array<int>, digest binary"
)


def _line_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("own", pa.list_(pa.bool_())), ("lines", pa.list_(pa.string())), ("runs", pa.list_(pa.int32())), ("slots", pa.list_(pa.int64())),
            ("spans", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("parents", pa.list_(pa.int32())), ("digest", pa.binary()),
        ]
    )
    for batch in batches:
        rows = []
        for page in batch.column(4):
            lines, blocks = placed_lines(page.as_py())
            own = [line[0] for line in lines]
            # Only a page without an article needs to be told where it is.
            parts = ([],) * 5 if any(own) else (*runs_of(lines, blocks), [b[0] for b in blocks])
            cells = [own, [line[1] for line in lines], *parts]
            rows.append([*cells, sha256(repr(cells).encode()).digest()])
        columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
        yield pa.record_batch([*batch.columns[:4], *columns], names=["page_id", "url", "host", "path", *schema.names])


def neighbours(rows: DataFrame) -> DataFrame:
    """(key, lines, sizes, slots, spans) of two pages that follow each other by path in their host.

    Up to ``REACH`` pages back are paired with each page. Rows are sorted by range,
    so a host of any size is spread over tasks; the one table that is ordered
    whole has a row a partition.
    """
    placed = materialise(
        rows.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
        .withColumn("at", F.monotonically_increasing_id()),
        "html-order",
    )
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg((F.max(within) + 1).alias("n"))
    bases = counts.selectExpr("part", "sum(n) over (order by part) - n as base")
    numbered = placed.withColumn("part", part).join(bases, "part").withColumn("row", F.col("base") + within).drop("part", "base", "at")
    back = F.explode(F.sequence(F.lit(1), F.lit(REACH)))
    a, b = numbered.alias("a"), numbered.withColumn("back", back).withColumn("previous", F.col("row") - F.col("back")).alias("b")
    return a.join(b, (F.col("a.row") == F.col("b.previous")) & (F.col("a.host") == F.col("b.host"))).select(
        *[F.col(f"{side}.{c}").alias(f"{c}{n}") for side, n in (("a", 1), ("b", 2)) for c in ("key", "lines", "sizes", "slots", "spans")]
    )


#: Pages on either side with which a page is compared.
REACH = 3
#: A pair that shares more of either page's text than this may be a pair of copies; a line that only such pairs share stays.
COPY_SHARE = 0.6


VOTE_SCHEMA = "key long, places array<int>, copy boolean, runs array<int>, text array<int>"


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, places, copies, runs, texts = [], [], [], [], []
        for row in zip(*batch.columns, strict=True):
            key, key2 = row[0].as_py(), row[5].as_py()
            a, size_a, slots_a, spans_a, b, size_b, slots_b, spans_b = (x.values.to_numpy() for x in (*row[1:5], *row[6:]))
            left, right = common_lines(a, b)
            copy = size_a[left].sum() > COPY_SHARE * size_a.sum() or size_b[right].sum() > COPY_SHARE * size_b.sum()
            here, there = common_lines(slots_a, slots_b)
            keys += [key, key2]
            places += [left, right]
            copies += [bool(copy)] * 2
            runs += [here, there]
            texts += [spans_b[there], spans_a[here]]
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (places, runs, texts)]
        yield pa.record_batch([pa.array(keys, pa.int64()), lists[0], pa.array(copies, pa.bool_()), *lists[1:]], names=["key", "places", "copy", "runs", "text"])


def site_lines(votes: list[tuple[list[int], bool]]) -> tuple[list[int], list[int]]:
    """Places of the lines that half of the neighbours share, and of those that all of three or more share.

    ``votes`` has the shared places of each neighbour and whether the two may be
    copies. A line needs a neighbour that is no copy.
    """
    every = Counter(i for places, _ in votes for i in places)
    told = {i for places, copy in votes if not copy for i in places}
    n = len(votes)
    half = sorted(i for i in told if 2 * every[i] >= n)
    return half, [i for i in half if n >= 3 and every[i] == n]


FOUND_SCHEMA = "key long, half array<int>, whole array<int>, inside array<int>, slot array<int>"


def _site_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for votes, *page in zip(*batch.columns[1:], strict=True):
            votes = votes.as_py()
            runs, places, parents, slots, spans = (x.as_py() for x in page)
            have, text = [0] * len(slots), [0] * len(slots)
            for v in votes:
                for r, n in zip(v["runs"], v["text"], strict=True):
                    have[r] += 1
                    text[r] += n
            told = template_lines(runs, places, parents, slots, spans, {"n": len(votes), "have": have, "text": text})
            found.append([*site_lines([(v["places"], v["copy"]) for v in votes]), *map(sorted, told)])
        lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in range(4)]
        yield pa.record_batch([batch.column(0), *lists], names=["key", "half", "whole", "inside", "slot"])


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for owns, lines, *found in zip(*batch.columns[2:], strict=True):
            owns = owns.as_py()
            half, whole, inside, slot = (set(x.as_py() or ()) for x in found)
            marked = any(owns)
            stays = [
                own >= marked and i not in slot and i not in (whole if marked or i in inside else half) for i, own in enumerate(owns)
            ]
            texts.append("\n".join(x for x, stay in zip(lines.as_py(), stays, strict=True) if stay))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


#: Columns of a page's template; empty where the page marks its article.
PARTS = ("runs", "places", "parents", "slots", "spans")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    A null or empty page has an empty text; very long ones are read whole. Pages of a host whose lines are all
    equal are compared as one and all returned. Pages whose URL is null or has no
    host are neighbours of each other.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    parsed = materialise(slim.mapInArrow(_line_batches, PAGE_SCHEMA), "html-lines")
    hashed = parsed.where(F.size("lines") > 0).select(
        "host", "path", "digest", F.transform("lines", lambda x: F.xxhash64(x)).alias("lines"), F.transform("lines", lambda x: F.length(x)).alias("sizes"),
        *PARTS,
    )
    distinct = hashed.groupBy("host", "digest").agg(F.min(F.struct("path", "lines", "sizes", *PARTS)).alias("page"))
    distinct = materialise(distinct.select(F.monotonically_increasing_id().alias("key"), "host", "digest", "page.*"), "html-distinct")
    pairs = neighbours(distinct.drop("digest", "runs", "places", "parents")).mapInArrow(_shared_batches, VOTE_SCHEMA)
    votes = pairs.groupBy("key").agg(F.collect_list(F.struct("places", "copy", "runs", "text")).alias("votes"))
    votes = votes.where(F.exists("votes", lambda v: (F.size(v["places"]) > 0) | (F.size(v["runs"]) > 0)))
    judged = votes.join(distinct.select("key", *PARTS), "key").select("key", "votes", *PARTS)
    found = judged.mapInArrow(_site_batches, FOUND_SCHEMA).where("size(half) > 0 OR size(slot) > 0")
    shared = materialise(found.join(distinct.select("key", "host", "digest"), "key").drop("key"), "html-shared")
    joined = parsed.join(shared, ["host", "digest"], "left").select("page_id", "url", "own", "lines", "half", "whole", "inside", "slot")
    return joined.mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each row of ``pages``; null and empty pages have an empty one, repeated rows are returned each."""
    return main_text(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
