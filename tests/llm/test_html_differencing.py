"""Main text by differencing where pages mark it, where they don't and where both are mixed."""

import re

import pytest

from tidewatch.llm import html_text

OWN = [f"Story {i} tells of matter {i * 7} and of nothing else at all, at some length." for i in range(9)]
SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    rows = [(i, f"http://h.example/a/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in sorted(html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect())]


def test_site_wide_line_inside_articles(spark):
    page = "<body><article><p>{}</p><p>{}</p><p>Tell us what you think</p></article></body>"
    got = texts(spark, [page.format(t, "A saying that two tell" if i in (3, 4) else f"End {i}") for i, t in enumerate(OWN)])
    assert got == [f"{t}\n" + ("A saying that two tell" if i in (3, 4) else f"End {i}") for i, t in enumerate(OWN)]


def test_unmarked_page_among_marked_ones(spark):
    page = "<body><div>Top of the site</div><{0}><p>{1}</p></{0}><div>All rights reserved</div></body>"
    assert texts(spark, [page.format("div" if i == 4 else "article", t) for i, t in enumerate(OWN)]) == OWN


def test_copies_stay(spark):
    page = "<body><div>Top of the site</div><div>{}</div><div>End</div></body>"
    kept = [OWN[2] if i in (2, 3) else t for i, t in enumerate(OWN)]
    assert texts(spark, [page.format(t) for t in kept]) == kept


def stripped(page, all_marks):
    page = re.sub(r"(?i)<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""(?i)\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*')""", "", page) if all_marks else page


@pytest.mark.parametrize("all_marks", [False, True])
def test_pages_stripped_of_their_markup(spark, all_marks):
    """Without article and main elements, and without classes, ids and roles too, the neighbours alone decide.

    A page that is alone on its host has none, so it is not counted.
    """
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    want = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    bare = [(r.page_id, r.url, stripped(r.html, all_marks)) for r in rows]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(bare, SCHEMA)).collect()}
    host = {r.page_id: r.url.split("/")[2].lower() for r in rows}
    near = [i for i in want if list(host.values()).count(host[i]) > 1]
    assert len(near) > 200 and sum(got[i] == want[i] for i in near) >= 0.98 * len(near)


def test_slots_whose_text_differs_from_page_to_page(spark):
    page = (
        "<body><div>Offer {0}{0} today</div><div><ul><li>Menu {0}</li><li>More {0}</li></ul></div><div><h1>Head {0}</h1><p>{1}</p><p>End {0}</p></div>"
        "<div><p>Reader {0} says no</p></div><div>Seen {0} times</div></body>"
    )
    assert texts(spark, [page.format(i, t) for i, t in enumerate(OWN)]) == [f"Head {i}\n{t}\nEnd {i}" for i, t in enumerate(OWN)]


def test_slots_around_an_article_of_one_word(spark):
    """The neighbours' text in a block counts for it, so an advert longer than a page's own article is no article."""
    page = "<body><div>An offer of day {0} that goes on for longer than one word</div><div><h1>Head {0}</h1><p>{1}</p></div></body>"
    own = ["Short" if i == 4 else t for i, t in enumerate(OWN)]
    assert texts(spark, [page.format(i, t) for i, t in enumerate(own)]) == [f"Head {i}\n{t}" for i, t in enumerate(own)]


def test_sections_side_by_side_stay_together(spark):
    page = "<body><div>Offer {0}</div><div><section><p>{1} {1}</p></section><section><p>Next {0}</p></section><section><p>Last {0}</p></section></div></body>"
    assert texts(spark, [page.format(i, t) for i, t in enumerate(OWN)]) == [f"{t} {t}\nNext {i}\nLast {i}" for i, t in enumerate(OWN)]


def test_pages_without_a_template_keep_what_differs(spark):
    """Flat pages, blocks that neighbours lack and a page alone on its host: nothing is told, only shared lines go."""
    flat = "<body><div>Top of the site</div><div>Offer {0}</div><div>{1}</div></body>"
    assert texts(spark, [flat.format(i, t) for i, t in enumerate(OWN)]) == [f"Offer {i}\n{t}" for i, t in enumerate(OWN)]
    page = "<body>{2}<div><h1>Head {0}</h1><p>{1}</p></div></body>"
    extra = [page.format(i, t, "<div>A note of this page alone</div>" if i == 4 else "") for i, t in enumerate(OWN)]
    assert texts(spark, extra) == [("A note of this page alone\n" if i == 4 else "") + f"Head {i}\n{t}" for i, t in enumerate(OWN)]
    few = "<body><div>Offer {0}</div><div><h1>Head {0}</h1><p>{1}</p></div></body>"
    assert texts(spark, [few.format(0, OWN[0])]) == [f"Offer 0\nHead 0\n{OWN[0]}"]
    assert texts(spark, [few.format(i, t) for i, t in enumerate(OWN[:2])]) == [f"Head {i}\n{t}" for i, t in enumerate(OWN[:2])]


def test_deep_and_very_long_pages(spark):
    deep = "<div>" * 20000 + "Far down"
    long = "<body><div>" + "".join(f"<p>Line {i} of a long page</p>" for i in range(20000)) + "</div></body>"
    got = spark.createDataFrame([(0, "http://h.example/a", deep), (1, "http://h.example/b", long), (2, "http://h.example/c", deep)], SCHEMA)
    rows = {r.page_id: r for r in html_text.main_text(got).collect()}
    assert rows[0].text == rows[2].text == "Far down"
    assert rows[1].text.count("\n") == 19999 and rows[1].n_chars == len(rows[1].text)


def test_article_runs_take_the_block_with_most_text():
    # Page 0 holds blocks 1 and 2, block 2 holds 3 and 4.
    places, parents = [0, 1, 2, 3, 4], [-1, 0, 0, 2, 2]
    assert html_text.article_runs(places, parents, [1, 2, 9, 3, 3], [1, 2, 3, 4, 5]) == {2, 3, 4}
    assert html_text.article_runs(places, parents, [1, 2, 1, 30, 3], [1, 2, 3, 4, 5]) == {3}
    assert html_text.article_runs(places, parents, [1, 2, 1, 30, 3], [1, 2, 3, 4, 4]) == {2, 3, 4}
    assert html_text.article_runs(places, parents, [50, 2, 9, 3, 3], [1, 2, 3, 4, 5]) == set()
    assert html_text.article_runs([], [-1], [], []) == set()
