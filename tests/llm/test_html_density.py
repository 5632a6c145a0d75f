"""Pages whose text hangs on densities: evidence that has to give way, parts of articles, and what stays out."""

import pytest

from tessera.llm import html

NAV = "<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>"
FOOT = "<footer>Imprint and more of the publisher of it all</footer>"
TWO = "<p>A paragraph of some words here.</p><p>Another paragraph of words, many of them.</p>"
LINES = "A paragraph of some words here.\nAnother paragraph of words, many of them."
COMMENTS = "<div class=comments><h2>2 comments</h2><article class=comment><p>I think so.</p></article><article class=comment><p>So do I, in many many more words than the article has.</p></article></div>"
PAGES = {
    "short text in a form": (f"{NAV}<div class='post-form'><h1>Title</h1><p>Short text of it.</p></div>{FOOT}", "Title\nShort text of it."),
    "banner with small headings": (f"{NAV}<div class='banner-page'><h3>One part</h3>{TWO}</div>{FOOT}", "One part\n" + LINES),
    "imprint without evidence": (f"{NAV}<div class='post social-issues'><h1>Title</h1>{TWO}</div><div>Imprint of the publisher, all rights reserved</div>", "Title\n" + LINES),
    "brief section": (f"{NAV}<main><section><h1>Title</h1>{TWO}</section><section><p>Brief.</p></section><div><a href=x>Other</a> <a href=y>More</a></div></main>{FOOT}", f"Title\n{LINES}\nBrief."),
    "heading beside the text": (f"{NAV}<div id=c><h1>Title</h1><div>{TWO}</div></div>{FOOT}", "Title\n" + LINES),
    "comments longer than the article": (f"{NAV}<article><h1>Title</h1><p>Words.</p>{COMMENTS}</article>{COMMENTS}{FOOT}", "Title\nWords."),
}


@pytest.mark.parametrize("name", PAGES)
def test_article_of_the_page(name):
    page, want = PAGES[name]
    assert html.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>") == want


def test_density_decides(monkeypatch):
    """Without densities the same pages give other texts."""

    def flat(nodes):
        for node in nodes:
            node.chars, node.density, node.total = 1, 0.0, 0.0

    monkeypatch.setattr(html, "weigh", flat)
    changed = {name for name, (page, want) in PAGES.items() if html.main_text(page) != want}
    assert {"short text in a form", "banner with small headings", "imprint without evidence", "brief section"} <= changed


def test_the_denser_of_two_parts_with_evidence():
    long = "<p>" + "Many words of a long text that goes on. " * 10 + "</p>"
    page = f"<body>{NAV}<div class='search-form'><h3>Form</h3><p>Fill it in.</p></div><div class='social-issues'><h3>Issues</h3>{long}{long}</div>{FOOT}</body>"
    assert html.main_text(page).startswith("Issues\nMany words") and "Fill" not in html.main_text(page)


def test_notices_alone_are_no_article():
    assert html.main_text(f"<body><div class=notice><p>We use cookies.</p></div>{NAV}{FOOT}</body>") == ""
    assert html.main_text("<p>One</p><div class=ad>Buy this now and get many more of it for free today</div>") == "One"


def test_very_deep_and_very_long_pages():
    assert html.main_text("<div>" * 30_000 + "deep text" + "</div>" * 30_000) == "deep text"
    text = "<p>" + "words of a long page " * 50 + "</p>"
    assert html.main_text(f"<body>{NAV}<article>{text * 2000}</article>{FOOT}</body>").count("\n") == 1999


def test_repeated_rows_each_get_a_row(spark):
    page = f"<body>{NAV}<article><h1>Title</h1>{TWO}</article></body>"
    found = html.extract(spark.createDataFrame([(1, "u", page)] * 3 + [(2, "u", None)], "page_id long, url string, html string")).collect()
    assert sorted(r["n_chars"] for r in found) == [0] + [len("Title\n" + LINES)] * 3
