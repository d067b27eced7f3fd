"""Main text of pages: furniture by name, neighbours of the article, layout names, and
the DataFrame operator's defined cases."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from mercato.llm import html_text

PARTS = ["First, it is a paragraph of the article, with commas, and long enough to count.", "Second, it goes on, as prose does, for another while, and ends here."]
PROSE = "".join(f"<p>{p}</p>" for p in PARTS)
LINKS = "<ul><li><a href=/1>One other page</a></li><li><a href=/2>Two other pages</a></li></ul>"
DROPPED = """comment-body comment-content post-comments main-menu sidebar-content ad-content cookie-text related-post footer-content comments
respond reader-comments related-posts notice-body text-ad adBox commentList newsletter-main entry-share social-content menu-main-container
comment-text sponsored-post promo-text cookieConsent gdpr-notice breadcrumbs site-footer post-navigation user-comments story-related""".split()


@pytest.mark.parametrize("name", DROPPED)
def test_furniture_by_name(name):
    """Inside and beside an article, and beside a page without one; as class and id;
    on an article element that is longer than the article."""
    drop = "<p>Out, with it, please.</p><div class=content><p>And, this, too.</p></div>"
    want = "\n".join(PARTS)
    for attr in (f'class="{name}"', f'id="{name}"', f'class="x1 {name}"'):
        assert html_text.main_text(f"<body><article>{PROSE}<div {attr}>{drop}</div></article></body>") == want
        assert html_text.main_text(f"<body><div>{PROSE}<div {attr}>{drop}</div></div></body>") == want
        assert html_text.main_text(f"<body><article>{PROSE}</article><div {attr}>{drop}</div></body>") == want
    if name not in ("respond", "breadcrumbs"):
        long = f"<article class='{name}'><p>{'A long one, of a reader. ' * 40}</p></article>"
        assert html_text.main_text(f"<body><article>{PROSE}</article><section class='{name}'>{long}{long}</section></body>") == want


@pytest.mark.parametrize(
    ("body", "more"),
    [
        (f"<article>{PROSE}</article><article><p>Short.</p></article>", ["Short."]),
        (f"<article>{PROSE}</article><div class=part2><h2>Part 2</h2><p>It ends.</p></div>", ["Part 2", "It ends."]),
        (f"<div><article>{PROSE}</article></div><section><p>More.</p></section>{LINKS}<div>Slogan</div>", ["More."]),
        (f"<main><div>{PROSE}</div><div>Bare text of the page.</div></main><div>Slogan</div>", ["Bare text of the page."]),
        (f"<article>{PROSE}<ul><li>x</li></ul><table><tr><td>1<td>2</table></article>", ["x", "1", "2"]),
        (f"<article class='post tag-ads category-comments comments-open has-sidebar'>{PROSE}</article>", []),
        (f"<div class='content-sidebar-wrap'><div class=entry-content>{PROSE}</div><div class=sidebar><p>Aside.</p></div></div>", []),
        (f"<div id='menu-layout'><article>{PROSE}</article></div>", []),
        (f"<div class='no-ads with-comments'><div>{PROSE}</div></div>", []),
        (f"<article><div class=shared-history>{PROSE}</div></article>", []),
    ],
)
def test_what_stays(body, more):
    page = f"<html><body><nav>{LINKS}</nav>{body}<div class=comments><p>I, a reader, agree.</p></div><footer><p>Foot, of it.</p></footer></body></html>"
    assert html_text.main_text(page).split("\n") == PARTS + more


def test_article_header():
    page = f"<header><h1>Site</h1></header><article><header class=entry-header><h1>Title</h1></header><div class=post-header><p>By me.</p></div>{PROSE}</article><div class=header-text><p>Site, text.</p></div>"
    assert html_text.main_text(page).split("\n") == ["Title", "By me.", *PARTS]


def test_markup_of_any_kind():
    assert html_text.main_text("<article><p>a&nbsp;b &lt;c&gt; &#x41;&amp;amp;<br>d\n\t e<script>x()</script><!-- y --></p><style>p{}</style></article>") == "a b <c> A&amp; d e"
    deep = "<div>" * 3000 + PROSE + "</div>" * 3000
    assert html_text.main_text(deep).split("\n") == PARTS
    assert html_text.main_text("<p>a, b" * 500).count("\n") == 499
    assert html_text.main_text("</p></div>text") == "text"


def test_extract(spark):
    """Null, empty and repeated pages, null ids, columns named like the operator's."""
    page = f"<article>{PROSE}</article>"
    rows = [(1, "u", page, "t", 1), (1, "u", page, "t", 1), (None, None, page, "t", 1), (2, "v", None, None, None), (3, "w", "", "t", 1), (4, "x", "<p>" + "long, text. " * 200_000, "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    want = Counter((i, u, html_text.main_text(h)) for i, u, h, *_ in rows)
    assert Counter(tuple(r) for r in got.collect()) == want and want[1, "u", "\n".join(PARTS)] == 2
    assert got.filter("page_id = 4").select(F.length("text")).first()[0] == 12 * 200_000 - 1
    assert html_text.extract(df.limit(0)).collect() == []
