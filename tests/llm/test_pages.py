"""Pages whose parts bear names that mislead, forms around pages, and markup that is made to be slow."""

import os
import time
from html.parser import HTMLParser

import pytest

from glossaloom.llm.html_extract import extract, extract_text
from tests.llm.test_verdict import clashing, kept_extras

LONG = "A paragraph, of some length, that says what the article is about, at last."
ARTICLE = f"<h1>Title</h1><p>{LONG}</p>"


@pytest.mark.parametrize(
    "inside, text",
    [
        (f'<section id="discussion"><h2>Discussion</h2><p>{LONG}</p></section>', f"Discussion {LONG}"),
        ('<h2 id="related-work">Related work</h2><p>Others did so.</p>', "Related work Others did so."),
        ('<h2 id="legal-framework" class="header">Legal framework</h2>', "Legal framework"),
        (f'<p class="notice-period">{LONG}</p>', LONG),
        ('<p class="notice">We use cookies.</p>', ""),
        ('<p><a href=x>One sentence that is a link.</a></p>', "One sentence that is a link."),
        (f"<ol><li><a href=1>A work of some length about a matter, volume 1</a></li><li><a href=2>A work of some length about a matter, volume 2</a></li></ol>", "A work of some length about a matter, volume 1 A work of some length about a matter, volume 2"),
        (f'<section class="comments"><p>{LONG}</p></section><div id="sidebar"><p>{LONG}</p></div>', ""),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<ul><li>one<li>two</ul>", "one two"),
    ],
)
def test_parts_of_an_article(inside, text):
    assert extract(f"<html><body><nav><a href=x>Home</a></nav><article>{ARTICLE}{inside}</article><footer>f</footer></body></html>") == f"Title {LONG} {text}".strip()


@pytest.mark.parametrize("names", ['class="content-with-sidebar"', 'class="layout sidebar-right"', 'id="page-menu-open"', 'class="has-sidebar"', 'class="sidebar"', 'id="comments-open"'])
def test_names_of_what_is_round_the_page(names):
    menu = "<ul class=menu><li><a href=1>Home</a><li><a href=2>News</a></ul>"
    assert extract(f"<body><div {names}>{menu}{ARTICLE}<p>{LONG}</p></div></body>") == f"Title {LONG} {LONG}"
    assert extract(f"<body><div {names}>{menu}<article>{ARTICLE}<p>{LONG}</p></article><div class=sidebar><p>{LONG}</p></div></div></body>") == f"Title {LONG} {LONG}"


@pytest.mark.parametrize("part", ['<div id="discussion">{}</div>', '<div class="side-effects">{}</div>', '<div class="related-work">{}</div>', '<section id="legal">{}</section>', '<section id="search-methods">{}</section>', '<div class="notice-period">{}</div>'])
def test_parts_whose_names_mean_something_else(part):
    inside = part.format(f"<h2>Part</h2><p>{LONG}</p>")
    assert extract(f"<body><article>{ARTICLE}{inside}</article></body>") == f"Title {LONG} Part {LONG}"


def test_table_called_register():
    assert extract(f'<body><article>{ARTICLE}<table class="register"><tr><td>One</td><td>Two</td></tr></table></article></body>') == f"Title {LONG} One Two"


COMMENT = "I do not agree, as it is not so, and nobody says it is, but you."


@pytest.mark.parametrize(
    "part",
    [
        '<section id="comments"><h2>Comments</h2>{}</section>', '<section id="comments">{}</section>', '<div class="comment-list">{}</div>', '<div id="post-comments-area">{}</div>', '<div class="disqus">{}</div>', '<ol class="commentlist"><li>{}</ol>',
        '<section id="newsletter"><h2>Newsletter</h2>{}</section>', '<section id="related">{}</section>', '<div class="related-posts">{}</div>', '<p class="advert text">Buy, now.</p>', '<div class="ad-slot-1">{}</div>', '<div class="cookie-banner">{}</div>', '<article class="comment">{}</article>', '<div class="notice">{}</div>',
    ],
)
def test_parts_that_are_not_the_article(part):
    for n in (1, 40):  # more text than the article has
        inside = part.format(f"<p>{COMMENT}</p>" * n)
        assert extract(f"<body><article>{ARTICLE}{inside}</article></body>") == f"Title {LONG}"
        assert extract(f"<body><article>{ARTICLE}</article>{inside}</body>") == f"Title {LONG}"
        assert extract(f"<body><div class=post>{ARTICLE}<p>{LONG}</p></div>{inside}</body>") == f"Title {LONG} {LONG}"


def test_only_pages_without_text_are_empty():
    assert extract('<body><div class="sidebar">Alone</div></body>') == "Alone"
    assert extract('<body><div class="comments"><ul><li><a href=1>a b</a><li><a href=2>c</a></ul></div></body>') == "a b c"
    assert extract("<body><span>few words</span></body>") == "few words"
    assert extract("<a href=x>link</a>") == "link"
    assert extract("<body><nav>Menu</nav><script>x</script></body>") == extract("<body> \n </body>") == ""


class Plain(HTMLParser):
    """The text of the article element, with marks where blocks begin and end; adverts are passed over."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.text, self.article, self.advert = [], 0, 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.article += tag == "article"
        self.advert += tag == "div" and (self.advert or dict(attrs).get("class") == "ad")
        if tag in ("p", "br", "h1", "div", "article"):
            self.text.append(" ")

    def handle_endtag(self, tag):
        self.article -= tag == "article"
        self.advert -= bool(self.advert and tag == "div")
        if tag in ("p", "h1", "div", "article"):
            self.text.append(" ")

    def handle_data(self, data):
        if self.article and not self.advert:
            self.text.append(data)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_pages_against_plain(spark):
    """On these pages the article element is the article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in extract_text(pages).collect()}
    expected = {r.page_id: " ".join("".join(Plain(r.html or "").text).split()) for r in pages.collect()}
    assert found == expected and sum(map(len, expected.values())) > 100_000


def test_form_around_the_page():
    inside = f"<input name=q><select><option>a</select><nav><a href=x>Home</a></nav><div id=main>{ARTICLE}<p>{LONG}</p></div>"
    assert extract(f"<html><body><form id=aspnet>{inside}</form></body></html>") == f"Title {LONG} {LONG}"
    assert extract(f"<html><body><form>{inside}") == f"Title {LONG} {LONG}"
    assert extract(f"<html><body><article>{ARTICLE}<p>{LONG}</p></article><form><p>Your name</p></form></body></html>") == f"Title {LONG} {LONG}"


def test_open_tags_and_quotes():
    assert extract(f'<div title="a > b"><p>{LONG}</p></div>') == LONG
    assert extract(f"<div><p don't>{LONG}</p></div>") == LONG
    assert extract(f"<div><p>{LONG}</p><p>1 < 2 and 3 > 2, so it is.</p></div>") == f"{LONG} 1 < 2 and 3 > 2, so it is."
    assert extract(f"<div><p>{LONG}</p><b") == LONG


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 350_000, "<a \"'" * 200_000, "<div>" * 200_000 + f"<p>{LONG}", "<b>" * 150_000 + "</p>" * 150_000 + "</x>" * 50_000, "<ul>" + "<b>" * 150_000 + "<li></li>" * 80_000, "<nav>" + "<b>" * 150_000 + "</x>" * 150_000,
        "<blockquote>" * 80_000 + LONG, "<div>" * 100_000 + "<a>x</a><a>y</a>", "<li><div>" + "<b>" * 100_000 + "</li>" * 100_000, "<!--" * 250_000, "<script>" * 120_000, "<form>" * 100_000 + LONG, "<a =" * 250_000, "&amp" * 250_000,
    ],
    ids=range(14),
)
def test_long_pages_take_linear_time(html):
    times = []
    for part in (html[: len(html) // 4], html):
        started = time.process_time()
        extract(part)
        times.append(time.process_time() - started)
    assert times[1] < 12 * times[0] + 1, times


def test_tables_of_pages(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>"), (1, "u", f"<p>{LONG}</p>"), (None, None, None), (2, "", "")], "page_id long, url string, html string")
    found = extract_text(clashing(df))
    assert kept_extras(df, found) and sorted(found.collect(), key=str)[0].n_chars == len(LONG)
    assert sorted(r.text for r in found.collect()) == ["", "", LONG, LONG]
    assert extract_text(df.limit(0)).collect() == []
