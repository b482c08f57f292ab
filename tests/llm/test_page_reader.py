"""Pages: hostile markup, names of article parts, empty tables."""

import random
import re
import time

import pytest

from trackweave.llm.html_extract import Page, Tags, main_text

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")


def article(inner):
    return Page(f"<body><article>{inner}</article></body>").text(frozenset())


@pytest.mark.parametrize(
    "part",
    [
        "<div class='post-header'><h1>Own</h1></div>", "<p class='social-history'>Own</p>", "<div class='header'>Own</div>",
        "<section id='introduction-search'>Own</section>", "<div class='Related-Work'>Own</div>", "<div class='relatedWork'>Own</div>",
        "<p><a class='search-term'>Own</a></p>", "<h2 class='banner'>Own</h2>", "<header>Own</header>",
    ],
)
def test_names_that_belong_to_articles(part):
    assert article(part) == "Own"


@pytest.mark.parametrize("name", ["ad", "ad-slot", "comments", "comments-list", "reader_comments", "cookie", "sidebar", "Newsletter"])
def test_names_that_do_not(name):
    assert article(f"<p>Own</p><div class='x {name}'>Other</div>") == "Own"


def test_names_around_an_article():
    page = "<body><div class='with-sidebar'><article>Own</article></div><div class='top-menu'>Other</div></body>"
    assert Page(page).text(frozenset()) == "Own"
    assert Page("<body><div class='site-footer'>Other</div><p>Own</p></body>").text(frozenset()) == "Own"


@pytest.mark.parametrize(
    "unit",
    ["<a ", "<a \"x>\" ", "<a '\"", "<!--", "</p>", "<div>", "<", "<a =\"'", "&amp", "<i></b>", "<script>", "<li class='"],
)
def test_time_is_linear_in_hostile_markup(unit):
    begin = time.time()
    Page(unit * (400_000 // len(unit)) + '"').text(frozenset())
    assert time.time() - begin < 10


def test_deep_elements_that_end_tags_do_not_match():
    begin = time.time()
    assert Page("<i>" * 30_000 + "x" + "</b>" * 30_000).text(frozenset()) == "x"
    assert time.time() - begin < 10


def test_tags_end_where_a_backtracking_pattern_ends_them():
    draw = random.Random(2)
    units = ["<", ">", '"', "'", "a", " ", "<p>", "<b x=", "=", "</p>"]
    for _ in range(3000):
        source = "".join(draw.choice(units) for _ in range(draw.randrange(1, 14)))
        start, end, closing, tag, attributes = Tags(source).after(0)
        wanted = TAG.match(source, start) if tag else None
        assert not tag or (wanted.end(), wanted[1], wanted[2].lower(), wanted[3]) == (end, closing, tag, attributes)


def test_empty_table_and_long_page(spark):
    schema = "page_id long, url string, html string"
    assert main_text(spark.createDataFrame([], schema)).count() == 0
    long = "<article>" + "<p>word and word</p>" * 100_000 + "</article>"
    row = main_text(spark.createDataFrame([(1, "http://a/b", long)], schema)).first()
    assert row.n_chars == 100_000 * len("word and word") + 99_999
