"""Operator 1 on hand-made pages."""

import html
import time

import pytest

from saleslens.llm import html_text

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Go</a></li></ul></nav><!-- x <p>no</p> -->"
    "<div class=\"ad\">Buy this now</div><article><h1>{title}</h1><p><b>{one}<br><p>{two}</p>"
    "<aside>see also these things</aside><form>name <input></form><p>{three}</p>"
    "<section class='comments'><p>first! nice</p></section></article>"
    "<footer>&copy; all rights</footer></body></html>"
)
PARTS = {"title": "A title", "one": "first  words &amp;\n more", "two": "second &lt;b&gt; words here", "three": "third one"}
EXPECTED = "\n\n".join(" ".join(html.unescape(PARTS[k]).split()) for k in ("title", "one", "two", "three"))


@pytest.fixture(scope="module")
def weights():
    counts = html_text.label_counts(PAGE.format(**PARTS))
    return html_text.weights_of(counts)


def test_article_without_furniture(weights):
    assert html_text.main_text(PAGE.format(**PARTS), weights) == EXPECTED


def test_pages_that_stop_anywhere_do_not_crash(weights):
    page = PAGE.format(**PARTS)
    for at in range(0, len(page), 7):
        html_text.main_text(page[:at], weights)
    cut = page[: page.index("<footer") + 12]
    assert html_text.main_text(cut, weights) == EXPECTED


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>one<p>two<div class='sidebar'>x y</div><p>three and more words", "one\n\ntwo\n\nthree and more words"),
        ("<main><p>a b</p><div id='cookie-notice'>ok?</div><p>c d</p></main>", "a b\n\nc d"),
    ],
)
def test_odd_pages(weights, page, text):
    assert html_text.main_text(page, weights) == text


def test_best_region_is_the_maximum_sum():
    import itertools
    import random

    draw = random.Random(4)
    for _ in range(200):
        scores = [draw.randint(-5, 5) for _ in range(draw.randint(0, 9))]
        first, end = html_text.best_region(scores)
        best = max((sum(scores[a:b]) for a, b in itertools.combinations(range(len(scores) + 1), 2)), default=0)
        assert sum(scores[first:end]) == max(best, 0)


def test_query_shape_on_nulls_and_repeated_rows(spark):
    rows = [(1, "u", PAGE.format(**PARTS)), (1, "u", PAGE.format(**PARTS)), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "t", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect())
    assert got == [(0, "", 0), (1, EXPECTED, len(EXPECTED)), (1, EXPECTED, len(EXPECTED)), (2, "", 0)]
    assert html_text.extract_pages(pages.limit(0)).collect() == []


CASES = {
    # quotes count right after the equals sign alone
    "<article><p title=it's>Hello world this is text.</p><p>And it's more.</p></article>": "Hello world this is text.\n\nAnd it's more.",
    "<article><p a='x>y' b=\"p>q\">One two three.</p></article>": "One two three.",
    "<article><p a = 'x' c=d/e>One two three.</p></article>": "One two three.",
    '<article><p a="never closed>One two three.</p></article>': "One two three.",
    '<article><p a=b"c"d>One two three.</p></article>': "One two three.",
    "<article><p a=1 <b>One two three.</p></article>": "One two three.",
    # names of paragraphs inside an article are its own affair, those of containers tell furniture
    "<article><p class='search-results notice'>Important words here.</p></article>": "Important words here.",
    "<article><p>Text of it.</p><div class='ad box'>Buy this now.</div><p>More of it.</p></article>": "Text of it.\n\nMore of it.",
    "<article><p>a < b and c <3 d, 5<6</p></article>": "a < b and c <3 d, 5<6",
    # no marked content
    "<body><div class=menu><a href=x>Home</a></div><div><p>One long paragraph of plain words in the page.</p>"
    "<p>Another long paragraph of plain words.</p></div><div id='footer'>Imprint</div></body>":
        "One long paragraph of plain words in the page.\n\nAnother long paragraph of plain words.",
    "<p>One two three four five.<!-- never closed": "One two three four five.",
    "<p>One two three four five.<p attr": "One two three four five.",
}


@pytest.mark.parametrize("page", CASES)
def test_markup_as_it_is_written(page):
    assert html_text.main_text(page, {}) == CASES[page]


@pytest.mark.parametrize("piece", ["<a x=\"", "<p title='", "<", "<!", "<!--", "</", "<a b=c'", "<script>", "< a='>'", "<b>", "</b></i>", "<b><div></div></i>"])
def test_long_pages_take_linear_time(piece):
    begun = time.monotonic()
    html_text.main_text("<p>Some words here.</p>" + piece * (1_000_000 // len(piece)), {})
    assert time.monotonic() - begun < 20


def test_marks_of_content_are_never_positive():
    counts = {("<article", True): 50, ("</article", True): 50, ("word@p", True): 900, ("word@div", False): 90, ("<p", True): 30, ("<p", False): 1}
    weights = html_text.weights_of(counts)
    assert weights["<article"] <= 0 and weights["<p"] < 0 < weights["word@p"]
