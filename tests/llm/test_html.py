"""Whole tables against a plain cut of their one layout; long pages; a model that does not hang on the order of rows."""

import html
import re

import pytest

from docspark.llm import html_extract


def plain(page):
    """The article of the given pages: what stands between its tags, one line a heading or paragraph."""
    body = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:h1|h2|h3|p|ul|li|div)>", re.sub(r"<br>|</?b>", " ", body[1])) if body else []
    return "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_equals_plain_cut(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert got.keys() == want.keys()
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)


def test_long_pages_and_null_ids(spark):
    words = "Some sentence of an article that goes on for a while and ends here."
    long = "<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title of it</h1>" + f"<p>{words}</p>" * 20_000 + "</article><footer>&copy; me</footer>"
    one = "<article><h1>Title of it</h1><p>" + words * 20_000 + "</p></article>"
    rows = [(1, "a", long), (None, "b", one), (2, "c", "x" * 1_000_000), (2, "c", "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {(r.page_id, r.url): r for r in html_extract.extract(df, train_pages=400).collect()}
    lines = got[1, "a"].text.split("\n")
    assert lines.count(words) == 20_000 and "Home" not in lines
    assert len(got[None, "b"].text) > len(words) * 20_000 - 1
    assert got[2, "c"].n_blocks == 1


def test_model_does_not_hang_on_the_order_of_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    a, b = (html_extract.fit_on(p, 20, 40).w for p in (pages.repartition(3), pages.repartition(5, "html").union(pages.limit(3))))
    assert all((a[k] == b[k]).all() for k in a)


SENTENCE = "The committee met on Tuesday and agreed that the old bridge should be repaired before the winter comes."
#: Pages written by hand, unlike each other and unlike the given ones, each with its article.
UNLIKE = [
    (f"<p>{SENTENCE}</p>", SENTENCE),
    (SENTENCE, SENTENCE),
    (f"<html><body><h1>The bridge</h1><p>{SENTENCE}</p><p>{SENTENCE} Twice.</p></body></html>", f"The bridge\n{SENTENCE}\n{SENTENCE} Twice."),
    (f"<body><header><h1>Daily Courier</h1></header><main><h1>The bridge</h1><p>{SENTENCE}</p></main><footer>&copy; 2024 Daily Courier</footer></body>", f"The bridge\n{SENTENCE}"),
    (f'<body><table><tr><td><a href="/">Home</a><br><a href="/n">News</a><br><a href="/c">Contact</a></td><td><h1>The bridge</h1><p>{SENTENCE}</p><p>{SENTENCE}</p></td></tr></table></body>', f"The bridge\n{SENTENCE}\n{SENTENCE}"),
    (f'<body><div id="cookie-banner"><p>This site uses cookies.</p></div><div class="post"><h2>The bridge</h2><p>{SENTENCE}</p></div><div class="sidebar"><h3>Popular</h3><ul><li><a href="/a">Another story</a></li></ul></div><div class="comments"><p>I walk there each day, and it is about time.</p></div></body>', f"The bridge\n{SENTENCE}"),
]


def test_pages_of_unlike_layout(spark):
    """Trained on the given pages, the labeller gets pages written by hand right too."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    own = spark.createDataFrame([(-1 - k, "u", page) for k, (page, _) in enumerate(UNLIKE)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(given.union(own)).where("page_id < 0").collect()}
    wrong = {k: got[-1 - k] for k, (_, text) in enumerate(UNLIKE) if got[-1 - k] != text}
    assert not wrong, wrong
