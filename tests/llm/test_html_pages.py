"""Pages whose wrappers, forms and depth must not cost the article."""
import time

import pytest

CASES = [
    ('<div class="layout with-sidebar"><div><p>An article.</p></div><div class=sidebar>s</div></div>', "An article."),
    ('<div id=page class="menu-open"><p>Text</p></div>', "Text"),
    ('<div data-a="is hidden here"><p>Text</p></div><div hidden><p>no</p></div><p hidden="">no</p>', "Text"),
    ("<body><form action=x><nav>n</nav><p>Long page text</p><label>l</label><div class=sidebar>s</div></form></body>", "Long page text"),
    ("<form><h1>T</h1><p>body</p></form><p>more</p><form><p>subscribe here</p></form>", "T\nbody\nmore"),
    ("<p>see <label>inline</label> and <button>b</button> end</p>", "see and end"),
    ("<p>where <math><mi>x</mi></math> is</p>", "where x is"),
    ("<header>site</header><article><header><h1>Title</h1></header><p>x</p><footer>f</footer></article>", "Title\nx"),
    ("<div class=ad><p>page in a wrapper</p><div class=comments>c</div></div>", "page in a wrapper"),
    ("<form><div class=menu><p>deep</p></div></form>", "deep"),
    ("<p>article</p><div class=comments><p>a much longer comment than the article itself</p></div>", "article"),
    ("<div class='w-1/2 x'><p>a</p></div><div class='w-1/2 x'><p>b</p></div>", "a\nb"),
    ("", ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_page(page, text):
    from aspectra.llm.html_consensus import Page
    assert Page(page).extract(None) == text
    best = Page(page).best()
    assert best is None or Page(page).extract(best[0]) == text


def test_cost_grows_with_the_page():
    from aspectra.llm.html_consensus import Page
    for page, text in (("<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000, "deep"), ("<b>" * 20_000 + "<div>deep</div></x>" * 300, "\n".join(["deep"] * 300)),
                       ("<div class=ad>" * 20_000 + "<p>deep</p>", "deep"), ("<p>" + "word " * 400_000, ("word " * 400_000).strip())):
        start = time.time()
        assert Page(page).extract(None) == text
        assert time.time() - start < 20


def test_clashing_columns_ties_and_repeats(spark):
    from aspectra.llm.html_consensus import main_texts
    rows = [(1, "http://a.org/1", "<div class=x><p>one two</p></div>", "n", "m"), (1, "http://a.org/1", "<div class=x><p>one two</p></div>", "n", "m"),
            (2, "http://a.org/2", "<div class=y><p>one two</p></div>", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string").repartition(2)
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["path"]) for r in main_texts(df).collect())
    assert got == [(0, "", 0, None), (1, "one two", 7, "div.x"), (1, "one two", 7, "div.x"), (2, "one two", 7, "div.x")]
    assert main_texts(df.limit(0)).count() == 0
