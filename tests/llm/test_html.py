"""Main text of pages: against the article that whole pages hold, odd markup, long pages, and minimum cuts by brute force."""

import html
import re
import time

import numpy as np
import pytest

from glossweave.llm import html_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def weights():
    return html_text.train()


def article(page):
    """The text of a page's one article of headings and paragraphs."""
    body = re.sub(r"<!--.*?-->", "", re.findall(r"<article\b[^>]*>(.*?)</article>", page, re.S)[0], flags=re.S)
    parts = re.split(r"</?(?:h1|h2|p)\b[^>]*>", re.sub(r"<br\b[^>]*>", " ", body))
    return "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts)))


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id].url, article(rows[r.page_id].html), len(r.text))


def test_odd_rows(spark):
    page = "<article><h1>A title of some words.</h1><p>The text of it, which is long enough.</p></article>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (4, "w", " \n"), (5, "x", page + "<footer>" + "<a href=/>x</a> " * 30000 + "</footer>")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    text = "A title of some words.\nThe text of it, which is long enough."
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(0, "v", "", 0), (1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (4, "w", "", 0), (5, "x", text, len(text))]
    assert html_text.extract(df.limit(0)).count() == 0


def test_markup(weights):
    read = lambda x: html_text.main_text(x, weights)
    page = '<body><header><a href=/>Site</a></header><div class="post-content"><h1>Title &amp; more</h1><p>First&nbsp;para   with a <a href=x>link</a>, and text that goes on.<p>Second one, longer than the first one is.</div><div class="comments"><p>Great post, thank you so much for it.</p></div><footer>c 2020</footer>'
    assert read(page) == "Title & more\nFirst para with a link, and text that goes on.\nSecond one, longer than the first one is."
    assert read("") == "" and "a < b" in read("<<p>a < b & c")
    words = "Some words that are long enough to be kept as text."
    for a in ('title="the hidden truth"', "class=x data-style='display:none'", "title='a > b'", "title = \"<b>\"", "a b=c", "title=it's"):
        assert read(f"<article><p {a}>{words}</p></article>") == words, a
    for a in ("hidden", 'hidden=""', 'style="color:red; display : none"', "aria-hidden=true", "style='visibility:hidden'"):
        assert read(f"<article><p>{words}</p><p {a}>Gone from here, as it is not shown.</p></article>") == words, a
    assert read('<p title="it>hello world') == "hello world"
    article = f"<article><p>{words}</p></article>"
    for a in ("document.write(\"<a title='\");", "if (a<!--b) x();", "a = '</p><div>' + \"</scripts>\";", "x = `<script`", "<!-- hidden\n//", 'if (a < b && c > "d") {}', "'<title>'"):
        for tag in ("script", "SCRIPT type='x'", "style", "textarea", "iframe"):
            end = tag.split()[0].lower()
            assert read(f"<{tag}>{a}</{end} >{article}") == words, (tag, a)
            assert read(f"<html><head><{tag}>{a}</{end}></head><body><div class=post><p>{words}<{tag}>{a}</{end}></div>") == words, (tag, a)
    assert read(f"<title>a <!-- b</title>{article}") == read(f"<!-->{article}") == read(f"<!--->{article}") == read(f"<!-- a > b --!>{article}") == read(f"<script src=x />{article}") == words
    assert read(f"{article}<script>never closed <p>{words}") == words
    assert read("<article><script>var t='</p>';</script><style>p{}</style><p>" + words + "<!-- <p>no --></p></article>") == words


@pytest.mark.parametrize(
    ("page", "most"),
    [("<p>Some words that are long enough to be kept.</p>" * 20000, 2), ('<p title="x' * 8000, 0.5), ("<p title=\"x>y '" * 8001, 0.5), ("<!x " * 8000, 0.5), ("<b>x" * 8000 + "</i>" * 8000, 0.5), ("<div>x<p>" * 8000, 0.5), ("<script>" * 8000, 0.5), ("<a x='" + " q\"" * 8001, 0.5)],
)
def test_cost_is_in_proportion(weights, page, most):
    began = time.process_time()
    html_text.main_text(f"<article>{page}", weights)
    assert time.process_time() - began < 2 * most


def test_min_cut_is_minimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = 7
        gain = rng.normal(0, 2, n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda s: sum(max(0, g) for g, k in zip(gain, s) if not k) + sum(max(0, -g) for g, k in zip(gain, s) if k) + sum(c for a, b, c in edges if s[a] != s[b])  # noqa: B023, E731, B905
        assert abs(cost(html_text.min_cut(gain, edges)) - min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))) < 1e-6
