"""Main text of pages: broken and odd HTML, held-out pages of other make, whole test pages against the article's own marks."""

import html
import re

import pyarrow.parquet as pq
import pytest

from ampliflow.llm import main_text

TREE = main_text.train()


def text(page):
    return "\n\n".join(main_text.main_blocks(page, TREE))


PROSE = "The river rose for three days and the people of the lower town carried their chairs upstairs. Nobody spoke of it. "
LONG = PROSE * 4
#: Pages of another make than the labelled ones: furniture, article's blocks, furniture.
HELD_OUT = [
    ('<body><div id="navbar"><a href=/>Home</a> <a href=/a>About us</a></div>', [f"<h1>A flood in spring</h1>", f"<p>{LONG}</p>", "<p>Yes.</p>", f"<p>{PROSE}</p>"], '<div id="sidebar"><p>' + PROSE + '</p></div><footer>Copyright 2020 Example</footer>'),
    ('<header><a href=/>Site</a><p>News for everybody, every day.</p></header><nav><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></nav><main>', [f"<h1>Title here</h1>", f"<p>{LONG}", f"<p>{PROSE}", f"<p>{LONG}</p>"], f'</main><section class="comments"><p>{LONG}</p></section><aside><p>{PROSE}</p></aside>'),
    ('<div class="cookieBanner">We use cookies to make this page better for you and for our partners.</div><article class="post">', ["<h2>Head</h2>", f"<p>{PROSE}</p>", f"<blockquote>{LONG}</blockquote>", f"<ul><li>first of these</li></ul>", f"<p>{LONG}</p>"], f'<form><p>Your name and your address, please</p><input><textarea>x</textarea></form><div class="user-comments"><div><p>{LONG}</p></div></div></article>'),
    ('<div><a href=/1>One</a> | <a href=/2>Two</a> | <a href=/3>Three</a></div>', [f"<p>{LONG}</p>", f"<p>{LONG}</p>", f"<p>{PROSE}</p>"], '<div><a href=/4>Read another story</a> <a href=/5>And one more story</a></div><div>Imprint</div>'),
    ('<div class="advert"><p>' + PROSE + '</p></div><div class="entry-content"><div class="entry-header">', ["<h1>Some title</h1>", f"<p>{LONG}</p>", f"<p>{PROSE}</p>"], f'<div class="share-this">Share</div></div></div><div class="newsletter-box"><p>{PROSE}</p></div>'),
]


@pytest.mark.parametrize("n", range(len(HELD_OUT)))
def test_held_out_pages(n):
    before, article, after = HELD_OUT[n]
    want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in article]
    assert text(before + "".join(article) + after) == "\n\n".join(want)


def test_odd_html():
    assert [b.text for b in main_text.blocks("<p>a&nbsp; &lt;b&gt;\n\t<br>c<p>d<!-- <p>no</p> -->e<b>f</p></b>g")] == ["a <b> c", "def", "g"]
    assert [b.text for b in main_text.blocks("x <3 y & z<script>var a='</p>';</script >tail<style>p{</style>")] == ["x <3 y & ztail"]
    assert [b.text for b in main_text.blocks("<p title=\"a>b\">x<p title='>'>y<a href=\"open>z")] == ["x", "y"]
    assert [b.text for b in main_text.blocks("<p>x<svg><p>no</p><svg/></svg>y<noscript>no</noscript><select><option>no</select>z")] == ["xyz"]
    assert [b.text for b in main_text.blocks("<div>a</span></p></table>b<li>c<li>d</div>e<script>never closed <p>no")] == ["a", "b", "c", "d", "e"]
    assert [b.text for b in main_text.blocks("<P>&#x41;&#66;&amp &am &bogus; &#0;")] == ["AB& &am &bogus; �"]
    assert main_text.blocks("") == [] and main_text.blocks("<") [0].text == "<" and main_text.blocks(" \n<div> </div>") == []
    own = main_text.blocks("<p>one <a href=x>two three</a> four</p>")[0]
    assert (own.words, own.linked) == (4, 2)


def test_long_pages_take_linear_time():
    page = "<article>" + "<p>word <a href='x'>link</a> more" * 60_000 + "<a '" * 2000 + '<x "' * 2001
    assert len(main_text.blocks(page)) == 60_000


def test_the_tree_tells_its_table():
    right = []
    for fragments in main_text.LABELLED:
        page, labels = main_text.labelled_page(fragments)
        share = TREE.predict(main_text.features(main_text.blocks(page)))
        right += [(s >= 0.5) == bool(y) for s, y in zip(share, labels, strict=True)]
    assert sum(right) / len(right) > 0.97
    # Grown without each page in turn, it tells that page's blocks.
    left_out = []
    for n, fragments in enumerate(main_text.LABELLED):
        tree = main_text.train(main_text.LABELLED[:n] + main_text.LABELLED[n + 1 :])
        page, labels = main_text.labelled_page(fragments)
        left_out += [(s >= 0.5) == bool(y) for s, y in zip(tree.predict(main_text.features(main_text.blocks(page))), labels, strict=True)]
    assert sum(left_out) / len(left_out) > 0.85


def article(page):
    """What stands in <article>, by its own marks."""
    inside = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<(?!/?(p|h1)\b)[^>]*(>|\Z)", " ", inside[1])) if inside else []
    return "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in parts) if b)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    want = {r["page_id"]: article(r["html"]) for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()}
    got = {r["page_id"]: r for r in main_text.op12_main_text(spark, folder).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "<nav>a b</nav>", 5), (3, "<nav>a b</nav>", 5)], "page_id long, html string, n_chars int")
    assert [tuple(r) for r in main_text.with_main_text(pages).select("page_id", "text", "n_chars").orderBy("page_id").collect()] == [(1, "", 0), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert main_text.with_main_text(pages.limit(0)).collect() == []
