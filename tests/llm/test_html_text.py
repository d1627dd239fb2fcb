"""Blocks of HTML, and the labeller on pages and layouts that it has not seen."""

import html
import random
import re

import numpy as np
import pytest
from pulselake.llm import html_text, queries
from pulselake.llm.html_blocks import blocks_of, dressed, marked_main

SF = "/root/testdata/sf0.01"


def article(page):
    """The article of the tables' pages, which all have their text in it."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = [re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x)) for x in re.split(r"</?(?:p|h1|ul|li)[^>]*>", inside)]
    return "\n".join(t for x in parts if (t := " ".join(html.unescape(x).split())))


def test_pages_of_the_table(spark):
    pages = queries.table(spark, SF, "pages")
    got = {r.page_id: r for r in queries.op13_html_text(spark, SF).collect()}
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    assert got.keys() == want.keys() and all(r.url == want[i][0] and r.n_chars == len(r.text) for i, r in got.items())
    assert np.mean([r.text == want[i][1] for i, r in got.items()]) > 0.99


@pytest.fixture(scope="module")
def learned(spark):
    pages = queries.table(spark, SF, "pages")
    return html_text.Labeller(html_text.fit(html_text.training_sample(pages.where("page_id % 2 = 0")))), [r.html for r in pages.where("page_id % 2 = 1").collect()]


def test_held_out_pages_in_other_dress(learned):
    labeller, pages = learned
    rng, right, all_blocks, whole = random.Random(77), 0, 0, 0
    for page in pages:
        blocks = blocks_of(page)
        main, other = [b.text for b in blocks if marked_main(b)], [b.text for b in blocks if not marked_main(b)]
        text, labels = dressed(main[:24], other, rng)
        assert len(blocks_of(text)) == len(labels)
        (got,) = labeller.labels([blocks_of(text)])
        right, all_blocks, whole = right + (got == labels).sum(), all_blocks + len(labels), whole + (got == labels).all()
    assert right / all_blocks > 0.97 and whole / len(pages) > 0.75


def test_layouts_written_by_hand(learned):
    labeller, _ = learned
    paragraphs = ["The first paragraph of the article says what it is about.", "A second one, with <b>bold</b> words &amp; a <a href='/x'>link</a> inside it.", "Short."]
    want = "A headline\nThe first paragraph of the article says what it is about.\nA second one, with bold words & a link inside it.\nShort."
    body = "<h1>A headline</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    comments = "<div class='comments'><h3>2 comments</h3><div class='comment'><p>I do not agree with the article at all.</p></div></div>"
    side, foot = "<aside><h3>Related</h3><ul><li><a href='/1'>One more story</a></li></ul></aside>", "<footer><p>&copy; 2024 Example</p></footer>"
    menu, notice = "<nav><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul></nav>", "<div class='cookie-notice'><p>We use cookies to improve this site.</p></div>"
    pages = [
        f"<html><head><title>x</title></head><body>{notice}<header><p>The Daily</p>{menu}</header><main>{body}</main>{side}{comments}{foot}</body></html>",
        f"<body>{menu}<div class='post-content'>{body}<div class='ad'>Buy now.</div></div>{comments}{foot}",
        f"<body><div id='header'>{menu}</div><article>{body}</article><form class='newsletter'><p><label>Your e-mail</label><input></p></form>{foot}",
    ]
    assert labeller.texts(pages) == [want] * 3


def test_blocks():
    page = "<head><title>no</title></head><body>a&nbsp;&lt;b&gt;\n c<p>d<p>e <b>f</b><br>g<ul><li>h<li>i</ul>j<script>k('</p>')</script><style>l</style><!-- m --><select><option>n</select><div>o</p>p<table><tr><td>q<td>r</table>"
    assert [b.text for b in blocks_of(page)] == ["a <b> c", "d", "e f g", "h", "i", "j", "o", "p", "q", "r"]
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> </p>&nbsp;") == []
    assert [b.path for b in blocks_of("<div id=mainMenu class='a-b c'>x")] == [(("div", "main", "menu", "a", "b", "c"),)]
    assert [(b.text, b.linked) for b in blocks_of("<li><a href=x>one two</a> <li>three")] == [("one two", 7), ("three", 0)]


def test_edges(spark):
    long = "<body><article>" + "<p>many words of one text</p>" * 30_000 + "</article>"
    rows = [(0, "u", None), (1, None, ""), (2, "v", "plain text without a tag"), (3, "w", "<p>a<"), (3, "w", "<p>a<"), (None, "x", "<article><p>text of an article here</p></article>"), (4, "y", long), (5, "z", "<![CDATA[ x ]]> &#0; &#xD800; &bogus; </div></div>")]
    d = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = html_text.extract(d).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url): r.text for r in got}
    assert by[0, "u"] == by[1, None] == "" and by[4, "y"].count("\n") == 29_999
    assert html_text.extract(d.limit(0)).count() == 0
    assert html_text.extract(d.where("page_id < 2")).where("text = ''").count() == 2


def test_same_pages_make_the_same_network():
    rng = np.random.default_rng(0)
    sample = [(rng.random((n, html_text.WIDTH)).astype(np.float32), (rng.random(n) < 0.5).astype(np.float32)) for n in (3, 9, 4)]
    assert all(np.array_equal(a, b) for a, b in zip(html_text.fit(sample).flat(), html_text.fit(sample).flat(), strict=True))
