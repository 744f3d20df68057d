"""op11: blocks and gradients by hand, and the labeller on made pages it has not seen and on the table's pages."""

import html
import os
import re

import numpy as np
import pytest

from eventloom.llm import extraction, queries
from eventloom.llm.common import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def texts(page):
    return [b.text for b in extraction.blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []),
        ("", []),
        ("no markup\n at   all", ["no markup at all"]),
        ("<p>one<p>two<b>bold</b> three</p>four", ["one", "twobold three", "four"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("x<script>var a='<p>no</p>';</script>y<style>p{}</style>z", ["xyz"]),
        ("<p>a<!-- <p>no --> b<br>c</p>", ["a b c"]),
        ("&lt;p&gt; &amp;amp; &#233;&nbsp;x &copy;", ["<p> &amp; é x ©"]),
        ('<p title="a > b" class=x>in</p>', ["in"]),
        ("<p data-x='unclosed>text</p>", ["text"]),
        ("1 < 2 and 3 > 2 <3", ["1 < 2 and 3 > 2 <3"]),
        ("<p>a</p><p hidden>b</p><p style='display: none'>c</p><noscript>d</noscript><p>e", ["a", "e"]),
        ("<title>t</title><body>x", ["x"]),
        ("<p>end<a href=", ["end"]),
        ("<b><p>one</b>two</p>", ["onetwo"]),
        ("</p></div>loose<div", ["loose"]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "after", ["deep", "after"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    nav, text = extraction.blocks('<nav class="mainMenu top"><a href=x>all link</a></nav><article>some <a>link</a></article>')
    token = lambda x: extraction._tokens(x, "")[0][0]
    assert nav.linked == 1 and 0 < text.linked < 1 and token("nav") in nav.path and token(".menu") in nav.own and token("article") in text.own and token("nav") not in text.path


def test_gradients_are_those_of_the_loss():
    model = extraction.Labeller(3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    pages = [p for p in extraction.made_pages(12, 5) if len(p[0])][:4]
    f = extraction.Features([b for found, _ in pages for b in found])
    lengths, want = np.array([len(found) for found, _ in pages]), np.array([y for _, labels in pages for y in labels], float)
    _, g = model.gradients(f, lengths, want)
    rnd = np.random.default_rng(0)
    for name, w in model.w.items():
        at = tuple(rnd.integers(0, s) for s in w.shape) if name not in ("path", "own", "word") else (int(getattr(f, name)[3]), 2)
        old, losses = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = old + step
            losses.append(model.gradients(f, lengths, want)[0])
        w[at] = old
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(float(g[name][at]), rel=2e-2, abs=1e-5), name


def test_pages_side_by_side_score_as_alone():
    model = extraction.Labeller(1)
    pages = [found for found, _ in extraction.made_pages(9, 2)] + [[]]
    together = model.score(extraction.Features([b for p in pages for b in p]), np.array(list(map(len, pages))))
    alone = [model.score(extraction.Features(p), np.array([len(p)])) for p in pages]
    assert np.allclose(together, np.concatenate(alone), atol=1e-5)


def test_accuracy_on_pages_it_has_not_seen():
    held = extraction.made_pages(150, 777)
    score = extraction.trained().score(extraction.Features([b for p, _ in held for b in p]), np.array([len(p) for p, _ in held]))
    assert ((score >= 0.5) == np.array([y for _, labels in held for y in labels])).mean() > 0.985


UNSEEN = """<!doctype html><html><head><title>T</title></head><body class="page"><div id="cookie-consent" class="banner"><p>We use cookies to improve things.</p><button>OK</button></div>
<header class="site-header"><a href="/">The Site</a><nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav></header>
<div class="layout"><main id="content"><article class="post"><h1>A long day at the harbour</h1><p>The first boat came in at dawn, and with it the <a href="/w">weather</a>.</p><h2>Noon</h2><p>Short.</p><div class="ad">Buy now!</div>
<ul><li>Nets</li><li>Rope &amp; tar</li></ul><blockquote><p>It was ever so.</p></blockquote><p>Then all went home, tired and glad that nothing had been lost.</p></article>
<section id="comments" class="comments"><h3>3 comments</h3><div class="comment"><p>What a lovely piece, I remember the harbour well from my youth.</p></div><form><label>Your comment</label><textarea></textarea></form></section></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Another story entirely</a></li></ul></aside></div><footer><p>&copy; 2024 The Site. All rights reserved.</p></footer></body></html>"""


def test_a_page_written_by_hand(spark):
    rows = [(1, "u", UNSEEN, "x"), (2, None, None, "x"), (None, "v", "", "y"), (2, None, None, "x"), (3, "w", "<p>", "z")]
    got = sorted(map(tuple, extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()), key=repr)
    main = "A long day at the harbour\nThe first boat came in at dawn, and with it the weather.\nNoon\nShort.\nNets\nRope & tar\nIt was ever so.\nThen all went home, tired and glad that nothing had been lost."
    assert got == sorted([(1, "u", main, len(main)), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0)], key=repr)
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_the_table_s_pages_are_extracted_whole(spark):
    """All of these pages' articles, by a plain pattern that holds for this table alone."""

    def plainly(page):
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", article))
        return "\n".join(x for x in parts if x)

    want = {r.page_id: plainly(r.html) for r in table(spark, DATA, "pages").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op11_extraction(spark, DATA).collect()}
    assert got.keys() == want.keys() and all(n == len(t) for t, n in got.values())
    assert sum(got[k][0] == want[k] for k in want) >= 0.99 * len(want)
