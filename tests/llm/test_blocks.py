"""The block labeller: parsing, the network, and generated and given pages."""

import html
import re
import time

import numpy as np
import pytest

from loomgraph.llm import blocks as bl
from loomgraph.llm import train_blocks


def texts(page):
    return [b.text for b in bl.parse(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain &amp; text", ["plain & text"]),
        ("<p>a<p>b<b>c</b>d<br>e</p>f", ["a", "bcd e", "f"]),
        ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
        ("<script>var a='</p><p>no';</script><style>x</style>y<!-- c <p> -->z", ["yz"]),
        ("<title>t &lt;</title><textarea><b>raw</textarea>", ["t <", "<b>raw"]),
        ("a < b <3 c", ["a < b <3 c"]),
        ("<p>unclosed <b>bold<div>next", ["unclosed bold", "next"]),
        ("<div title='a > b'>q</div>", ["q"]),
        ("x&nbsp;&nbsp;y&#x41;&bogus;", ["x yA&bogus;"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("</div></p>stray<img src=x>", ["stray"]),
        ("<p>İ<script>x</script>y</p><!-- open", ["İ", "y"]),
        ("cut <a href='", ["cut"]),
        ("<p>&am<b>p;</b> &<i>lt;</i> &am<!-- x -->p;</p>", ["&amp; &lt; &amp;"]),
        ("<svg><path d='m'/><text>in<g/></text></svg>out", ["in", "out"]),
        ("<b><p>x</b>y</p>z", ["xy", "z"]),
    ],
)
def test_parse(page, want):
    assert texts(page) == want


def test_paths_and_links():
    found = bl.parse('<div class="Side Bar" id=n1><a href=x>link</a> more</div><article><p>t</article>u')
    assert [b.path for b in found] == [("div.side.bar#n1", "a"), ("article", "p"), ()]
    assert found[0].links == 4


def test_slash_at_the_end_of_a_tag():
    """A slash that belongs to a value, or to an element of HTML, leaves the element open."""
    assert bl.parse("<a href=/x/>link</a> more")[0].links == 4
    assert bl.parse("<div class=side/>t")[0].path == ("div.side/",)
    assert bl.parse("<div class='side' />t")[0].path == ("div.side",)
    assert bl.parse("<svg><g id=a/><text>t")[0].path == ("svg", "text")


def test_path_vectors():
    """Running sums give the mean over all parts of the path."""
    net = bl.Labeller(train_blocks.initial(3))
    for b in bl.parse("x<div class='a b' id=c><p>t<b>u</b></p><ul><li>v<li class=d><a role=e>w</a></ul></div><textarea>z</textarea>"):
        assert np.allclose(net.path_vector(b.node), net.w["path"][bl.path_buckets(b.path)].mean(axis=0), atol=1e-6)


@pytest.mark.parametrize("piece", ["<div>x ", "<b>x <i>", "<p><b>y</p></b></u>", "<li>x <a '>", "</p>x<td>"])
def test_long_pages_are_linear(piece):
    """Hundreds of thousands of tags that are never closed."""
    page = "<ul>" + piece * (200_000 // piece.count("<"))
    began = time.perf_counter()
    net = bl.Labeller.load()
    blocks = bl.parse(page)
    assert len(net.vectors(blocks)) == len(blocks)
    assert time.perf_counter() - began < 20


def test_network_in_plain_steps():
    """The batched network against one block at a time."""
    r = np.random.default_rng(1)
    w = train_blocks.initial(3)
    pages = [r.normal(size=(n, 2 * bl.WIDTH + bl.NUMBERS)).astype(np.float32) for n in (1, 5, 9)] + [np.zeros((0, 2 * bl.WIDTH + bl.NUMBERS), np.float32)]
    s = lambda x: 1 / (1 + np.exp(-x))

    def lstm(x, d):
        h, c, out = np.zeros(bl.HIDDEN), np.zeros(bl.HIDDEN), []
        for v in x:
            i, f, o, g = np.split(v @ w[f"w{d}"] + h @ w[f"u{d}"] + w[f"b{d}"], 4)
            c = s(f) * c + s(i) * np.tanh(g)
            h = s(o) * np.tanh(c)
            out.append(h)
        return np.array(out)

    for x, got in zip(pages, bl.Labeller(w).chances(pages)):
        want = s(np.concatenate([lstm(x, "f"), lstm(x[::-1], "b")[::-1], x], axis=1) @ w["v"] + w["c"])[:, 0] if len(x) else np.zeros(0)
        assert np.allclose(got, want, atol=1e-5)


def test_gradients():
    """Back-propagation against finite differences."""
    r = np.random.default_rng(2)
    size, h = 5, bl.HIDDEN
    x, mask = r.normal(size=(4, 3, size)), np.array([[1, 1, 1], [1, 1, 1], [1, 0, 1], [0, 0, 1]], bool)
    w, u, b = r.normal(size=(size, 4 * h)), r.normal(size=(h, 4 * h)) * 0.3, r.normal(size=4 * h)
    pull = r.normal(size=(4, 3, h))
    kept = []
    bl.run_lstm(x, mask, w, u, b, kept)
    grads = train_blocks.back_lstm(x, mask, w, u, kept, pull)
    loss = lambda: (bl.run_lstm(x, mask, w, u, b) * pull).sum()
    for array, grad in zip((w, u, b, x), grads):
        for _ in range(5):
            at = tuple(r.integers(n) for n in array.shape)
            array[at] += 1e-5
            up = loss()
            array[at] -= 2e-5
            down = loss()
            array[at] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(grad[at], rel=1e-3, abs=1e-6)


def test_held_out_pages():
    blocks, pages = train_blocks.score(bl.Labeller.load().w, 1234, 300)
    assert blocks >= 0.99
    assert pages >= 0.9


def test_given_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in bl.main_text(table, ["page_id", "url"]).collect()}
    for r in table.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        inner = re.sub(r"<[^>]+>", " ", re.sub(r"</?(?:b|i|em|strong|a)(?: [^>]*)?>", "", inner))
        assert got[r["page_id"]]["text"] == " ".join(html.unescape(inner).split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_odd_pages(spark):
    long = "<article><h1>T</h1>" + "<p>some words of a long text, and more.</p>" * 3000 + "</article><footer>&copy; x</footer>"
    rows = [(1, None, "u"), (2, "", None), (3, "<nav><a href=/>home</a></nav>", "u"), (4, long, "u"), (4, long, "u"), (None, "<p>", "u")]
    table = spark.createDataFrame([(*r, "clash") for r in [(a, c, b) for a, b, c in rows]], "page_id long, url string, html string, text string")
    got = bl.main_text(table, ["page_id", "url"]).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 6
    assert (by[1]["text"], by[2]["text"], by[None]["text"]) == ("", "", "")
    assert by[4]["text"] == "T " + " ".join(["some words of a long text, and more."] * 3000)
    assert bl.main_text(table.limit(0), ["page_id", "url"]).count() == 0
