"""Main text of pages: the parser and the decoder by themselves, held-out layouts, the given pages against their own article element, and edge cases."""

import html
import itertools
import re

import duckdb
import numpy as np
import pytest

from tapelab.llm import htmltext as ht
from tapelab.llm import queries

SF = "/root/testdata/sf0.01"
PROSE = "This is a paragraph of the story, and it has some words in it, enough to look like prose. It goes on for a second sentence, number {}."


@pytest.fixture(scope="module")
def pages():
    return duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()


@pytest.fixture(scope="module")
def words(spark):
    return ht.sample_words(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.fixture(scope="module")
def model(words):
    return ht.fit(words)


def plain(page):
    """The blocks of the one article element of a page of the given tables, by patterns."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)[^>]*>", inner)
    return "\n\n".join(y for y in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in blocks) if y)


def test_given_pages(spark, pages):
    rows = queries.op12_html_text(spark, SF).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(got) == len(pages)
    for i, url, page in pages:
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, plain(page), len(plain(page)))


def test_held_out_layouts(words, model):
    laid = ht.training_pages(words, 150, seed=11)
    texts = ht.extract([p for p, _ in laid], model)
    found = missed = extra = 0
    for (_, truth), text in zip(laid, texts):
        a, b = set(text.split("\n\n")) - {""}, set(truth)
        found, missed, extra = found + sum(map(len, a & b)), missed + sum(map(len, b - a)), extra + sum(map(len, a - b))
    assert found >= 0.97 * (found + missed) and found >= 0.97 * (found + extra)


def blocks(page):
    return [t for t in ht.parse(page).text if t]


def test_parser():
    assert blocks("<p>one<p>two <b>three<br>four</p>five") == ["one", "two three four", "five"]
    assert blocks("a &amp; b&nbsp; c &lt;p&gt; &eacute; &#65;&amp") == ["a & b c <p> é A&"]
    assert blocks("<script>if (a < b) '</p>';</script>x<style>p{}</style><!-- <p>no</p> -->y<!doctype html>z") == ["xyz"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert blocks("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert blocks("1 < 2 and <3 <a href='>'>x</a>") == ["1 < 2 and <3 x"]
    assert blocks("<head><title>no</title><body>yes") == ["yes"] == blocks("<head><title>no</title></head>yes<script>never ends")
    assert blocks('<p class="a>b<p>c</p>') == ["b", "c"]  # a quote that is never closed
    assert blocks("") == blocks("<") == blocks("<p") == blocks("<!-- x") == [] or blocks("<") == ["<"]
    assert blocks("<svg><text>no</text></svg><select><option>no</select><noscript><p>no</p></noscript>yes</div></p>") == ["yes"]
    many = "<div>" * 3000 + "deep" + "<a x='" * 3000
    assert blocks(many) == ["deep"]


def test_decoder_finds_the_likeliest_consistent_labelling():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 9
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        p = rng.uniform(0.01, 0.99, n)
        value = lambda k: sum(np.log(p[i] if k[i] else 1 - p[i]) for i in range(n))  # noqa: E731, B023
        legal = [k for k in itertools.product([False, True], repeat=n) if all(not k[i] or k[parent[i]] for i in range(1, n))]
        kept = tuple(ht.decode(p, parent, depth).tolist())
        assert kept in legal and abs(value(kept) - max(map(value, legal))) < 1e-9


def test_kinds_of_boilerplate(model):
    p = [f"<p>{PROSE.format(i)}</p>" for i in range(5)]
    page = (
        '<html><head><title>T</title></head><body><header><a href="/">Paper</a></header><nav><ul><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>'
        f'<main><article><h1>A title of some words</h1>{p[0]}<div class="ad">Buy this now.</div>{p[1]}<form><label>Mail</label><input></form>{p[2]}</article><section id="comments"><div class="comment">{p[3]}</div></section></main>'
        f'<aside class="sidebar"><h3>Most read</h3>{p[4]}</aside><footer>&copy; Paper</footer></body></html>'
    )
    assert ht.extract([page], model) == ["\n\n".join(["A title of some words", *(PROSE.format(i) for i in range(3))])]


def test_edges(spark, model):
    long = "<article>" + "".join(f"<p>{PROSE.format(i)}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None, 0), (2, None, "", 0), (3, "u", "<nav><a href=x>a</a></nav>", 0), (4, "u", long, 0), (None, "u", "<article><p>Short one.</p></article>", 0), (None, "u", "<article><p>Short one.</p></article>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(2)
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in ht.extract_pages(df, model).collect()), key=str)
    assert len(got) == 6
    by = {r[0]: r for r in got}
    assert by[1] == (1, "u", "", 0) and by[2] == (2, None, "", 0) and by[3][2] == ""
    assert by[4][2] == "\n\n".join(PROSE.format(i) for i in range(20_000)) and by[4][3] == len(by[4][2])
    assert [r for r in got if r[0] is None] == [(None, "u", "Short one.", 10)] * 2
    none = df.limit(0)
    assert ht.extract_pages(none, ht.fit(ht.sample_words(none), 20)).collect() == []
