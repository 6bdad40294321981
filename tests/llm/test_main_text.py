"""Main text of pages: held-out templates, odd pages, and the Spark job against the plain reading of the tree."""

import html
import re
import time

import pytest

from noteloom.llm import main_text as m

NAMES = ("text", "words", "links", "heading", "inside", "outside", "body")
DIR = "/root/testdata/sf0.001"


def plain(page):
    found = [dict(zip(NAMES, b, strict=True)) for b in m.blocks_of(page or "")]
    kept = [b["text"] for i, b in enumerate(found) if m.trained().keeps(m.features(b, found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None))]
    return "\n".join(kept)


#: Templates of which the labelled table has none, in its form.
HELD_OUT = (
    """
- <!doctype html><html lang=de><head><title>x</title><meta name="a" content="b"></head><body id="top"><div class="skip-link">
0 <a href="#c">{3}</a></div>
0 <div class="top-banner-ad">{12.}</div>
- <header class="site-header"><nav>
0 <a href="/1">{1}</a></nav></header><main id="c"><section class="story">
1 <h1>{9}</h1>
1 <p>{33.}</p>
0 <figure><div class="advertisement">{7.}</div></figure>
1 <p>{1}</p>
1 <ol><li>{12.}
1 <li>{3}</ol>
1 <p>{70.}
1 <p>{2.}</p>
- </section></main>
0 <div id="disqus_thread" class="comments-area"><p>{44.}</p></div>
0 <div class="cookieConsent"><p>{24.}</p></div>
0 <footer class="site-footer"><p>{10.}</p></footer>
""",
    """
- <body class="no-js sidebar-right"><div id="page"><div class="site-navigation">
0 <ul><li><a href=/x>{2}</a></li></ul></div><article id="post-17">
1 <h2>{4}</h2>
0 <p class="byline">{4}</p>
1 <p>{15.}</p>
1 <dl><dt>{1}<dd>
- </dd></dl>
1 <p>{55.}</p>
0 <div class="social-share">{2}</div>
- </article></div>
0 <aside><form><p>{5}</p></form></aside>
""",
    """
- <body>
0 <div><a href="/1">{1}</a> <a href="/2">{1}</a></div>
1 <p>{28.}</p>
1 <p>{52.}</p>
1 <p>{21.}</p>
0 <div><a href="/3">{3}</a></div>
""",
)


@pytest.mark.parametrize("lines", HELD_OUT)
def test_held_out(lines):
    page, labels = m.sketch(lines)
    found = [dict(zip(NAMES, b, strict=True)) for b in m.blocks_of(page)]
    assert len(found) == len(labels)
    got = [int(m.trained().keeps(m.features(b, found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None))) for i, b in enumerate(found)]
    assert got == labels


def test_labelled_table_is_learned():
    rows, labels = m.labelled_rows()
    assert [m.trained().keeps(dict(zip(m.FEATURES, r, strict=True))) for r in rows] == [bool(x) for x in labels]


CASES = {
    "": "", "no tags at all but quite a few words here.": "no tags at all but quite a few words here.",
    "<article><p>a &amp; b &lt;c&gt; &#8364; &eacute; &am x&nbsp;y</p></article>": "a & b <c> € é &am x y",
    "<article><p>one<br>two\n\t three</p><p>four</article>": "one two three\nfour",
    "<article><p>1 < 2 and <b>bold<p>next</b></article>": "1 < 2 and bold\nnext",
    '<article><p>a<script>var t="</p>";</script>b<!-- <p>no</p> -->c</p><svg/><p>d</p></article>': "abc\nd",
    "<article><p>kept</p><script>never closed <p>gone": "kept",
    '<article><p>kept</p><a href="never closed>gone': "kept",
    "<nav><p>a b</p></nav></div></p></b><article><p>kept</p></article>": "kept",
    "<article><table><tr><td>x<td>y<tr><td>z</table></article>": "x\ny\nz",
    "<p hidden>no</p><article><p>yes</p></article>": "yes",
}


@pytest.mark.parametrize("page", CASES)
def test_pages(page):
    assert plain(page) == CASES[page]


@pytest.mark.parametrize("part", ["<div>", "<a ", "<p>x", "</div>", "<!--", "<script>", "<b>", '"', "<a href='", "<li>x", "<h1>", "</b>", "<td>", "<span class=x>y</b>"])
def test_linear(part):
    began = time.time()
    m.blocks_of(part * (400_000 // len(part)))
    assert time.time() - began < 20


def test_spark(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url", "html")
    odd = [None, "", *CASES, *(m.sketch(s)[0] for s in HELD_OUT), "<article>" + "<p>long text.</p>" * 20_000 + "</article>"]
    rows = [(i, None if i % 2 else f"u{i}", h) for i, h in enumerate(odd)]
    df = pages.unionByName(spark.createDataFrame([*rows, rows[3], (None, None, odd[5])], "page_id long, url string, html string"))
    wanted = sorted(((r.page_id, r.url, plain(r.html)) for r in df.collect()), key=repr)
    found = m.extract_main_text(df.withColumnsRenamed({}).selectExpr("*", "1 as blocks", "'x' as text", "2 as n_chars")).collect()
    assert sorted(((r.page_id, r.url, r.text) for r in found), key=repr) == wanted
    assert all(r.n_chars == len(r.text) for r in found)
    assert m.extract_main_text(df.limit(0)).count() == 0


def test_articles_of_the_table(spark):
    for r in m.extract_main_text(spark.read.parquet(f"{DIR}/pages.parquet")).join(spark.read.parquet(f"{DIR}/pages.parquet"), "page_id").collect():
        article = re.search("(?s)<article>(.*?)</article>", r.html)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p)
