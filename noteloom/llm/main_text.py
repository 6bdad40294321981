"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at its block-level tags into flat blocks; a block's white space becomes one space, character references
are decoded. Of each block are known: its words, the share of them in links, both of the blocks before and after it, whether it
is a heading or ends a sentence, and how many of the elements around it are, by their name, role or class, of a kind that
holds no article (inside and outside the innermost article). A tree trained on the labelled table below tells the blocks of
the main text, which are joined by line ends. Scripts, styles, comments, markup and what forms offer to choose are no text.

Python cuts a page into blocks; neighbours, the tree and the joining are SQL functions, so that no row leaves its task.
Null, empty and textless pages give ''. Repeated rows and ids are extracted each; an empty table gives an empty result; further
columns are not looked at. A page is read whole, in time linear in its length: an unclosed tag, quote, script or comment ends with the page, as in
browsers; end tags of elements that are not open are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table, text_blocks

#: Names of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = "script|style|title|textarea|template|svg|iframe|noembed|noframes|select|math|object|canvas|audio|video"
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end when another of their kind, or of the kinds given, begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
#: Elements beyond which none of those above is looked for.
WALLS = frozenset("table ul ol dl div article section main body html aside nav".split())
#: Elements, roles and words of classes that hold no article, and those that hold one.
OTHER_TAGS = frozenset("nav header footer aside form menu button noscript dialog fieldset address".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OTHER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense dfp sponsor sponsored sponsors promo promotion promoted teaser banner billboard leaderboard
    nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager header masthead topbar footer bottombar colophon copyright legal sidebar sidenav rail aside
    widget widgets toolbar skip cookie cookies consent gdpr notice notices alert popup modal overlay dialog comment comments commentlist disqus reply replies respond responses discussion
    share sharing social follow related recommended recommendations trending popular newsletter subscribe subscription signup signin login register search form paywall tags byline meta""".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article articlebody content main maincontent post postbody entry story storybody".split())
#: Words before another that say how a page is laid out, not what the element is.
LAYOUT_WORDS = frozenset("has no with without is".split())

TOKEN = re.compile(
    rf"""(?s)<!--.*?(?:-->|\Z)|<(?P<raw>(?i:{RAW}))(?=[\s/>])(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^'">])*+(?<!/)>.*?(?:</(?i:(?P=raw))(?=[\s/>])[^>]*(?:>|\Z)|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^'">])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)"""
)
ATTRIBUTE = re.compile(r"""(?s)([^\s"'=/<>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Numbers known of each block, in the order of the tree's features.
FEATURES = ("body", "inside", "outside", "density", "words", "before_words", "after_words", "before_density", "after_density", "heading", "sentence")
BLOCKS = "array<struct<text: string, words: int, links: int, heading: int, inside: int, outside: int, body: int>>"


def _kind(name: str, attributes: str) -> int:
    """1: holds an article, -1: holds none, -2: surely none (by its element, role or whole class), 0: neither."""
    if name in ("html", "body"):
        return 0
    found = {}
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in ATTRIBUTE.finditer(attributes):
            key = m[1].lower()
            if key in ("class", "id", "role", "itemprop", "hidden", "aria-hidden"):
                found.setdefault(key, html.unescape(m[2] or m[3] or m[4] or ""))
    if "hidden" in found or found.get("aria-hidden") == "true":
        return -2
    article = name in ARTICLE_TAGS or found.get("role") in ("main", "article") or found.get("itemprop") == "articleBody"
    other = -2 if name in OTHER_TAGS or found.get("role") in OTHER_ROLES else 0
    for value in (found.get("class", ""), found.get("id", "")):
        for token in value.split():
            words = [w.lower() for w in WORD.findall(token)]
            if not words or words[0] in LAYOUT_WORDS:
                continue
            hints = OTHER_WORDS.intersection(words)
            if hints:
                other = min(other, -2 if len(words) == 1 or words[0] in hints else -1)
            article = article or not ARTICLE_WORDS.isdisjoint(words)
    if name in ARTICLE_TAGS:  # only what is surely no article outweighs the element's own name
        return other if other == -2 else 1
    return other or int(article)


class Cutter:
    """Flat blocks of one page."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, int, int, int, int, int]] = []
        self.stack: list[tuple[str, int]] = []
        self.open: dict[str, int] = {}
        self.parts: list[tuple[str, bool]] = []
        self.inside = [0]  # of each open article, and of the page, the elements opened in it that hold no article
        self.sure = 0
        self.heading = 0
        self.headers = 0  # headers of articles: their headings are the article's

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join(html.unescape("".join(t for t, _ in self.parts)).split())
        if text:
            linked = sum(len(html.unescape(t).split()) for t, link in self.parts if link)
            self.blocks.append((text, len(text.split()), linked, int(self.heading > 0), self.inside[-1] - (self.headers if self.heading else 0), sum(self.inside[:-1]) + self.sure - (self.headers if self.heading else 0), len(self.inside) - 1))
        self.parts = []

    def push(self, name: str, attributes: str) -> None:
        kind = _kind(name, attributes) if attributes or name in OTHER_TAGS or name in ARTICLE_TAGS else 0
        if kind and name != "a":
            self.flush()
        if name == "header" and len(self.inside) > 1 and self.inside[-1] == 0:
            name = "header of an article"
            self.headers += 1
        self.stack.append((name, kind))
        self.open[name] = self.open.get(name, 0) + 1
        if kind == 1:
            self.inside.append(0)
        elif kind == -1:
            self.inside[-1] += 1
        elif kind == -2:
            self.inside[-1] += 1
            self.sure += 1
        self.heading += name in HEADINGS

    def pop(self) -> str:
        name, kind = self.stack[-1]
        if kind and name != "a":
            self.flush()
        self.stack.pop()
        self.open[name] -= 1
        self.headers -= name == "header of an article"
        if kind == 1:
            self.inside.pop()
        elif kind:
            self.inside[-1] -= 1
            self.sure -= kind == -2
        self.heading -= name in HEADINGS
        return name

    def close(self, name: str) -> None:
        if self.open.get(name):
            while self.pop() != name:
                pass

    def start(self, name: str, attributes: str) -> None:
        if name in INLINE:
            if name == "a":
                self.close("a")
            if name not in VOID:
                if name in ("a", "span", "small", "label") or attributes:
                    self.push(name, attributes)
            return
        if name in ("br", "wbr"):
            self.parts.append((" ", False))
            return
        self.flush()
        self.close("p")
        if name in HEADINGS:
            for h in HEADINGS:
                self.close(h)
        for ended in ENDS.get(name, ()):
            if self.open.get(ended):
                depth = len(self.stack) - 1
                while depth >= 0 and self.stack[depth][0] not in WALLS and self.stack[depth][0] != ended:
                    depth -= 1
                if depth >= 0 and self.stack[depth][0] == ended:
                    while len(self.stack) > depth:
                        self.pop()
        if name not in VOID:
            self.push(name, attributes)

    def end(self, name: str) -> None:
        if name in INLINE:
            if self.open.get(name):  # not beyond the block that it is in
                for depth in range(len(self.stack) - 1, -1, -1):
                    if self.stack[depth][0] == name:
                        while len(self.stack) > depth:
                            self.pop()
                        break
                    if self.stack[depth][0] not in INLINE:
                        break
            return
        self.flush()
        if name == "header" and self.headers:
            name = "header of an article"
        self.close(name)


def blocks_of(page: str) -> list[tuple[str, int, int, int, int, int, int]]:
    """Flat blocks of a page: text, words, words in links, heading, elements around that hold no article inside the innermost article and outside it (of the latter those that surely hold none count twice), articles around."""
    cutter, at = Cutter(), 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            cutter.parts.append((page[at : m.start()], bool(cutter.open.get("a"))))
        at = m.end()
        name = m["name"]
        if name is not None:
            name = name.lower()
            if m["end"]:
                cutter.end(name)
            elif name != "head":
                cutter.start(name, m["attrs"])
    if at < len(page):
        cutter.parts.append((page[at:], bool(cutter.open.get("a"))))
    cutter.flush()
    return cutter.blocks


def features(block: Column | dict, before: Column | dict | None, after: Column | dict | None) -> dict:
    """The numbers of a block; for plain dicts as for Columns. A neighbour that is not there counts as without words."""

    def density(b):
        if b is None:
            return 0.0
        if isinstance(b, Column):
            return F.coalesce(b["links"] / b["words"], F.lit(0.0))
        return b["links"] / b["words"]

    def words(b):
        if b is None:
            return 0
        return F.coalesce(b["words"], F.lit(0)) if isinstance(b, Column) else b["words"]

    text = block["text"]
    sentence = text.rlike(SENTENCE).cast("int") if isinstance(text, Column) else int(re.search(SENTENCE, text) is not None)
    return {
        "words": words(block), "density": density(block), "before_words": words(before), "before_density": density(before), "after_words": words(after), "after_density": density(after),
        "heading": block["heading"], "sentence": sentence, "inside": block["inside"], "outside": block["outside"], "body": block["body"],
    }


#: How a block that is a sentence ends.
SENTENCE = "[.!?:;…。！？][\"'”’»)\\]]*$"


# ---------------------------------------------------------------- the labelled table
#: Sketches of pages, a line each of label and html. 1: main text, 0: not, -: markup alone. {n} stands for n words, {n.} for a sentence of n words.
LABELLED = (
    """
- <html><body><nav><ul>
0 <li><a href="/a">{1}</a></li>
0 <li><a href="/b">{2}</a></li>
- </ul></nav>
0 <div class="ad">{9.}</div>
- <article>
1 <h1>{8}</h1>
1 <p>{60.}</p>
1 <p>{2.}</p>
1 <p>{1}</p>
1 <p><b>{12}</b></p>
1 <p>{90.}</p>
- </article>
0 <footer>&copy; {7.}</footer>
- </body></html>
""",
    """
- <html><body class="single with-sidebar">
0 <header><div class="logo">{2}</div></header>
0 <div class="cookie-notice">{18.}</div>
- <div id="wrap"><main><article class="post">
1 <h1>{6}</h1>
0 <div class="post-meta">{5}</div>
1 <p>{3.}</p>
1 <p>{40.} <a href="/x">{2}</a></p>
1 <ul><li>{4}</li>
1 <li>{9.}</li></ul>
1 <h2>{3}</h2>
1 <blockquote>{25.}</blockquote>
1 <p>{1.}</p>
0 <aside>{20.}</aside>
0 <div class="share-buttons"><a href="/f">{2}</a></div>
1 <p>{30.}</p>
- </article>
0 <section id="comments"><h3>{2}</h3>
0 <div class="comment"><p>{35.}</p></div>
0 <div class="comment"><p>{3.}</p></div>
0 <form class="comment-form"><label>{3}</label></form>
- </section></main>
0 <aside class="sidebar"><h4>{2}</h4>
0 <p>{25.}</p>
0 <ul><li><a href="/1">{7}</a></li>
0 <li><a href="/2">{8}</a></li></ul></aside></div>
0 <footer><p>{30.}</p>
0 <p>{3}</p></footer>
- </body></html>
""",
    """
- <html><body>
0 <div id="header"><a href="/">{2}</a></div>
0 <div id="nav"><a href="/1">{1}</a> <a href="/2">{1}</a></div>
- <div id="content">
1 <h1>{5}</h1>
1 <p>{50.}</p>
1 <p>{4.}</p>
1 <h3>{2}</h3>
1 <p>{70.}</p>
0 <div class="related"><h3>{2}</h3>
0 <a href="/r">{9}</a></div>
- </div>
0 <div id="sidebar"><p>{28.}</p>
0 <p>{12}</p></div>
0 <div id="footer">{12}</div>
- </body></html>
""",
    """
- <html><body>
0 <div><a href="/1">{1}</a> | <a href="/2">{1}</a> | <a href="/3">{2}</a></div>
1 <h1>{6}</h1>
1 <p>{45.}</p>
1 <p>{30.}</p>
1 <p>{14.}</p>
1 <p>{80.}</p>
0 <div><a href="/4">{6}</a></div>
0 <div><a href="/5">{8}</a></div>
0 <div>{4}</div>
- </body></html>
""",
    """
- <html><body><table><tr><td>
0 <a href="/1">{2}</a><br><a href="/2">{2}</a></td><td>
1 <h2>{4}</h2>
1 <p>{38.}</p>
1 <p>{22.} <a href="/x">{3}</a> {10.}</p>
1 <p>{55.}</p>
- </td></tr><tr><td>
0 {5}
- </td></tr></table>
0 <p><a href="/3">{2}</a> <a href="/4">{1}</a></p>
- </body></html>
""",
    """
- <html><body>
0 <div role="banner"><p>{6}</p></div>
0 <div role="alert">{22.}</div>
- <div class="page has-sidebar"><div role="main">
1 <h1>{7}</h1>
1 <p>{20.}</p>
1 <pre>{15}</pre>
1 <p>{6.}</p>
- </div></div>
0 <div role="complementary"><h2>{2}</h2>
0 <p>{40.}</p></div>
0 <form action="/s"><p>{8.}</p>
0 <button>{1}</button></form>
0 <div role="contentinfo"><p>{18.}</p></div>
- </body></html>
""",
    """
- <html><body>
- <div class="layout sidebar-left"><article>
1 <h1>{3}</h1>
1 <p>{1}</p>
- </article>
0 <div class="newsletter-signup"><p>{15.}</p></div>
0 <ol class="commentlist"><li><article class="comment"><p>{33.}</p></article></li></ol>
0 <div class="recommended"><article><h4>{6}</h4>
0 <p>{16.}</p></article></div>
0 <aside><h3>{11}</h3></aside>
- </div>
0 <footer><ul><li><a href="/p">{2}</a></li></ul></footer>
- </body></html>
""",
    """
- <html><body>
0 <p><a href="/1">{3}</a></p>
1 <p>{100.}</p>
1 <p>{65.}</p>
1 <p>{48.}</p>
0 <p>{3}</p>
0 <p><a href="/2">{2}</a> <a href="/3">{2}</a></p>
- </body></html>
""",
    """
0 <body><header><a href="/">{2}</a></header><article><header>
1 <h1>{2}</h1>
0 <p>{4}</p></header>
1 <p>{25.}</p>
1 <p><a href="/s">{8.}</a></p>
1 <ul><li><a href="/t">{3}</a></li>
1 <li><a href="/u">{4}</a></li></ul>
0 <footer>{6}</footer>
1 <p>{2}</p>
- </article>
""",
    """
- <body>
1 <article><p>{1}</p></article>
""",
    """
- <body>
1 <p>{12.}</p>
1 <p>{40.}</p>
1 <p>{2.}</p>
1 <p>{35.}</p>
""",
    """
- <body>
1 <p>{6.}</p>
""",
    """
- <body><div class="main-menu">
0 {4}</div><div class="entry-content">
1 <p>{5}</p>
1 <p><a href="/w">{1}</a></p>
1 <h2><a href="/v">{5}</a></h2>
1 <table><tr><td>{1}</td>
1 <td>{2}</td></tr></table>
- </div><div class="post-navigation">
0 <a href="/n">{5}</a></div>
""",
    """
- <body>
0 <ul><li><a href="/a">{1}</a></li>
0 <li>{1}</li></ul>
1 <h1>{3}</h1>
1 <p>{18.}</p>
1 <p>{5.}</p>
1 <p>{33.}</p>
0 <p>&copy; {4}</p>
""",
)


def sketch(lines: str) -> tuple[str, list[tuple[str, int]]]:
    """A page of a sketch, and the labels of its blocks in order."""
    serial = 0

    def said(m: re.Match) -> str:
        nonlocal serial
        n = int(m[1])
        words = [f"w{serial + i}" for i in range(n)]
        serial += n
        return " ".join(words) + m[2]

    page, labels = [], []
    for line in lines.strip().split("\n"):
        label, text = line.split(" ", 1)
        page.append(re.sub(r"\{(\d+)(\.?)\}", said, text))
        if label != "-":
            labels.append(int(label))
    return "\n".join(page), labels


def labelled_rows(sketches: tuple[str, ...] = LABELLED) -> tuple[list[list[float]], list[int]]:
    """Features and labels of the sketches' blocks."""
    rows, labels = [], []
    names = ("text", "words", "links", "heading", "inside", "outside", "body")
    for lines in sketches:
        page, wanted = sketch(lines)
        found = [dict(zip(names, b, strict=True)) for b in blocks_of(page)]
        if len(found) != len(wanted):
            raise ValueError("a line of a sketch is not one block")
        for i, block in enumerate(found):
            known = features(block, found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None)
            rows.append([float(known[f]) for f in FEATURES])
        labels += wanted
    return rows, labels


# ---------------------------------------------------------------- the tree
@dataclass(frozen=True)
class Node:
    """feature <= threshold: low, else high; a leaf has only its share of main text."""

    share: float
    feature: str = ""
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def keeps(self, known: dict) -> bool:
        node = self
        while node.low is not None:
            node = node.low if known[node.feature] <= node.threshold else node.high
        return node.share >= 0.5

    def column(self, known: dict) -> Column:
        if self.low is None:
            return F.lit(self.share >= 0.5)
        return F.when(known[self.feature] <= self.threshold, self.low.column(known)).otherwise(self.high.column(known))


def grown(rows: list[list[float]], labels: list[int], depth: int = 8, least: int = 1) -> Node:
    """A tree of least Gini impurity; equal splits: the first feature, the smallest threshold. A split halves the gap between two values."""
    x, y = np.array(rows, float).reshape(len(rows), len(FEATURES)), np.array(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Node(share)
    best = (len(y) * share * (1 - share) - 1e-9, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        for i in np.flatnonzero(v[1:] > v[:-1]):
            left, right = n[i], len(y) - n[i]
            if min(left, right) >= least:
                p, q = ones[i] / left, (ones[-1] - ones[i]) / right
                impurity = left * p * (1 - p) + right * q * (1 - q)
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, (v[i] + v[i + 1]) / 2)
    if best[0] >= len(y) * share * (1 - share) - 1e-9:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    halves = [grown(x[side].tolist(), y[side].tolist(), depth - 1, least) for side in (low, ~low)]
    return Node(share, FEATURES[best[1]], best[2], *halves)


@cache
def trained() -> Node:
    return grown(*labelled_rows())


# ---------------------------------------------------------------- Spark
def page_blocks(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with blocks, the flat blocks of each, in the place of their html."""
    pages = pages.drop("blocks")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != column), f"blocks {BLOCKS}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("text", "words", "links", "heading", "inside", "outside", "body")
        kind = pa.list_(pa.struct([("text", pa.string()), *((n, pa.int32()) for n in names[1:])]))
        for batch, texts in text_blocks(batches, column):
            rows = pa.array([[dict(zip(names, b, strict=True)) for b in blocks_of(t)] for t in texts], kind)
            place = batch.schema.get_field_index(column)
            others = [i for i in range(batch.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), rows], names=[*(batch.schema.names[i] for i in others), "blocks"])

    return pages.mapInArrow(run, schema)


def main_blocks(blocks: Column, tree: Node | None = None) -> Column:
    """Texts of the blocks that the tree takes for main text."""
    tree = tree or trained()

    def judged(block: Column, i: Column) -> Column:
        known = features(block, F.get(blocks, i - 1), F.get(blocks, i + 1))
        return F.when(tree.column(known), block["text"])

    return F.filter(F.transform(blocks, judged), lambda t: t.isNotNull())


def extract_main_text(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """pages (page_id, url, html): page_id, url, text, n_chars."""
    found = page_blocks(only(pages, page_id="long", url="string", html="string"))
    text = F.array_join(main_blocks(F.col("blocks"), tree), "\n")
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


_BLANKS = "[\\x09-\\x0D\\x20]+"
QUERIES = {"op11_main_text": op11}
ORACLES = {
    "op11_main_text": f"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
b AS (SELECT r, page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS b FROM a),
c AS (SELECT r, page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '{_BLANKS}', ' ', 'g'))), lambda x: x <> '') AS c FROM b)
SELECT page_id, url, array_to_string(c, chr(10)) AS text, length(array_to_string(c, chr(10))) AS n_chars FROM c
"""
}
