"""Request lists, texts, pages, PDFs, notes and configuration as DataFrames."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..operators.requests import from_offset
from ..operators.windows import prefix_cut_array
from ..schemas import RAW_REQUEST


def read_requests(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """A JSON array of requests with their place in it (seq), from start on; any other suffix than .json is refused."""
    if not path.endswith(".json"):
        raise ValueError("a batch is a .json file")
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "array<string>")
    row = F.from_json("entry", RAW_REQUEST, {"mode": "PERMISSIVE", "primitivesAsString": "true"})
    return from_offset(raw.select(F.posexplode(entries).alias("seq", "entry")), start).select("seq", row.alias("r")).select("seq", "r.*")


def single_request(spark: SparkSession, link: str, upload_date: str, already_read: bool = False) -> DataFrame:
    return spark.createDataFrame([(link, upload_date, str(already_read).lower(), None, None)], RAW_REQUEST)


def read_texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Whole text files: link, content."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("link"), F.col("value").alias("content"))


def fetch(links: DataFrame, client: Callable[[], Callable[[str], tuple[int, bytes]]]) -> DataFrame:
    """links (link, ...): with status, body, error. client() is called once a task and gives a function from link to (status, body)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema) + ", status int, body binary, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = client()
        for frame in frames:
            rows = []
            for link in frame["link"]:
                try:
                    rows.append((*get(link), None))
                except Exception as e:  # any failure is the row's, not the batch's
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            yield frame.assign(**{n: [r[k] for r in rows] for k, n in enumerate(("status", "body", "error"))}).astype({"status": "Int32"})

    return links.mapInPandas(run, schema)


def split_fetched(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with status 200, and all others."""
    good = F.coalesce(F.col("status") == 200, F.lit(False))
    return fetched.where(good), fetched.where(~good)


#: Tags that never have an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    SILENT = {"script", "style", "template"}

    def __init__(self, strip_classes: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[tuple[str | None, str]] = []
        self.open: list[tuple[str | None, list[str]]] = []
        self.silent = 0
        self.strip = strip_classes

    def handle_starttag(self, tag, attrs):
        if tag not in VOID and (tag in self.SILENT or self.silent or self.strip & set((dict(attrs).get("class") or "").split())):
            self.silent += 1
        for _, outer in self.open:
            outer.append(self.get_starttag_text())
        if tag == "a":
            self.open.append((dict(attrs).get("href"), [self.get_starttag_text()]))
            self.links.append(("", ""))
            self.open[-1][1].append(len(self.links) - 1)

    def handle_endtag(self, tag):
        for _, outer in self.open:
            outer.append(f"</{tag}>")
        if tag == "a" and self.open:
            href, outer = self.open.pop()
            self.links[outer[1]] = (href, "".join(x for x in outer if isinstance(x, str)))
        if self.silent and tag not in VOID:
            self.silent -= 1

    def handle_data(self, data):
        for _, outer in self.open:
            outer.append(data)
        if not self.silent:
            self.text.append(data)

    def finish(self):
        self.close()
        while self.open:
            href, outer = self.open.pop()
            self.links[outer[1]] = (href, "".join(x for x in outer if isinstance(x, str)))


def parse_page(html: str, strip_classes: frozenset[str] = frozenset()) -> tuple[str, list[tuple[str | None, str]]]:
    """Text without scripts, styles and comments; all anchors in document order: href, outer HTML."""
    page = _Page(strip_classes)
    page.feed(html)
    page.finish()
    return "".join(page.text), page.links


def extract_pages(pages: DataFrame, column: str = "html", strip_classes: tuple[str, ...] = ()) -> DataFrame:
    """pages with content and content_links: outer HTML of the anchors whose href starts with http (case counts)."""
    strip = frozenset(strip_classes)

    kind = pa.struct([("content", pa.string()), ("anchors", pa.list_(pa.struct([("href", pa.string()), ("outer_html", pa.string())])))])

    @F.arrow_udf("content string, anchors array<struct<href: string, outer_html: string>>")
    def parsed(html: pa.Array) -> pa.Array:
        def rows(part: pa.Array) -> pa.Array:
            found = (parse_page(h.decode("utf-8", "replace") if isinstance(h, bytes) else h or "", strip) for h in part.to_pylist())
            return pa.array([{"content": t, "anchors": [{"href": h, "outer_html": o} for h, o in links]} for t, links in found], kind)

        return pa.concat_arrays([pa.array([], kind), *map(rows, slices(html))])

    web = F.filter("page.anchors", lambda a: F.coalesce(a["href"].startswith("http"), F.lit(False)))
    return pages.withColumn("page", parsed(F.col(column))).withColumns({"content": F.col("page.content"), "anchors": F.col("page.anchors"), "content_links": F.transform(web, lambda a: a["outer_html"])}).drop("page")


def anchor_hrefs(html: Column) -> Column:
    """All double-quoted hrefs of anchors, in order: the JVM-side form for counts and filters."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def html_text(html: Column) -> Column:
    """Text of a page by patterns alone, entities left as they are."""
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", ""), r"<[^>]*>", "")


def pdf_pages(files: DataFrame, extract: Callable[[bytes], list[str]], first: int | None = None) -> DataFrame:
    """files (path, content binary): path, page, text, of all pages or the first so many. extract gives the pages' texts of one file."""

    @F.pandas_udf("array<string>")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: extract(bytes(raw)))

    found = pages("content") if first is None else F.slice(pages("content"), 1, first)
    return files.select("path", F.posexplode(found).alias("page", "text"))


def first_pages(pages: list[str | None], limit: float) -> list[str]:
    """Pages up to the first with which there are more than limit words (as word_count counts them) in all, that one included: all that a cut at the limit looks at."""
    kept, words = [], 0
    for page in pages:
        kept.append(page or "")
        words += kept[-1].count(" ") + 1
        if words > limit:
            break
    return kept


def pdf_texts(body: Column, extract: Callable[[bytes], list[str]] | None, limit: float = float("inf")) -> Column:
    """PDFs as bytes: struct(pages: the texts of their first_pages(), error: why they could not be read); null pages for null."""

    kind = pa.struct([("pages", pa.list_(pa.string())), ("error", pa.string())])

    @F.arrow_udf("pages array<string>, error string")
    def read(content: pa.Array) -> pa.Array:
        def row(raw: bytes | None) -> dict:
            try:
                return {"pages": None if raw is None else first_pages(extract(raw), limit), "error": None}
            except Exception as e:  # any failure is the row's, not the batch's
                return {"pages": None, "error": f"{type(e).__name__}: {e}"}

        return pa.concat_arrays([pa.array([], kind), *(pa.array(map(row, part.to_pylist()), kind) for part in slices(content))])

    if extract is None:
        return F.struct(F.lit(None).cast("array<string>").alias("pages"), F.when(body.isNotNull(), "no PDF extractor").alias("error"))
    return read(body)


def plain_text(body: Column) -> Column:
    """Whole text files as bytes: their text, line ends as \\n."""

    @F.arrow_udf("string")
    def decoded(content: pa.Array) -> pa.Array:
        def row(raw: bytes | None) -> str | None:
            return None if raw is None else raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")

        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(map(row, part.to_pylist()), pa.string()) for part in slices(content))])

    return decoded(body)


def load_contents(loaded: DataFrame, extract: Callable[[bytes], list[str]] | None, limit: float) -> tuple[DataFrame, DataFrame]:
    """loaded (loader, body, ...) with content and content_links (null but for web pages), and those that could not be read, with error.

    PDFs give their first pages of at most limit words in all. Bodies are read in one pass, whatever their loader.
    """
    of = lambda kind: F.when(F.col("loader") == kind, F.col("body"))
    pages = extract_pages(loaded.withColumn("html", of("url")), "html").withColumns({"pdf": pdf_texts(of("pdf"), extract, limit), "plain": plain_text(of("text"))})
    content = F.when(F.col("loader") == "pdf", prefix_cut_array(F.col("pdf.pages"), limit)["content"]).when(F.col("loader") == "text", F.col("plain")).otherwise(F.col("content"))
    read = pages.withColumns({"content": content, "content_links": F.when(F.col("loader") == "url", F.col("content_links")), "error": F.col("pdf.error")}).drop("html", "pdf", "plain", "anchors")
    return read.where("error is null"), read.where("error is not null")


def read_notes(spark: SparkSession, vault: str, directory: str) -> DataFrame:
    """Notes of vault/directory/<type>/<name>.md: type, name, meta (front matter), body. Names with a colon are not for Hadoop's file systems."""
    note = spark.read.text(f"{vault}/{directory}/*/*.md", wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parts = lambda k: F.regexp_extract("value", r"(?s)^(?:---\n(.*?)\n---\s*\n?)?(.*)$", k)

    @F.pandas_udf("map<string,string>")
    def front_matter(text: pd.Series) -> pd.Series:
        import json

        import yaml

        return text.map(lambda t: {str(k): v if isinstance(v, str) else None if v is None else json.dumps(v, default=str) if isinstance(v, (list, dict, bool, int, float)) else str(v) for k, v in (yaml.safe_load(t) or {}).items()} if t else {})

    decoded = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    return note.select(
        F.element_at(F.split(decoded, "/"), -2).alias("type"), F.regexp_replace(F.element_at(F.split(decoded, "/"), -1), r"\.md$", "").alias("name"), front_matter(parts(1)).alias("meta"), F.rtrim(parts(2)).alias("body")
    )


def edges(notes: DataFrame, *key: str) -> DataFrame:
    """notes (key columns, body): the key with target, for each [[target]] of the body."""
    return notes.select(*key, F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|]+)\]\]"), F.lit(1))).alias("target"))


def read_table_lines(spark: SparkSession, path: str, first: int = 6, stop: int = 30) -> DataFrame:
    """Rows of a Markdown pipe table: line_no, date cell, link cell."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where(F.col("line_no").between(first, stop - 1))
    cells = F.split("line", r"\|")
    return lines.select("line_no", F.trim(F.get(cells, F.lit(1))).alias("date"), F.trim(F.get(cells, F.lit(2))).alias("link"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def load_config(kind: type, path: str):
    """YAML over the dataclass's defaults, nested dataclasses too; ${oc.env:NAME} is the environment's value; unknown keys and missing required ones are errors."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return _configured(kind, yaml.safe_load(f) or {}, "")


def _configured(kind: type, values: dict, place: str):
    import os
    import re
    from typing import get_type_hints

    known = {f.name: f for f in dataclasses.fields(kind)}
    if set(values) - set(known):
        raise KeyError(f"unknown settings: {sorted(place + str(k) for k in set(values) - set(known))}")
    kinds, found = get_type_hints(kind), {}
    for name, f in known.items():
        if name in values:
            value = values[name]
        elif f.default is not dataclasses.MISSING:
            value = f.default
        elif f.default_factory is not dataclasses.MISSING:
            value = {} if dataclasses.is_dataclass(kinds[name]) else f.default_factory()
        else:
            raise KeyError(f"missing setting: {place}{name}")
        if dataclasses.is_dataclass(kinds[name]) and isinstance(value, dict):
            value = _configured(kinds[name], value, f"{place}{name}.")
        found[name] = re.sub(r"\$\{oc\.env:(\w+)\}", lambda m: os.environ[m[1]], value) if isinstance(value, str) else value
    return kind(**found)


class MissingPrompt(FileNotFoundError):
    pass


def load_prompt(name: str, directory: str | None = None) -> str:
    """A prompt file's text; the package's own prompts where no directory is given."""
    from pathlib import Path

    file = Path(directory or Path(__file__).parents[1] / "prompts") / name
    if not file.exists():
        raise MissingPrompt(f"no prompt {name} in {file.parent}")
    return file.read_text(encoding="utf-8")
