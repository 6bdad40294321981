import json

from pyspark.sql import functions as F

from noteloom.functions import columns as C
from noteloom.functions.similarity import jaro_of
from noteloom.operators import windows
from noteloom.operators.requests import validate
from noteloom.plans.ingest import ingest_batch
from noteloom.sources import readers
from noteloom.streaming.landing import watch


def test_routes(spark):
    cases = {"https://x.com/a.pdf?dl=1": "pdf", "https://x.com/A.PDF": "url", "https://arxiv.org/pdf/2401.1": "pdf", "https://www.arxiv.org/pdf/x": "url", "../data/a.txt": "text", "ftp://x.com/a.pdf": "text", "": "text"}
    rows = spark.createDataFrame([(k,) for k in cases], "link string").select("link", C.loader(F.col("link")).alias("loader")).collect()
    assert {r.link: r.loader for r in rows} == cases


def test_links(spark):
    cases = {"https://Medium.COM/A": "https://readmedium.com/https://medium.com/A", "https://arxiv.org": "https://arxiv.org/", "http://x.com:80/a b": "http://x.com/a%20b", "https://www.medium.com/x": "https://www.medium.com/x", "a/b": "a/b"}
    rows = spark.createDataFrame([(k,) for k in cases], "link string").select("link", C.redirect_mirrored(C.normalise_link(F.col("link"))).alias("to")).collect()
    assert {r.link: r.to for r in rows} == cases


def test_jaro():
    assert round(jaro_of("Keras", "Keras 3.0"), 5) == 0.85185
    assert jaro_of("", "") == 1.0 and jaro_of("", "a") == 0.0


def test_prefix_cut(spark):
    pages = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c"), (1, 2, "d"), (2, 0, "a b c d"), (3, 0, "")], "doc int, page int, text string")
    got = {r.doc: (r.content, r.n_pages, r.n_words) for r in windows.prefix_cut(pages, "doc", "page", "text", 3).collect()}
    assert got == {1: ("a bc", 2, 3), 2: ("", 0, 0), 3: ("", 1, 1)}


def test_page():
    text, links = readers.parse_page('<p>a<a href="http://x">b<i>c</i></a><script>no</script><a>d</a></p>')
    assert text == "abcd" and links == [("http://x", '<a href="http://x">b<i>c</i></a>'), (None, "<a>d</a>")]


def test_validation(spark):
    raw = spark.createDataFrame([("https://x.com", "2024-09-04", None, None, None), ("https://x.com", "08/08/2024", None, None, None), ("a/b", "2024-09-04", "maybe", "1", None), ("a", "1725408000", "yes", "6", None)], "link string, upload_date string, already_read string, read_priority string, source string")
    assert [r.reason for r in validate(raw).collect()] == [None, "upload_date", "already_read", "read_priority"]


def test_batch_and_stream(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"link": "https://x.com/a", "upload_date": "2024-09-04"}, {"link": "https://x.com/b", "upload_date": "2024-09-04"}, {"link": "https://x.com/c", "upload_date": "bad"}]))
    raw = readers.read_requests(spark, str(tmp_path / "b.json"))
    topics = spark.createDataFrame([("Concept", "Keras", "2020-01-01", "old")], "type string, name string, date string, description string")
    notes = spark.createDataFrame([("Blog post", "old", "l", "2020-01-01", False, 1, None, None, "see [[topics/Concept/Keras]]")], "content_type string, title string, link string, upload_date string, already_read boolean, read_priority int, source string, tags array<string>, body string")

    def web():
        return lambda link: (200, b"<p>Title here\nKerass Banana</p>") if link.endswith("a") else (404, b"")

    def judge():
        return lambda new, old: {"type": "Library", "name": "Keras 3", "description": "merged"} if new["name"].startswith("Keras") else None

    new_topics, contents, failed = ingest_batch(raw, topics, notes, web, judge)
    assert {r.seq: r.reason for r in failed.collect()} == {1: "status 404", 2: "upload_date"}
    assert ("Library", "Keras 3") in {(r.type, r["name"]) for r in new_topics.collect()}
    assert {r.title: r.body for r in contents.collect()}["old"] == "see [[topics/Library/Keras 3]]"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps({"link": "https://x.com", "upload_date": "2024-09-04"}))
    seen = []
    watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, n: seen.extend(df.collect())).awaitTermination()
    assert [r.link for r in seen] == ["https://x.com/"]


def test_batch_of_each_loader(spark, tmp_path):
    """A PDF by its extractor, cut at half the token limit, a text as it is; both unparsed."""
    bodies = {"https://x.com/p.pdf": b"%PDF <b>one two</b>|three|four", "notes/t.txt": b"a <b>tag</b>\r\nend", "https://x.com/h": b"<p>page</p>", "https://arxiv.org/pdf/bad": b"broken"}
    raw = spark.createDataFrame([(i, k, "2024-09-04", None, None, None) for i, k in enumerate(bodies)], "seq int, link string, upload_date string, already_read string, read_priority string, source string")
    topics = spark.createDataFrame([], "type string, name string, date string, description string")
    notes = spark.createDataFrame([], "content_type string, title string, link string, upload_date string, already_read boolean, read_priority int, source string, tags array<string>, body string")

    def web():
        return lambda link: (200, bodies[link])

    def judge():
        return lambda new, old: None

    def extract(raw):
        if not raw.startswith(b"%PDF"):
            raise ValueError("no PDF")
        return raw.decode().split("|")

    _, contents, failed = ingest_batch(raw, topics, notes, web, judge, extract=extract, vault=str(tmp_path), token_limit=8, base="/v")
    found = {r.link: r.body.split("\n## Topics")[0] for r in contents.collect()}
    assert {k: v.rstrip() for k, v in found.items()} == {
        "https://x.com/p.pdf": "![](artefacts/p.pdf)\n## Summary\n\n%PDF <b>one two</b>three", "notes/t.txt": "/v/notes/t.txt\n## Summary\n\na <b>tag</b> end", "https://x.com/h": "https://x.com/h\n## Summary\n\npage\n## Links\n\nno links",
    }
    assert {r.link: r.reason for r in failed.collect()} == {"https://arxiv.org/pdf/bad": "ValueError: no PDF"}
    assert {f.name: f.read_bytes() for f in (tmp_path / "artefacts").iterdir() if not f.name.startswith(".")} == {"p.pdf": bodies["https://x.com/p.pdf"], "bad": b"broken"}
    _, _, failed = ingest_batch(raw, topics, notes, web, judge)
    assert {r.link: r.reason for r in failed.collect()} == {k: "no PDF extractor" for k in ("https://x.com/p.pdf", "https://arxiv.org/pdf/bad")}
