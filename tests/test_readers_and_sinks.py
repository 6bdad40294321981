"""Sources, writers, prompts and settings, each on small files; ingestion that asks once."""

import dataclasses
import json
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from noteloom.functions import columns as C
from noteloom.functions.similarity import jaro_of
from noteloom.operators import enrich, requests, resolve, sinks, windows
from noteloom.plans import ingest
from noteloom.sources import readers

NOTE = "content_type string, title string, link string, upload_date string, already_read boolean, read_priority int, source string, tags array<string>, body string"
TOPIC = "type string, name string, date string, description string"


def test_request_lists(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"link": f"https://x.com/{i}", "upload_date": "2024-09-04", "read_priority": i} for i in range(4)]))
    rows = readers.read_requests(spark, str(tmp_path / "b.json"), 2).collect()
    assert [(r.seq, r.link, r.read_priority) for r in rows] == [(2, "https://x.com/2", "2"), (3, "https://x.com/3", "3")]
    with pytest.raises(ValueError):
        readers.read_requests(spark, str(tmp_path / "b.JSON"))
    assert readers.single_request(spark, "https://x.com", "2024-09-04", True).first().already_read == "true"


def test_request_as_json(spark):
    rows = requests.validate(spark.createDataFrame([("https://x.com", "2024-09-04", None, None, None), ("a", "2024-09-04", "yes", "3", "mail")], "link string, upload_date string, already_read string, read_priority string, source string"))
    assert [json.loads(r.value) for r in requests.as_json(rows).collect()] == [
        {"link": "https://x.com/", "upload_date": "2024-09-04", "already_read": False, "read_priority": 1},
        {"link": "a", "upload_date": "2024-09-04", "already_read": True, "read_priority": 3, "source": "mail"},
    ]


def test_texts_by_pattern(spark, tmp_path):
    for name, text in (("a.txt", "one\ntwo"), ("b.txt", ""), ("c.md", "no")):
        (tmp_path / name).write_text(text)
    rows = {r.link.rsplit("/", 1)[1]: r.content for r in readers.read_texts(spark, str(tmp_path), "*.txt").collect()}
    assert rows["a.txt"] == "one\ntwo" and "c.md" not in rows


def test_notes_there_and_back(spark, tmp_path):
    notes = spark.createDataFrame([("Blog post", "A/B, c", "https://x.org/", "2024-01-01", False, 2, None, ["Deep_Learning"], "see [[topics/Concept/Graph]]\nend"), ("Course", "ü + é", "l", "2024-01-02", True, 1, "mail", None, "b")], NOTE)
    kept = sinks.with_type(notes).withColumn("name", C.note_name(F.col("title")))
    meta = ["link", "upload_date", "already_read", "read_priority", "source", "tags", "type"]
    assert sinks.export_notes(kept, str(tmp_path), "contents", "content_type", "name", "body", meta) == 2
    (tmp_path / "contents" / "deep" / "er").mkdir(parents=True)
    (tmp_path / "contents" / "deep" / "er" / "no.md").write_text("too deep")
    found = {r["name"]: r for r in readers.read_notes(spark, str(tmp_path), "contents").collect()}
    assert set(found) == {"A B, c", "ü + é"}
    one = found["A B, c"]
    assert (one.type, one.body) == ("Blog post", "see [[topics/Concept/Graph]]\nend")
    assert one.meta["type"] == "Content" and json.loads(one.meta["tags"]) == ["Deep_Learning"] and "source" not in one.meta and one.meta["read_priority"] == "2"
    links = readers.edges(readers.read_notes(spark, str(tmp_path), "contents"), "type", "name").collect()
    assert [(r["name"], r.target) for r in links] == [("A B, c", "topics/Concept/Graph")]


def test_table_lines_with_gaps(spark, tmp_path):
    lines = ["x"] * 6 + ["|01/02/2024| https://a |", "|| https://b |", "| 03/02/2024 | https://c |"] + ["|z|late|"] * 30
    (tmp_path / "t.md").write_text("\n".join(lines))
    rows = readers.read_table_lines(spark, str(tmp_path / "t.md"))
    assert rows.count() == 24
    filled = windows.forward_fill(rows.where("line_no < 9"), "date", ["line_no"], empty=F.col("date") == "").withColumn("date", C.iso_date(F.col("date")))
    assert [(r.date, r.link) for r in filled.orderBy("line_no").collect()] == [("2024-02-01", "https://a"), ("2024-02-01", "https://b"), ("2024-02-03", "https://c")]


def test_csv_and_text_lines(spark, tmp_path):
    rows = spark.createDataFrame([("https://a, b", 1), ('say "x"', None)], "link string, n int")
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "c"), "link string, n int").collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    sinks.write_text(rows, "link", str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["https://a, b", 'say "x"']


def test_failures_and_snapshot(spark, tmp_path):
    failed = spark.createDataFrame([("l", "status 404")], "link string, reason string")
    assert not sinks.write_failures(failed.where("false"), str(tmp_path / "f")) and not (tmp_path / "f").exists()
    assert sinks.write_failures(failed, str(tmp_path / "f")) and spark.read.json(str(tmp_path / "f")).first().reason == "status 404"
    notes = spark.createDataFrame([("Course", "t", "l", "2024-01-02", True, 1, None, ["x"], "b")], NOTE)
    sinks.write_snapshot(sinks.with_type(notes), str(tmp_path / "s"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "s")).collect()] == [{"link": "l", "upload_date": "2024-01-02", "already_read": True, "read_priority": 1}]


def test_vault(spark, tmp_path):
    said = []
    assert sinks.synced(str(tmp_path), lambda: said.append(["work"]) or 7, lambda a: said.append(a)) == 7
    assert [a[0] for a in said] == ["pull", "work", "add", "commit", "push"] and (tmp_path / "status.md").read_text().startswith("Last update on : 20")
    files = spark.createDataFrame([("../../up.pdf", b"1"), ("a.pdf", b"2")], "name string, content binary")
    assert sinks.write_artefacts(files, str(tmp_path / "v")) == 2
    assert sorted(p.name for p in (tmp_path / "v" / "artefacts").iterdir()) == ["a.pdf", "up.pdf"] and not (tmp_path / "up.pdf").exists()
    with pytest.raises(Exception, match="no file name"):
        sinks.write_artefacts(spark.createDataFrame([("x/..", b"1")], "name string, content binary"), str(tmp_path / "v"))
    with pytest.raises(PermissionError):
        sinks.reset(str(tmp_path / "v"))
    sinks.reset(str(tmp_path / "v"), confirmed=True)
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["artefacts", "contents", "topics"] and not list((tmp_path / "v" / "artefacts").iterdir())


@dataclass
class Inner:
    repository: str
    token: str = "${oc.env:NOTELOOM_TOKEN}"


@dataclass
class Outer:
    path: str
    depth: int = 3
    inner: Inner = field(default_factory=lambda: Inner("none"))


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("NOTELOOM_TOKEN", "t0")
    file = tmp_path / "c.yaml"
    file.write_text("path: p\ninner:\n  repository: r\n")
    assert dataclasses.asdict(readers.load_config(Outer, str(file))) == {"path": "p", "depth": 3, "inner": {"repository": "r", "token": "t0"}}
    for text, match in (("depth: 1", "missing setting: path"), ("path: p\ninner: {}", "missing setting: inner.repository"), ("path: p\ninner: {repository: r, x: 1}", "inner.x"), ("path: p\nother: 1", "other")):
        file.write_text(text)
        with pytest.raises(KeyError, match=match):
            readers.load_config(Outer, str(file))


def test_prompts(spark, tmp_path):
    with pytest.raises(readers.MissingPrompt):
        readers.load_prompt("summary.txt", str(tmp_path))
    seen = []

    def complete(prompt):
        seen.append(prompt)
        if "may be about the same thing" in prompt:
            return json.dumps({"merge_topic": "Keras" in prompt, "topic": {"type": "Library", "name": "Keras", "description": "d"}})
        return "[]" if "look up" in prompt else '{"title": "t", "content_type": "Course", "tags": []}' if "Catalogue" in prompt else "text"

    client = enrich.Prompted(complete)
    assert client.summary("say {tags} {content}") == "text" and "say {tags} {content}" in seen[0]
    assert client.description("c")["title"] == "t" and "Blog post" in seen[1] and "Deep Learning" in seen[1]
    assert client.topics("c") == [] and client.links("u", "c", "<a>") == "text" and "<a>" in seen[3]
    topic = {"type": "Library", "name": "Keras", "description": None}
    assert client.judge(topic, topic)["name"] == "Keras" and client.judge({**topic, "name": "x"}, {**topic, "name": "y"}) is None
    rendered = spark.range(1).select(C.render("a {x} {y}", x=F.lit("{y}"), y=F.lit(None).cast("string")).alias("p")).first().p
    assert rendered == "a  "


def test_page_edges():
    parse = readers.parse_page
    assert parse('<p>a<img class="x">b</p><p>c</p>', frozenset({"x"}))[0] == "abc"
    assert parse('<div class="x y">no<br>no<b>no</b></div>yes', frozenset({"x"}))[0] == "yes"
    assert parse("a<!-- <a href='http://x'> --><style>p{}</style>&amp;&#39;")[0] == "a&'"


def test_pdf_first_pages(spark):
    files = spark.createDataFrame([("f", b"1|2|3|4")], "path string, content binary")
    rows = readers.pdf_pages(files, lambda raw: raw.decode().split("|"), first=3).orderBy("page").collect()
    assert [(r.page, r.text) for r in rows] == [(0, "1"), (1, "2"), (2, "3")]


def test_text_links_are_absolute(spark):
    cases = {"../a/b.txt": "/v/../a/b.txt", "./x//y.txt": "/v/x/y.txt", "/r/s.txt": "/r/s.txt", "ftp://h/a": "/v/ftp:/h/a"}
    rows = spark.createDataFrame([(k,) for k in cases], "link string").select("link", C.hyperlink(F.col("link"), base="/v").alias("to")).collect()
    assert {r.link: r.to for r in rows} == cases


def test_similar_names_lose_no_pair(spark):
    import random

    r = random.Random(5)
    names = ["", "a", "ab", "ba", "😀ab", "ab😀", "aaaaaaa", "aaaa", "Keras", "Keras 3.0", "kErAs"]
    names += ["".join(r.choice("abcde ") for _ in range(r.randrange(1, 25))) for _ in range(120)]
    names += [n[:2] + "x" + n[2:] for n in names[20:60]] + [n * 2 for n in names[20:30]]
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(999, None)], "i int, a string")
    right = spark.createDataFrame([(i, n) for i, n in enumerate(names[::-1])], "j int, b string")
    for threshold in (0.75, 0.7, 0.9):
        got = {(x.i, x.j): x.score for x in resolve.similar_names(left, right, "a", "b", threshold).collect()}
        want = {(i, j): s for i, a in enumerate(names) for j, b in enumerate(names[::-1]) if (s := jaro_of(a, b)) > threshold}
        assert got == want
    with pytest.raises(ValueError):
        resolve.similar_names(left, right, "a", "b", 0.5)


def test_each_link_is_fetched_and_each_model_asked_once(spark, tmp_path):
    log = tmp_path / "log"
    log.touch()

    def say(what):
        with log.open("a") as f:
            f.write(f"{what}\n")

    def web():
        def get(link):
            say(f"get {link}")
            return 200, f"<p>Kerass Banana {link[-1]}</p>".encode()

        return get

    class Counting(enrich.Stub):
        def summary(self, content):
            say("summary")
            return super().summary(content)

    def judge():
        def decide(new, old):
            say(f"judge {new['name']} {old['name']}")
            return None

        return decide

    raw = spark.createDataFrame([(i, f"https://x.com/{i}", "2024-09-04", None, None, None) for i in range(2)], "seq int, link string, upload_date string, already_read string, read_priority string, source string")
    topics = spark.createDataFrame([("Concept", "Keras", "2020-01-01", "old")], TOPIC)
    outputs = ingest.ingest_batch(raw, topics, spark.createDataFrame([], NOTE), web, judge, Counting)
    for out in (*outputs, *outputs):
        out.collect()
    said = log.read_text().split("\n")[:-1]
    assert sorted(x for x in said if x.startswith("get")) == ["get https://x.com/0", "get https://x.com/1"]
    assert said.count("summary") == 2 and sum(x.startswith("judge Kerass Keras") for x in said) == 2


def test_in_order_each_content_meets_the_notes_before_it(spark):
    raw = spark.createDataFrame([(i, f"https://x.com/{i}", "2024-09-04", None, None, None) for i in (1, 0, 2)], "seq int, link string, upload_date string, already_read string, read_priority string, source string")

    def web():
        return lambda link: (200, b"<p>Kerass</p>") if link[-1] == "0" else (200, b"<p>Kerasss</p>") if link[-1] == "1" else (500, b"")

    def judge():
        return lambda new, old: {"type": "Library", "name": f"{old['name']}+{new['name']}", "description": "m"}

    none = spark.createDataFrame([], TOPIC), spark.createDataFrame([], NOTE)
    topics, contents, failed = ingest.ingest_in_order(raw, *none, web, judge)
    assert [r["name"] for r in topics.collect()] == ["Kerass+Kerasss"]
    assert {r.title: "[[topics/Library/Kerass+Kerasss]]" in r.body for r in contents.collect()} == {"Kerass": True, "Kerasss": True}
    assert [(r.seq, r.reason) for r in failed.collect()] == [(2, "status 500")]
    batch, _, _ = ingest.ingest_batch(raw, *none, web, judge)
    assert sorted(r["name"] for r in batch.collect()) == ["Kerass", "Kerasss"]
