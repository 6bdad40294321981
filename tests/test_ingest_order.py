"""Batches in order against one batch a content; failures as rows; answers kept; one commit; links through chains of merges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators.answers import Answers
from noteloom.operators.enrich import Stub, enrich
from noteloom.operators.resolve import rewrite_links
from noteloom.operators.store import Store
from noteloom.operators.windows import forward_fill
from noteloom.plans.ingest import ingest_batch, ingest_in_order, resolve_in_order
from noteloom.streaming.landing import CONTENT_ROWS, TOPIC_ROWS, ingest_into, watch

RAW = "seq int, link string, upload_date string, already_read string, read_priority string, source string"


class Told(Stub):
    """Title and topics stand in the page: `title|type:name,type:name`."""

    def description(self, content):
        return {"title": content.split("|")[0], "content_type": "Course", "tags": []}

    def topics(self, content):
        return [{"type": t.split(":")[0], "name": t.split(":")[1], "description": f"{t} of {content[:4]}"} for t in content.split("|")[1].split(",") if t]


def pages(bodies):
    def web():
        return lambda link: (200, bodies[link].encode())

    return web


def merging():
    """Merges equal names' starts; sometimes into a name of its own making."""

    def decide(new, old):
        if new["name"][:2] != old["name"][:2]:
            return None
        name = {0: new["name"], 1: old["name"], 2: "Joint " + new["name"][:2], 3: "Alpha line"}[sum(map(ord, new["name"] + old["name"])) % 4]
        return {"type": new["type"], "name": name, "description": f"{new['description']} + {old['description']}"}

    return decide


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_in_order_is_one_by_one(spark, tmp_path):
    r = random.Random(1)
    stems = ["Alpha line", "Alpha lines", "Alpine lane", "Beta test", "Beta tests", "Gamma/ray", "Gamma ray", "Delta wing", "Joint Al", "Omega", "Zeta zz"]
    bodies = {f"https://x.org/{i}": f"t{r.randrange(6)} {i % 2}|" + ",".join(f"{r.choice(['Concept', 'Library'])}:{r.choice(stems)}" for _ in range(r.randrange(0, 3))) for i in range(5)}
    raw = spark.createDataFrame([(i, link, f"2024-09-{i + 1:02d}", None, None, None) for i, link in enumerate(bodies)], RAW)
    topics = spark.createDataFrame([("Concept", "Alpha line", "2020-01-01", "old"), ("Library", "Beta", "2020-01-01", "old")], TOPIC_ROWS)
    notes = spark.createDataFrame([("Course", "kept", "l", "2020-01-01", False, 1, None, None, "[[topics/Concept/Alpha line]] [[topics/Library/Beta]]")], CONTENT_ROWS)
    answers = Answers(str(tmp_path / "answers"))
    got = ingest_in_order(raw, topics, notes, pages(bodies), merging, Told, answers=answers)
    want = (topics, notes)
    for i in range(len(bodies)):
        one = ingest_batch(raw.where(F.col("seq") == i), *want, pages(bodies), merging, Told, answers=answers)
        want = tuple(spark.createDataFrame(df.collect(), df.schema) for df in one[:2])
    assert [rows(df) for df in got[:2]] == [rows(df) for df in want]
    assert got[2].count() == 0


def test_levels(spark):
    """Contents that can't meet take one level together; a chain takes as many as it has contents."""
    topics = spark.createDataFrame([*((i, 0, "Concept", 8 * chr(65 + i), "d") for i in range(9)), (9, 0, "Concept", "AAAAAAAB", "d"), (10, 0, "Concept", "AAAAAAAC", "d")], "content_seq long, topic_idx int, type string, name string, description string")
    dates = spark.createDataFrame([(i, "2024-01-01") for i in range(11)], "content_seq long, upload_date string").withColumn("upload_date", F.to_date("upload_date"))
    judged, notes, levels = resolve_in_order(topics, dates, spark.createDataFrame([], TOPIC_ROWS), lambda: lambda new, old: None)
    assert levels == 3 and judged.count() == 11 and notes.count() == 11


class Failing(Stub):
    asked = 0

    def topics(self, content):
        if "bad" in content:
            raise ValueError("no JSON")
        return super().topics(content)

    def description(self, content):
        return {"title": "x"} if "half" in content else super().description(content)


def test_failures_are_rows(spark, tmp_path):
    bodies = {"https://x.org/good": "Title\nKeras Nice", "https://x.org/bad": "bad one\nKeras", "https://x.org/half": "half Keras", "https://x.org/judge": "Title two\nJudge Keres"}
    raw = spark.createDataFrame([(i, k, "2024-09-04", None, None, None) for i, k in enumerate([*bodies, "https://arxiv.org/pdf/"])], RAW)
    topics = spark.createDataFrame([("Concept", "Keres", "2020-01-01", "old")], TOPIC_ROWS)
    none = spark.createDataFrame([], CONTENT_ROWS)

    def judge():
        def decide(new, old):
            if new["name"] == "Keres":
                raise KeyError("merge_topic")

        return decide

    _, contents, failed = ingest_batch(raw, topics, none, pages(bodies | {"https://arxiv.org/pdf/": "%PDF"}), judge, Failing, extract=lambda b: [b.decode()], vault=str(tmp_path))
    assert [r.link for r in contents.collect()] == ["https://x.org/good"]
    assert {r.link.rsplit("/", 1)[1]: r.reason for r in failed.collect()} == {"bad": "topics: ValueError: no JSON", "half": "description: KeyError: 'content_type'", "judge": "judge: KeyError: 'merge_topic'", "": "no file name"}


def test_answers_are_kept(spark, tmp_path):
    texts = spark.createDataFrame([("a", "text", "Title\nKeras", None), ("b", "text", "bad", None), ("c", "url", "Page", ["<a>"])], "link string, loader string, content string, content_links array<string>")
    answers = Answers(str(tmp_path / "answers"), "m1")
    first = enrich(texts, Failing, answers=answers)
    assert {r.link: r.error for r in first.collect()} == {"a": None, "b": "topics: ValueError: no JSON", "c": None}

    def nobody():
        raise RuntimeError("asked")

    again = enrich(texts, nobody, answers=answers)
    assert {r.link: r.error for r in again.collect()} == {"a": None, "b": "topics: RuntimeError: asked", "c": None}
    assert rows(first.where("link <> 'b'")) == rows(again.where("link <> 'b'"))
    assert {r.error for r in enrich(texts, nobody, answers=Answers(answers.path, "m2")).collect()} == {"summary: RuntimeError: asked"}


def test_one_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one, two = spark.range(3).toDF("a"), spark.range(5).toDF("b")
    assert store.read("one", "a long").count() == 0 and store.commit({"one": one, "two": two}, "s", 0)

    class Broken:
        schema = one.schema

        @property
        def write(self):
            raise OSError("disk full")

    with pytest.raises(OSError):  # one table is written, no manifest
        store.commit({"one": spark.range(9).toDF("a"), "two": Broken()}, "s", 1)
    assert (store.read("one").count(), store.read("two").count(), store.manifest()["version"]) == (3, 5, 1)
    assert not store.commit({"one": spark.range(9).toDF("a")}, "s", 0) and store.read("one").count() == 3
    assert store.commit({"one": spark.range(9).toDF("a")}, "s", 1) and (store.read("one").count(), store.read("two").count()) == (9, 5)
    assert store.vacuum() == 3 and (store.read("one").count(), store.read("two").count(), store.vacuum()) == (9, 5, 0)


def test_batches_land_once(spark, tmp_path):
    """A run that ends after a batch was handled, before the stream noted it, handles it again: nothing changes."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"link": f"https://x.org/{i}", "upload_date": d}) for i, d in enumerate(["2024-09-04", "bad", "2024-09-05"])))
    bodies = {f"https://x.org/{i}": f"Title {i}\nKeras{i} Word" for i in range(3)}
    store, calls = Store(spark, str(tmp_path / "s")), []

    def ingest(requests, topics, contents):
        calls.append(1)
        return ingest_batch(requests, topics, contents, pages(bodies), lambda: lambda new, old: None)

    handle = ingest_into(store, ingest)

    def dies(df, n):
        handle(df, n)
        raise OSError("killed")

    with pytest.raises(Exception, match="killed"):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), dies, validated=False).awaitTermination()
    before = {t: rows(store.read(t)) for t in ("topics", "contents", "failures")}
    watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), handle, validated=False).awaitTermination()
    assert before == {t: rows(store.read(t)) for t in before} and len(calls) == 1 and store.manifest()["version"] == 1
    assert len(before["contents"]) == 2 and len(before["failures"]) == 1


def test_chains_of_merges(spark):
    """Each merge acts on what those before it left; a note meets only merges after it."""
    merges = [(1, 0, "A", "B"), (1, 1, "X", "Y"), (2, 0, "B", "C"), (2, 1, "X", "Z"), (3, 0, "C", "D"), (4, 0, "Y", "A"), (5, 0, "D", "D")]
    df = spark.createDataFrame([(s, i, "t", o, "t", n, "d") for s, i, o, n in merges], "content_seq long, topic_idx int, merged_type string, merged_name string, type string, name string, description string")
    link = lambda x: f"[[topics/t/{x}]]"
    text = " ".join(f"{link(x)} {x}" for x in "ABCDXYZ") + " [[topics/t/A|alias]] [x]"
    notes = spark.createDataFrame([("c", f"n{s}", text, s) for s in (-1, 1, 2, 3, 9)], "content_type string, title string, body string, content_seq long")
    for r in rewrite_links(notes, df).collect():
        want = text
        for s, _, o, n in sorted(merges):
            if s > r.content_seq:
                want = want.replace(link(o), link(n))
        assert r.body == want


def test_fill_without_a_key(spark):
    r = random.Random(4)
    held = [(i, None if r.random() < 0.8 else r.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(r.sample(held, len(held)), "i int, v int").repartition(7)
    filled = forward_fill(df, "v", ["i"])
    assert "SinglePartition" not in filled._jdf.queryExecution().executedPlan().toString()
    last, want = None, []
    for i, v in held:
        last = v if v is not None else last
        want.append((i, last))
    assert sorted(map(tuple, filled.collect())) == want
    assert forward_fill(df.where("v is null"), "v", ["i"]).where("v is not null").count() == 0 and forward_fill(df.limit(0), "v", ["i"]).count() == 0
