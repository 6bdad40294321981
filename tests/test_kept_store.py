"""Ingestion into a store by parts: the same notes as whole batches, an index that is right, and only parts that a batch concerns."""

import random

from pyspark.sql import functions as F

from noteloom.operators.links import link_index
from noteloom.operators.store import Parts, Store
from noteloom.plans.ingest import ingest_batch, ingest_kept
from noteloom.streaming.landing import CONTENT_ROWS, TOPIC_ROWS, ingest_kept_into, watch
from test_ingest_order import RAW, Told, merging, pages, rows

STEMS = ["Alpha line", "Alpha lines", "Beta test", "Beta tests", "Gamma/ray", "Delta wing", "Omega", "Zeta zz"]


def batch(spark, bodies, day):
    return spark.createDataFrame([(i, link, day, None, None, None) for i, link in enumerate(bodies)], RAW)


def index_rows(df):
    return sorted(map(tuple, df.select("target", "part", "content_type", "title").collect()))


def folders(store, name):
    held = store.manifest()["tables"][name]
    return {int(p): held["folders"][k] for p, k in held["parts"].items()}


def test_same_notes_as_whole_batches(spark, tmp_path):
    r = random.Random(4)
    store = Store(spark, str(tmp_path / "s"))
    topics, notes = spark.createDataFrame([], TOPIC_ROWS), spark.createDataFrame([], CONTENT_ROWS)
    merged = 0
    for k in range(3):
        bodies = {f"https://x.org/{k}/{i}": f"t{r.randrange(12)}|" + ",".join(f"Concept:{r.choice(STEMS)}" for _ in range(r.randrange(0, 3))) for i in range(7)}
        bodies[f"https://x.org/{k}/none"] = "only a title"  # its topics raise: a failure
        raw = batch(spark, bodies, f"2024-09-{k + 1:02d}")
        topics, notes, failed = (spark.createDataFrame(df.collect(), df.schema) for df in ingest_batch(raw, topics, notes, pages(bodies), merging, Told))
        assert ingest_kept(store, raw, pages(bodies), merging, Told, source="a", batch=k, parts=8 if k == 0 else 5)
        assert not ingest_kept(store, raw, pages(bodies), merging, Told, source="a", batch=k)
        assert rows(store.read("topics").drop("part")) == rows(topics)
        assert rows(store.read("contents").drop("part")) == rows(notes)
        assert index_rows(store.read("links")) == index_rows(link_index(store.read("contents")))
        assert rows(store.read("failures").where(F.col("version") == k + 1).select("seq", "link", "reason")) == rows(failed.withColumn("seq", F.col("seq").cast("long")))
        merged += "Joint" in str(rows(topics))
    assert merged and store.read("failures").count() == 3
    assert store.parts_of("contents") == 8
    store.vacuum()
    assert rows(store.read("contents").drop("part")) == rows(notes)


def test_only_parts_of_linked_notes(spark, tmp_path):
    """A merge of a topic that two of 200 notes link to writes their parts and the new note's anew, and reads no other part of contents."""
    store = Store(spark, str(tmp_path / "s"))
    bodies = {f"https://x.org/{i}": f"n{i}|Concept:{'Rare' if i in (3, 150) else 'Common thing'}" for i in range(200)}
    none = lambda: lambda new, old: None
    ingest_kept(store, batch(spark, bodies, "2024-09-01"), pages(bodies), none, Told, parts=64)
    before = {name: folders(store, name) for name in ("contents", "links", "topics")}
    asked = []

    class Watched(Store):
        def read(self, name, schema=None, parts=None):
            asked.append((name, parts))
            return super().read(name, schema, parts)

    again = {"https://x.org/new": "n999|Concept:Rares"}
    judge = lambda: lambda new, old: {"type": "Library", "name": "Seldom", "description": "d"} if old["name"] == "Rare" else None
    ingest_kept(Watched(spark, store.path), batch(spark, again, "2024-09-02"), pages(again), judge, Told)
    parts = {(r.title, r.part) for r in store.read("contents").where("title in ('n3', 'n150', 'n999')").select("title", "part").collect()}
    assert len(parts) == 3
    expected = {p for _, p in parts}
    assert [set(p) for name, p in asked if name == "contents"] == [expected]
    after = folders(store, "contents")
    assert {p for p in after if after[p] != before["contents"].get(p)} == expected
    links = folders(store, "links")
    assert len({p for p in {*links, *before["links"]} if links.get(p) != before["links"].get(p)}) <= 2  # what was linked to, and what is now
    assert store.read("links").where("target = 'topics/Library/Seldom'").count() == 3
    assert store.read("links").where("target = 'topics/Concept/Rare'").count() == 0


def test_parts_that_empty_and_broken_commits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    table = spark.createDataFrame([(i, i % 3) for i in range(9)], "v int, p int")
    store.commit({}, parts={"t": Parts(table, "p", [0, 1, 2], 3)})
    store.commit({}, parts={"t": Parts(table.where("v > 100"), "p", [1], 3)})
    assert sorted(r.v for r in store.read("t").collect()) == [0, 2, 3, 5, 6, 8]
    assert [r.v for r in store.read("t", parts=[1, 7]).collect()] == []
    broken = table.withColumn("v", F.expr("raise_error('stop')").cast("int"))
    try:
        store.commit({}, parts={"t": Parts(broken, "p", [0], 3)})
        raise AssertionError("no error")
    except Exception as e:
        assert "stop" in str(e)
    assert sorted(r.v for r in store.read("t").collect()) == [0, 2, 3, 5, 6, 8]


def test_stream_into_parts(spark, tmp_path):
    store, told = Store(spark, str(tmp_path / "s")), []
    bodies = {f"https://x.org/{i}": f"s{i}|Concept:Omega" for i in range(4)}
    landing = tmp_path / "landing"
    batch(spark, bodies, "2024-09-01").drop("seq").repartition(2).write.json(str(landing))

    def ingest(store, requests, source, number):
        done = ingest_kept(store, requests, pages(bodies), lambda: lambda new, old: None, Told, source=source, batch=number, parts=4)
        told.append(number)
        if len(told) == 1:
            raise RuntimeError("stopped after the commit")
        return done

    handle = ingest_kept_into(store, ingest)
    for _ in range(2):
        try:
            watch(spark, str(landing), str(tmp_path / "c"), handle, validated=False).awaitTermination(300)
        except Exception as e:
            assert "stopped after the commit" in str(e)
    assert sorted(r.title for r in store.read("contents").collect()) == ["s0", "s1", "s2", "s3"]
    assert store.manifest()["version"] == 1 and told == [0]
