import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noteloom.sources import vault as v

FILES = "path string, content binary, keep boolean, seq long"


def state(vault):
    return {str(p.relative_to(vault)): p.read_bytes() for p in Path(vault).rglob("*") if p.is_file()}


def test_files_there_and_back(spark, tmp_path):
    rows = [(f"topics/Concept/n: {k} é.md", f"text {k}".encode(), False, 0) for k in range(25)] + [("empty", b"", True, 0)]
    v.write_vault(spark.createDataFrame(rows, FILES), str(tmp_path))
    assert state(tmp_path) == {r[0]: r[1] for r in rows}
    read = v.read_vault(spark, str(tmp_path), files=4)
    assert read.rdd.getNumPartitions() == 7 and {r.path: bytes(r.content) for r in read.collect()} == {r[0]: r[1] for r in rows}
    assert v.read_vault(spark, str(tmp_path), "topics/*/*3*.md").count() == 3
    assert v.read_vault(spark, str(tmp_path), "none/*").isEmpty()


def test_one_file_for_each_path(spark, tmp_path):
    for name in ("stays", "goes", "anew"):
        (tmp_path / name).write_text("old")
    rows = [("a", b"1", False, 1), ("a", b"3", False, 3), ("a", b"2", False, 2), ("k", b"1", True, 1), ("k", b"2", True, 2), ("stays", b"new", True, 0), ("goes", None, False, 0), ("never", None, False, 0), ("anew", None, False, 0), ("anew", b"new", True, 5)]
    v.write_vault(spark.createDataFrame(rows, FILES), str(tmp_path))
    assert state(tmp_path) == {"a": b"3", "k": b"1", "stays": b"old", "anew": b"new"}
    v.write_vault(spark.createDataFrame([], FILES), str(tmp_path))
    assert len(state(tmp_path)) == 4


@pytest.mark.parametrize("path", ["../out", "/out", "", ".ready/x", "a/../../b"])
def test_a_failing_task_leaves_no_file(spark, tmp_path, path):
    (tmp_path / "there").write_text("old")
    rows = spark.range(40).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.encode(F.lit("x"), "UTF-8").alias("content"), F.lit(False).alias("keep"), F.col("id").alias("seq"))
    bad = spark.createDataFrame([(path, b"x", False, 0), ("there", None, False, 0)], FILES)
    with pytest.raises(Exception, match="no path within the vault"):
        v.write_vault(rows.unionByName(bad), str(tmp_path))
    assert state(tmp_path) == {"there": b"old"}


def test_a_broken_commit_is_brought_to_an_end(spark, tmp_path, monkeypatch):
    (tmp_path / "gone").write_text("old")
    writer = v.Writer({"path": str(tmp_path)})
    row = lambda path, content, keep=False: type("Row", (), {"path": path, "content": content, "keep": keep})
    parts = [writer.write(iter([row("a", b"1"), row("gone", None)])), writer.write(iter([row("x/b", b"2", True), row("c", b"3")]))]
    writer.write(iter([row("given up", b"4")]))
    real, calls = os.replace, []

    def replace(a, b):
        calls.append(b)
        if len(calls) == 3:
            raise OSError("power off")
        real(a, b)

    monkeypatch.setattr(os, "replace", replace)
    with pytest.raises(OSError):
        writer.commit(parts)
    monkeypatch.undo()
    other = v.Writer({"path": str(tmp_path)})
    other.write(iter([row("never", b"5")]))
    assert v.recover(str(tmp_path)) == 1 and v.recover(str(tmp_path)) == 0
    assert state(tmp_path) == {"a": b"1", "x/b": b"2", "c": b"3"}


def test_abort_leaves_nothing(tmp_path):
    writer = v.Writer({"path": str(tmp_path)})
    done = writer.write(iter([type("Row", (), {"path": "a", "content": b"1", "keep": False})]))
    writer.abort([done, None])
    assert state(tmp_path) == {}


def test_batch_in_one_commit(spark, tmp_path):
    from noteloom.sources.readers import read_notes

    topics = spark.createDataFrame([("Concept", "a/b", "2024-09-04", "new"), ("Library", "Spark", "2024-09-04", "new")], "type string, name string, date string, description string")
    contents = spark.createDataFrame([("Blog post", "T", "https://x.org/", "2024-09-04", False, 1, None, ["x"], "body")], "content_type string, title string, link string, upload_date string, already_read boolean, read_priority int, source string, tags array<string>, body string")
    merged = spark.createDataFrame([("Concept", "Old")], "type string, name string")
    failed = spark.createDataFrame([(2, "l2", "r2"), (1, "l1", None)], "seq int, link string, reason string")
    for name, text in (("topics/Concept/Old.md", "old"), ("topics/Library/Spark.md", "---\ndate: d\n---\n\nold"), ("contents/Blog post/T.md", "old")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    v.save_batch(str(tmp_path), topics, contents, merged, failed)
    assert (tmp_path / "failed" / "000000000.json").read_text() == '{"link":"l1"}\n{"link":"l2","reason":"r2"}'
    notes = {(r.type, r.name): (r.meta, r.body) for d in ("topics", "contents") for r in read_notes(spark, str(tmp_path), d).collect()}
    assert notes == {
        ("Concept", "a b"): ({"date": "2024-09-04", "type": "Concept"}, "new"), ("Library", "Spark"): ({"date": "d"}, "old"),
        ("Blog post", "T"): ({"link": "https://x.org/", "upload_date": "2024-09-04", "already_read": "false", "read_priority": "1", "tags": '["x"]', "type": "Content"}, "body"),
    }
    v.save_batch(str(tmp_path), topics.limit(0), contents.limit(0), merged, failed.limit(0))
    assert len(state(tmp_path)) == 4
