import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from noteloom.operators.links import link_index, rewrite_linked, with_written, without, write_parts
from noteloom.operators.resolve import rewrite_links
from noteloom.sources.fetching import Asker, Manners, fetch_by_host, within
from noteloom.sources.lists import list_entries, read_long_requests
from noteloom.sources.readers import read_requests

SIGNS = ["{", "}", "[", "]", '"', "\\", ",", ":", "\n", "é", "a", " ", "{}", '\\"', "😀", " "]


def _ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    _ranges(spark, "257b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_long_list_is_read_by_ranges(spark, tmp_path, small_ranges, seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choices(SIGNS, k=r.randrange(30)))
    entries = [{text(): text(), "n": {"m": [{"k": text()}, r.random()], "o": {}}} if r.random() < 0.7 else {} for _ in range(60)]
    file = tmp_path / "list.json"
    file.write_text(json.dumps(entries, indent=r.choice([None, 1]), ensure_ascii=seed % 2 == 0), encoding="utf-8")
    found = list_entries(spark, str(file))
    assert spark.read.text(str(file), lineSep="}").rdd.getNumPartitions() > 5
    rows = sorted(found.collect(), key=lambda x: x.seq)
    assert [x.seq for x in rows] == list(range(60)) and [json.loads(x.entry) for x in rows] == entries


def test_long_list_as_the_whole_read(spark, tmp_path, small_ranges):
    entries = [{"link": f"https://x.org/{{{i}}}?q=\"]}}", "upload_date": "2024-09-04", "already_read": i % 2 == 0, "read_priority": i % 6} for i in range(40)]
    file = tmp_path / "b.json"
    file.write_text(json.dumps(entries))
    key = lambda x: x.seq
    assert sorted(read_long_requests(spark, str(file), 7).collect(), key=key) == sorted(read_requests(spark, str(file), 7).collect(), key=key)
    with pytest.raises(ValueError):
        read_long_requests(spark, str(tmp_path / "b.txt"))


@pytest.mark.parametrize(("content", "n"), [("[]", 0), ("", 0), (" [ \n ]\n", 0), ("[{}]", 1), ('[{"a": 1}, {"a": "}', 1), ("﻿[{},{}]", 2)])
def test_short_lists(spark, tmp_path, content, n):
    (tmp_path / "l.json").write_text(content, encoding="utf-8")
    assert list_entries(spark, str(tmp_path / "l.json")).count() == n


def test_list_with_other_entries(spark, tmp_path):
    (tmp_path / "l.json").write_text('[1, {"a": 2}]')
    with pytest.raises(Exception, match="no object"):
        list_entries(spark, str(tmp_path / "l.json")).collect()


def test_fetch_once_with_tries_and_a_time_limit(spark, tmp_path):
    log = str(tmp_path)

    def web():
        def get(link):
            with open(f"{log}/{os.getpid()}-{time.monotonic_ns()}", "w") as f:
                f.write(link)
            if "slow" in link:
                time.sleep(3)
            if "broken" in link:
                raise OSError("reset")
            return (503, b"") if "busy" in link else (404, b"") if "gone" in link else (200, link.encode())

        return get

    links = [("https://a.org/1", 1), ("https://a.org/1", 2), ("https://slow.org/", 3), ("https://broken.org/x", 4), ("https://busy.org/", 5), ("https://gone.org/", 6), (None, 7), ("../path", 8)]
    rows = fetch_by_host(spark.createDataFrame(links, "link string, n int"), web, Manners(timeout=0.3, tries=2, pause=0.01)).collect()
    found = {r.n: (r.status, bytes(r.body) if r.body else None, r.error, r.tries) for r in rows}
    assert len(rows) == 8 and found[1] == found[2] == (200, b"https://a.org/1", None, 1) and found[8] == (200, b"../path", None, 1)
    assert found[3] == (None, None, "TimeoutError: no answer in 0.3 s", 2) and found[4] == (None, None, "OSError: reset", 2)
    assert found[5] == (503, None, None, 2) and found[6] == (404, None, None, 1) and found[7] == (None, None, "no link", None)
    asked = [p.read_text() for p in tmp_path.iterdir()]
    assert asked.count("https://a.org/1") == 1 and asked.count("https://broken.org/x") == 2 and len(asked) == 9


def test_rate_of_a_lane():
    asker = Asker(lambda link: (200, b""), Manners(per_second=20, lanes=2))
    began = time.monotonic()
    for _ in range(4):
        asker.ask("l", ("a.org", 0))
    assert 0.3 <= time.monotonic() - began < 1
    began = time.monotonic()
    for k in range(4):
        asker.ask("l", (f"{k}.org", 0))
    assert time.monotonic() - began < 0.2


def test_within_hands_on_results_and_errors():
    assert within(1, lambda x: x + 1, 2) == within(None, lambda x: x + 1, 2) == 3
    with pytest.raises(ZeroDivisionError):
        within(1, lambda: 1 / 0)


@pytest.fixture
def vault(spark, tmp_path):
    body = F.when(F.col("id") % 500 == 0, F.concat(F.lit("[[topics/Concept/Old]] and [[topics/Concept/Old]], "), F.lit("[[topics/Concept/Other]]"))).when(F.col("id") % 2 == 0, F.concat(F.lit("[[topics/Concept/"), (F.col("id") % 7).cast("string"), F.lit("]]")))
    notes = spark.range(2000).select(F.lit("Blog post").alias("content_type"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("title"), body.alias("body"))
    return write_parts(notes, str(tmp_path / "notes"), 64)


MERGES = "content_seq long, topic_idx int, merged_type string, merged_name string, type string, name string"


def test_rewrite_reads_linked_parts_only(spark, vault):
    merges = spark.createDataFrame([(1, 0, "Concept", "Old", "Library", "New"), (2, 0, "Library", "New", "Library", "Newest"), (2, 1, None, None, "Concept", "x")], MERGES)
    changed, index = rewrite_linked(vault, link_index(vault), merges)
    whole = rewrite_links(vault, merges)
    rows = {r.title: r.body for r in changed.collect()}
    assert rows == {f"n{k}": "[[topics/Library/Newest]] and [[topics/Library/Newest]], [[topics/Concept/Other]]" for k in (0, 500, 1000, 1500)}
    assert rows == {r.title: r.body for r in whole.join(vault.select("title", F.col("body").alias("b")), "title").where("body <> b").collect()}
    assert sorted(index.collect()) == sorted(link_index(whole).select(*index.columns).collect())
    read = vault.where(F.col("part").isin([r.part for r in changed.select("part").distinct().collect()]))
    assert read.count() < 250 and "PartitionFilters: [part" in read._jdf.queryExecution().toString()


def test_index_follows_writes_and_deletions(spark, vault):
    index = link_index(vault)
    written = vault.where("title in ('n2', 'n4', 'n5')").withColumn("body", F.when(F.col("title") == "n5", "[[topics/Concept/Fresh]]"))
    after = with_written(index, written)
    state = vault.where("title not in ('n2', 'n4', 'n5')").unionByName(written)
    assert sorted(after.collect()) == sorted(link_index(state).collect())
    assert without(after, written).where("target = 'topics/Concept/Fresh'").isEmpty() and after.where("target = 'topics/Concept/Fresh'").count() == 1


def test_no_merges_and_no_notes(spark, vault):
    none = spark.createDataFrame([], MERGES)
    changed, index = rewrite_linked(vault, link_index(vault), none)
    assert changed.isEmpty() and index.count() == link_index(vault).count()
    empty = vault.where("false")
    assert link_index(empty).isEmpty() and rewrite_linked(empty, link_index(empty), none)[0].isEmpty()
