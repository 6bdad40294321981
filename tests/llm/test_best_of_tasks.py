import random

import pytest

from noteloom.llm.phrases import added, best_of_tasks, dealt, mine_phrases, sums


@pytest.mark.parametrize("top", [1, 3, 50])
def test_best_of_tasks_keeps_what_can_be_first(spark, top):
    r = random.Random(top)
    rows = [(r.choice(["de", "en"]), f"p{k:03}", r.randrange(3), 1, 1, r.randrange(4)) for k in range(300)]
    table = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, score long").repartition(5)
    kept = best_of_tasks(best_of_tasks(table, top).repartition(2, "phrase"), top).collect()
    order = lambda x: (-x[5], -x[2], x[1])
    for lang in ("de", "en"):
        want = sorted((x for x in rows if x[0] == lang), key=order)[:top]
        got = sorted((tuple(x) for x in kept if x.lang == lang), key=order)
        assert got[:top] == want and len(got) <= 2 * top
    assert best_of_tasks(table.where("false"), top).isEmpty()


def test_counts_by_buckets_lose_nothing():
    import numpy as np
    import zstandard

    names = [f"w{k} é".encode() for k in range(700)]
    held = {("de", 2): [sums(names, np.arange(700)), sums(names[:50], np.ones(50))], ("en", 0): [sums([b""], np.array([9]))]}
    found, unpack = {}, zstandard.ZstdDecompressor()
    for batch in dealt(held, 300):
        for row in batch.to_pylist():
            for name, count in zip(unpack.decompress(row["phrases"]).split(b"\n"), np.frombuffer(unpack.decompress(row["counts"]), np.int64), strict=True):
                assert (row["lang"], name) not in found
                found[row["lang"], name] = int(count)
    assert found == {("de", n): k + (k < 50) for k, n in enumerate(names)} | {("en", b""): 9}
    assert added([sums([b"a", b"b"], np.array([1, 2])), sums([b"a"], np.array([5]))]).sort_by("phrase").to_pydict() == {"phrase": [b"a", b"b"], "f": [6, 2]}


def test_counts_that_do_not_fit_are_given_early(spark, monkeypatch):
    texts = [(None if k % 9 == 0 else "de", f"alpha beta gamma delta {k % 5} alpha beta") for k in range(200)]
    table = spark.createDataFrame(texts, "lang string, text string")
    want = sorted(map(tuple, mine_phrases(table).collect()))
    assert want
    monkeypatch.setattr("noteloom.llm.phrases.HELD", 2)
    assert sorted(map(tuple, mine_phrases(table).collect())) == want
