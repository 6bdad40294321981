"""What large groups repeat comes back as a row a document, not as one for each place."""

import random

import numpy as np
from test_brute_force import repeated_bytes

from noteloom.llm import suffixes


def test_a_row_a_document(spark, monkeypatch):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["und", "été", "the", "of"]) + str(r.randrange(90)) for _ in range(n))
    passage = say(150)
    texts = [f"{say(r.randrange(9))} {passage} {say(5)} {passage} {say(r.randrange(9))}" for _ in range(60)]
    docs = suffixes.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    split, seen = suffixes.split_groups, []

    def kept(fragments, n, g):
        rest, runs = split(fragments, n, g)
        seen.append(runs)
        return rest, runs

    monkeypatch.setattr(suffixes, "split_groups", kept)
    monkeypatch.setattr(suffixes, "tidied", lambda label, make: make())
    found = {x.k1: suffixes.merged(x.runs) for x in suffixes.repeated_runs(docs, 120, group=10).collect()}
    assert [found[i] for i in range(60)] == repeated_bytes([t.encode() for t in texts], 120)
    assert 0 < seen[0].count() <= 60 == seen[0].select("k1").distinct().count()


def test_united():
    r = np.random.default_rng(2)
    for n in (0, 1, 7, 300):
        k1, k2, start = r.integers(-3, 3, n), r.integers(0, 2, n), r.integers(0, 400, n)
        end = start + r.integers(1, 9, n)
        got = list(zip(*(x.tolist() for x in suffixes.united(k1, k2, start, end)), strict=True))
        wanted = []
        for key in sorted(set(zip(k1.tolist(), k2.tolist(), strict=True))):
            runs = [{"start": a, "end": b} for x, y, a, b in zip(*map(np.ndarray.tolist, (k1, k2, start, end)), strict=True) if (x, y) == key]
            wanted += [(*key, a, b) for a, b in suffixes.merged(runs)]
        assert got == wanted


def test_lists_of_several_batches(spark):
    places = [[(d, 7, 10 * i, 10 * i + 12 - d) for i in range(d, 40, 3)] for d in range(6)] + [[(2, 7, 5, 25), (3, 8, 0, 1)], []]
    df = spark.createDataFrame([(x,) for x in places], "places array<struct<k1: long, k2: long, start: long, end: long>>").repartition(3)
    rows = suffixes.document_runs(df, sum(map(len, places)), 9).collect()
    got = {(x.k1, x.k2): suffixes.merged(x.runs) for x in rows}
    flat = [p for x in places for p in x]
    assert len(rows) == len(got) == 7
    assert got == {(a, b): suffixes.merged([{"start": s, "end": e} for k, q, s, e in flat if (k, q) == (a, b)]) for a, b, _, _ in flat}
