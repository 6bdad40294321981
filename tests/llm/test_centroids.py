"""Clusters against plain loops over all centroids, odd vectors, and what the annulus leaves out."""

import hashlib
import random

import numpy as np
import pytest

from noteloom.llm import centroids as c

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster string"


def plain(rows, clusters=16, rounds=3, dimensions=64):
    kept = [(i, [int(np.floor(64 * np.float32(x).astype(float))) for x in e]) for i, e, *_ in rows if e is not None and len(e) == dimensions and all(x is not None and np.isfinite(x) for x in e)]
    known = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middle = [v for _, v in known] + sorted(v for i, v in kept if i is None)
    middle = middle[:clusters]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(middle)):
            own = [v for (_, v), (_, j) in zip(kept, found, strict=True) if j == k]
            if own:
                middle[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    inertia = [sum(d for d, j in found if j == k) for k in range(len(middle))]
    return sorted(((i, k, d, inertia[k], sum(inertia), hashlib.sha256(",".join(map(str, middle[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, found, strict=True)), key=repr)


def vectors(n, seed, dimensions=64):
    r = random.Random(seed)
    return [[round(r.gauss(0, 0.2), 3) for _ in range(dimensions)] for _ in range(n)]


def clustered(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "v", "c") if len(r) == 2 else r for r in rows], SCHEMA)
    return sorted((tuple(r) for r in c.cluster_vectors(df, **options).collect()), key=repr)


def test_against_plain_loops(spark):
    found = vectors(90, 3)
    odd = [None, [], found[0][:63], [*found[0], 0.1], [None, *found[0][1:]], [float("nan"), *found[0][1:]], [float("inf"), *found[0][1:]]]
    rows = [(i, e) for i, e in enumerate([*found, *odd])] + [(5, found[5]), (5, found[6]), (None, found[7]), (None, found[7]), (-4, found[0])] + [(1000 + i, [0.25] * 64) for i in range(40)]
    assert clustered(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(None, [0.5] * 64)], [(i, [0.5] * 64) for i in range(40)], [(i, [float(i)] + [0.0] * 63) for i in range(7)]])
def test_few_rows(spark, rows):
    assert clustered(spark, rows) == plain(rows)


def test_ties_go_to_the_smaller_number():
    middle = np.array([[0, 4], [4, 0], [0, -4], [-4, 0], [4, 0]], np.int64)
    search = c.Annulus(middle)
    for last in range(5):
        found, squared = search.nearest(np.array([[0, 0], [4, 4], [5, 0]], np.int64), np.full(3, last))
        assert found.tolist() == [0, 0, 1] and squared.tolist() == [16, 16, 1]


def test_annulus_leaves_centroids_out():
    r = np.random.default_rng(1)
    middle = np.unique(r.integers(-900, 900, (400, 1)) * r.integers(0, 3, (400, 8)), axis=0).astype(np.int64)
    x = middle[r.integers(0, len(middle), 3000)] + r.integers(-9, 10, (3000, 8))
    every = ((x[:, None] - middle) ** 2).sum(2)
    search = c.Annulus(middle)
    near = np.argsort(every, 1)[:, 3]  # a near one, as the last round's is
    found, squared = search.nearest(x, near)
    assert (found == every.argmin(1)).all() and (squared == every.min(1)).all()
    assert search.compared < every.size / 2


def test_large_components(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] + [0.0] * 63) for i in range(20)]
    assert {r[2] for r in clustered(spark, rows)} == {0}
