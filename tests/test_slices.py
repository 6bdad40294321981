"""Batches are worked on in slices: results are whole, and only a slice's rows are Python objects at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from noteloom.functions.batches import SLICE_BYTES, SLICE_ROWS, slices
from noteloom.sources.fetching import Manners, fetch_by_host


def test_slices_are_whole_and_bounded():
    short, long = pa.array(range(1234)), pa.array(["x" * (SLICE_BYTES // 4)] * 10)
    assert pa.concat_arrays(slices(short)).equals(short) and max(map(len, slices(short))) == SLICE_ROWS
    assert pa.concat_arrays(slices(long)).equals(long) and max(map(len, slices(long))) <= 4
    assert list(slices(pa.array([], pa.string()))) == []


def web():
    alive = [0]

    class Body(bytes):
        def __del__(self):
            alive[0] -= 1

    def get(link):
        alive[0] += 1
        return 200, Body(b"%d" % alive[0])

    return get


def test_few_bodies_are_held(spark):
    links = spark.range(3000).select(F.concat(F.lit("http://one.org/"), F.col("id")).alias("link"))
    held = [int(r.body) for r in fetch_by_host(links, web, Manners(lanes=1)).collect()]
    assert len(held) == 3000 and max(held) <= SLICE_ROWS + 1
