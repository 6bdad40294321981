"""Phrase collocation mining with merged count-min sketches.

1. Each task counts the words and phrases of its texts in a count-min sketch, by language; the sketches are merged by slices of cells.
   Cells stop at the least count asked for, so one byte each is enough and merging loses nothing that matters: a phrase's cells hold at least
   the smaller of its count and that.
2. The cells that reached it, a bit each, go to all tasks, which aggregate exactly those words and phrases whose every cell
   is marked, and the number of all words. The sketch only overestimates, so that nothing frequent is lost; what it lets through too much falls to its exact count.
3. Of phrases inside longer ones, those that the longer ones cover go; the parts of the others' cuts are looked up by key; scores are whole numbers
   from exact decimals. Each task gives its best of each language, which are ranked together.

A sketch has about a cell for each 16 bytes of text, within bounds that fit into a task (SMALLEST, LARGEST cells a row): beyond them more
phrases come through to the exact count, up to all of them, and results stay the same. What is sent to all tasks is at most
DEPTH * LARGEST / 8 bytes.

A-Z count as a-z. Null and empty texts have no words, a null lang is `und`. Repeated rows and ids count each: nothing here looks at ids. Equal scores
go by count, then phrase. Words of any length are taken whole. An empty table gives an empty result. Counts up to 10 ** 15 keep every
decimal within 38 digits.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_blocks, free_shuffles, materialize, only, table, tidied

LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
UNKNOWN = "und"
DEPTH = 2
#: Cells of a row: a power of two, from the input's bytes within these bounds.
SMALLEST, LARGEST = 1 << 16, 1 << 26
BYTES_A_CELL = 16
#: Cells of a slice: what is merged at a time.
SLICE = 1 << 16
#: Bytes of text counted at once.
BLOCK = 1 << 22
#: Counts that a task adds up before it gives them, and bytes of text for each bucket of counts.
HELD, BUCKET = 1 << 22, 1 << 23

_SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Phrases:
    """The phrases of some texts of one language: numbers for words, and for each length the distinct phrases with their counts."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts).translate(_SMALL).replace(b"\n", b" \n ")
        tokens = joined.split(b" ")
        codes, words = pd.factorize(np.array([t for t in tokens if t], object))
        self.words: list[bytes] = list(words)
        edge = self.words.index(b"\n") if b"\n" in self.words else -1
        self.codes = codes
        self.inner = codes != edge
        self.counts = np.bincount(codes, minlength=len(self.words))
        if edge >= 0:
            self.counts[edge] = 0
        self.hashes: np.ndarray | None = None

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct phrases of n words, as rows of word numbers, and their counts. Numbers are packed into 64 bits, exactly."""
        m = len(self.codes) - n + 1
        if m <= 0:
            return np.zeros((0, n), np.int64), np.zeros(0, np.int64)
        inner = self.inner[:m].copy()
        for i in range(1, n):
            inner &= self.inner[i : i + m]
        starts = np.flatnonzero(inner)
        bits = max(1, int(len(self.words) - 1).bit_length())
        if bits * n > 63:  # by halves: the first words' numbers are counted anew
            key = self.codes[starts].astype(np.int64)
            for i in range(1, n):
                key = np.unique(key, return_inverse=True)[1].astype(np.int64) * len(self.words) + self.codes[starts + i]
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            return np.stack([self.codes[starts[first] + i] for i in range(n)], 1), counts
        key = np.zeros(len(starts), np.int64)
        for i in range(n):
            key = (key << bits) | self.codes[starts + i]
        key.sort()
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        counts = np.diff(np.append(first, len(key)))
        key = key[first]
        return np.stack([(key >> (bits * (n - 1 - i))) & ((1 << bits) - 1) for i in range(n)], 1), counts

    def cells(self, rows: np.ndarray, lang: str, cells: int) -> Iterator[np.ndarray]:
        """For each row of the sketch the cells of phrases."""
        if self.hashes is None:
            seed = xxhash.xxh64_intdigest(lang.encode())
            self.hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], U64)
        hashed = np.full(len(rows), rows.shape[1], U64)
        for i in range(rows.shape[1]):
            hashed = mix(hashed * U64(0x9E3779B97F4A7C15) + self.hashes[rows[:, i]])
        for d in range(DEPTH):
            yield (hashed >> U64(32 * (d % 2))).astype(np.int64) & (cells - 1) if d < 2 else mix(hashed + U64(d)).astype(np.int64) & (cells - 1)

    def phrase(self, row: np.ndarray) -> bytes:
        return b" ".join(self.words[c] for c in row)


class Sketch:
    """DEPTH rows of cells that count up to `least`."""

    def __init__(self, cells: int, least: int):
        if not 0 < least < 256:
            raise ValueError("cells have one byte")
        self.least, self.rows = least, np.zeros((DEPTH, cells), np.uint8)

    def add(self, d: int, cells: np.ndarray, counts: np.ndarray) -> None:
        packed = (cells << 8) | np.minimum(counts, self.least)
        packed.sort()
        at = packed >> 8
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
        if len(first):
            sums = np.add.reduceat(packed & 255, first) + self.rows[d, at[first]]
            self.rows[d, at[first]] = np.minimum(sums, self.least)

    def slices(self) -> Iterator[tuple[int, bytes]]:
        """What is not empty, packed: number of a slice (rows one after the other) and its cells."""
        pack = zstandard.ZstdCompressor(level=1)
        flat = self.rows.reshape(-1, min(SLICE, self.rows.shape[1]))
        for i in np.flatnonzero(flat.any(1)):
            yield int(i), pack.compress(flat[i].tobytes())


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Phrases]]:
    """Phrases of blocks of texts, each of one language; texts wait until a language has a block of them."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for batch, texts in byte_blocks(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            held[lang].append(text)
            size[lang] += len(text) + 1
            if size[lang] >= BLOCK or len(held) > 64 and sum(size.values()) >= 4 * BLOCK:
                for name in [lang] if size[lang] >= BLOCK else list(held):
                    yield name, Phrases(held.pop(name))
                    del size[name]
    for lang in list(held):
        yield lang, Phrases(held.pop(lang))


def sketched(documents: DataFrame, cells: int, least: int, longest: int) -> np.ndarray:
    """Of the merged sketch of all documents' phrases, the cells that reached the least count, a bit each (rows of the sketch one after the other)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(cells, least)
        for lang, found in by_language(batches):
            for n in range(1, longest + 1):
                rows, counts = found.of(n)
                for d, places in enumerate(found.cells(rows, lang, cells)):
                    sketch.add(d, places, counts)
        held: list[tuple[int, bytes]] = []
        for part in sketch.slices():
            held.append(part)
            if len(held) == 64:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                part = np.frombuffer(unpack.decompress(raw), np.uint8)
                merged[i] = np.minimum(merged[i].astype(np.int16) + part, least).astype(np.uint8) if i in merged else part
        full = [(i, np.packbits(part >= least, bitorder="little").tobytes()) for i, part in merged.items() if (part >= least).any()]
        if full:
            yield packed(full)

    schema = "slice int, cells binary"
    bits = np.zeros(DEPTH * cells // 8, np.uint8)
    width = min(SLICE, cells) // 8
    # a task merges its slices one batch after the other, in the room of the slices themselves; what is collected is as large as bits at most
    for r in documents.mapInArrow(count, schema).repartition(F.col("slice")).mapInArrow(merge, schema).collect():
        bits[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.cells, np.uint8)
    return bits


def packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["slice", "cells"])


def counted(documents: DataFrame, bits: np.ndarray, cells: int, longest: int, least: int, buckets: int) -> DataFrame:
    """lang, n_words, phrase, f: exact counts of the words and phrases whose cells are all marked, if they reach the least count; with n_words 0, of all words together.

    A task adds up what it has and gives it by buckets of phrases, each in sorted order and packed; a bucket is as much as so many bytes of text have, whatever the size of the input.
    """
    sent = documents.sparkSession.sparkContext.broadcast(bits)
    schema = "lang string, n_words int, bucket long, phrases binary, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = sent.value
        held: dict[tuple[str, int], list[pa.Table]] = defaultdict(list)
        waiting = 0
        for lang, found in by_language(batches):
            held[lang, 0].append(sums([b""], found.counts.sum(keepdims=True)))
            for n in range(1, longest + 1):
                rows, counts = found.of(n)
                alive = np.arange(len(rows))
                for d, places in enumerate(found.cells(rows, lang, cells)):
                    at = places[alive] + d * cells
                    alive = alive[(marked[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                held[lang, n].append(sums([found.phrase(rows[i]) for i in alive], counts[alive]))
                waiting += len(alive)
            if waiting > HELD:
                held = defaultdict(list, {key: [added(parts)] for key, parts in held.items()})
                waiting = sum(parts[0].num_rows for parts in held.values())
                if waiting > HELD // 2:
                    yield from dealt(held, buckets)
                    held, waiting = defaultdict(list), 0
        yield from dealt(held, buckets)

    def merge(found: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        parts = [sums(unpack.decompress(p).split(b"\n"), np.frombuffer(unpack.decompress(c), np.int64)) for p, c in zip(found.column("phrases").to_pylist(), found.column("counts").to_pylist(), strict=True)]
        lang, n, whole = found.column("lang")[0].as_py(), found.column("n_words")[0].as_py(), added(parts)
        if n:
            whole = whole.filter(pc.greater_equal(whole.column("f"), least))
        columns = [pa.array([lang] * whole.num_rows, pa.string()), pa.array(np.full(whole.num_rows, n, np.int32)), whole.column("phrase").cast(pa.string()), whole.column("f")]
        return pa.table(dict(zip(("lang", "n_words", "phrase", "f"), columns, strict=True)))

    return documents.mapInArrow(count, schema).groupBy("lang", "n_words", "bucket").applyInArrow(merge, "lang string, n_words int, phrase string, f long")


def sums(names: list[bytes], counts: np.ndarray) -> pa.Table:
    return pa.table({"phrase": pa.array(names, pa.binary()), "f": pa.array(counts.astype(np.int64))})


def added(parts: list[pa.Table]) -> pa.Table:
    """Tables of counts as one, with each phrase once."""
    found = pa.concat_tables(parts).group_by("phrase").aggregate([("f", "sum")])
    return pa.table({"phrase": found.column("phrase"), "f": found.column("f_sum")})


def dealt(held: dict[tuple[str, int], list[pa.Table]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts by buckets of phrases: sorted, so that they pack well."""
    pack = zstandard.ZstdCompressor(level=3)
    for (lang, n), parts in held.items():
        whole = added(parts).sort_by("phrase")
        names, counts = whole.column("phrase").to_pylist(), whole.column("f").to_numpy()
        of = (pd.util.hash_array(np.array(names, object), categorize=False) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        ends = np.flatnonzero(np.diff(of[order], append=-1)) + 1
        rows: list[tuple] = []
        for begin, end in zip(np.concatenate(([0], ends[:-1])), ends, strict=True) if len(order) else ():
            own = order[begin:end]
            rows.append((lang, n, int(of[own[0]]), pack.compress(b"\n".join(names[i] for i in own)), pack.compress(counts[own].tobytes())))
            if len(rows) == 256:
                yield counted_rows(rows)
                rows = []
        if rows:
            yield counted_rows(rows)


def counted_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "n_words", "bucket", "phrases", "counts"])


def best_of_tasks(scored: DataFrame, top: int) -> DataFrame:
    """Each task's first `top` rows of each language: all that can be among the first of all, and bounded for the task that ranks a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if held is None else pa.concat_tables([held, rows])).sort_by([("lang", "ascending"), ("score", "descending"), ("a", "descending"), ("phrase", "ascending")])
            lang = pd.Series(rows.column("lang").to_pylist(), dtype=object)
            held = rows.filter(pa.array((lang.groupby(lang).cumcount() < top).to_numpy(bool))).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return scored.mapInArrow(run, scored.schema)


def mine_phrases(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int | None = TOP) -> DataFrame:
    """documents (lang, text): lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to `longest` words.

    Candidates occur `least` times or more; those inside a longer candidate with at least `covered` percent of their count go. top: how many a language; None: all.
    """
    return tidied("phrases", lambda: _mined(documents, longest, least, covered, top))


def _mined(documents: DataFrame, longest: int, least: int, covered: int, top: int | None) -> DataFrame:
    docs = only(documents, lang="string", text="string").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    cells = min(LARGEST, max(SMALLEST, 1 << (size // BYTES_A_CELL).bit_length()))
    marked = sketched(docs, cells, least, longest)
    free_shuffles(docs.sparkSession)
    counts = materialize(counted(docs, marked, cells, longest, least, 1 + size // BUCKET), "phrase-counts")
    free_shuffles(docs.sparkSession)
    total = counts.where("n_words = 0 and f > 0").select("lang", F.col("f").alias("n"))
    of_length = {n: counts.where(F.col("n_words") == n).select("lang", "phrase", "f") for n in range(1, longest + 1)}
    of_length[1] = materialize(of_length[1], "word-counts")  # apart, so that Spark sees its size: below its limit it goes to all tasks
    words = F.split("phrase", " ", -1)

    def piece(first: int, n: int) -> Column:
        return F.array_join(F.slice(words, first, n), " ")

    def asked(rows: DataFrame, first: int, n: int, name: str) -> DataFrame:
        """rows with the count of n of the phrase's words, from the first one."""
        known = of_length[n].select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))
        return rows.withColumn("_piece", piece(first, n)).join(known, (F.col("lang") == F.col("_lang")) & (F.col("_piece") == F.col("_part"))).drop("_lang", "_part", "_piece")

    big = "cast({} as decimal(16, 0))"
    parts = []
    for n in range(2, longest + 1):
        rows = of_length[n].withColumnRenamed("f", "a")
        inside = [of_length[m].select("lang", piece(i, n).alias("phrase"), "f") for m in range(n + 1, longest + 1) for i in range(1, m - n + 2)]
        if inside:
            longer = reduce(DataFrame.unionAll, inside).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
            rows = rows.join(longer, ["lang", "phrase"], "left").where(~(100 * F.coalesce("longer", F.lit(0)) >= covered * F.col("a"))).drop("longer")
        for first, m, name in sorted([(1, k, f"l{k}") for k in range(1, n)] + [(k + 1, n - k, f"r{k}") for k in range(1, n)], key=lambda x: x[1]):
            rows = asked(rows, first, m, name)
        cuts = [F.struct(F.expr(f"(1000000 * {big.format('a')} * {big.format('a')}) div ({big.format(f'l{k}')} * {big.format(f'r{k}')})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, n)]
        parts.append(rows.select("lang", "phrase", "a", (F.least(*cuts) if n > 2 else cuts[0]).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    scored = reduce(DataFrame.unionAll, parts)
    if top is not None:
        # twice, the second time by as many tasks as the root of the first: the task that ranks a language gets the square root's rows
        tasks = math.ceil(math.sqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        scored = best_of_tasks(best_of_tasks(scored, top).repartition(tasks, "phrase"), top)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    # as many rows as languages
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op12_phrases": op12}
ORACLES = {
    "op12_phrases": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT row_number() OVER () AS r, lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
u AS (SELECT r, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM w),
z AS MATERIALIZED (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS g FROM z UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM z WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM z WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
e AS (SELECT lang, g, k, a, w, unnest(range(1, k)) AS cut FROM c),
t AS MATERIALIZED (SELECT lang, g, a, cut, array_to_string(w[:cut], ' ') AS p, array_to_string(w[cut + 1:], ' ') AS q FROM e),
s AS (SELECT t.lang, t.g, a, cut, x.f AS l, y.f AS r, CAST((1000000 * a::HUGEINT * a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score FROM t
 JOIN f x ON x.lang = t.lang AND x.g = t.p JOIN f y ON y.lang = t.lang AND y.g = t.q),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS z FROM s),
h AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank, b.g AS phrase, a, l, r, score FROM b LEFT JOIN h ON h.lang = b.lang AND h.g = b.g WHERE z = 1 AND NOT coalesce(100 * longer >= 50 * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
}
