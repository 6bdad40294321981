"""Exact top-k inner-product search with vector-approximation files.

A block of vectors is quantised into cells; a scan of the cells alone gives each vector's highest possible score.
Exact vectors are then taken in falling order of that bound until no other vector can reach the kth score. Cells and
exact vectors come from one scan of the table: many queries are asked at once, so that every block holds vectors that
one of them must look at, and a file of cells apart would only be read besides. What the cells save is exact products.
Equal vectors of a block are looked at up to k + 1 ids, as no query needs more of them: ties go to the smaller id.

Components x become floor(1024 x). Vectors that are null, or hold a null or non-finite component, and null ids take
no part; vectors of another length than the query's are no candidates. Ties go to the smaller id. Repeated rows are
candidates each; a query id given twice is asked once, with its least vector; all rows with the query's id are left
out. Scores beyond 64 bits are clipped. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, only, table

SCALE = 1024
#: Bytes of query vectors that one pass broadcasts at most; more queries take more passes, one after the other.
PASS_BYTES = 16 << 20
#: Bytes of bounds (vectors x queries) that are held at once at most.
BOUND_BYTES = 32 << 20
BLOCK_ROWS = 4096
CELL_BITS = 6
EXACT = 1 << 53


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -(2.0**62), 2.0**62).astype(np.int64)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products, clipped to 64 bits."""
    if len(vectors) == 0 or float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query)) < EXACT:
        return vectors @ query
    exact = vectors.astype(object) @ query.astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in exact], np.int64)


class ApproximationFile:
    """Cells of a block of whole-number vectors, and bounds for their scores."""

    def __init__(self, vectors: np.ndarray, bits: int = CELL_BITS):
        self.low = vectors.min(0)
        spread = vectors.max(0) - self.low
        self.width = spread // (1 << bits) + 1
        self.cells = ((vectors - self.low) // self.width).astype(np.uint8)

    def twice_bounds(self, queries: np.ndarray) -> np.ndarray:
        """Twice the highest score that any vector of a cell can have; rows: vectors, columns: queries."""
        low = self.low + self.cells * self.width
        middle = (2 * low + self.width - 1).astype(np.float64)
        q = queries.astype(np.float64)
        bounds = middle @ q.T + np.abs(q) @ (self.width - 1).astype(np.float64)
        worst = np.abs(middle).max(initial=0) * np.abs(q).max(initial=0) * max(1, middle.shape[1])
        return bounds if worst < EXACT else bounds + np.abs(bounds).max(initial=0) * 1e-9  # float sums are then no longer exact


class Best:
    """The best k of one query so far."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def worst(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, ~scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def without_needless_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the k + 1 least ids, and of rows that are equal in id too k: more can't be in anyone's best k, whichever id is left out."""
    if len(ids) <= k:
        return ids, vectors
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel() if vectors.shape[1] else np.zeros(len(ids), "V1")
    group = np.unique(raw, return_inverse=True)[1]
    if int(group.max()) + 1 == len(ids):
        return ids, vectors
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    first = np.concatenate(([True], g[1:] != g[:-1]))
    new = first | np.concatenate(([True], i[1:] != i[:-1]))
    number = np.cumsum(new)
    number -= np.maximum.accumulate(np.where(first, number, 0))  # the id's place among those of its vector, from 0
    place = np.arange(len(i))
    place -= np.maximum.accumulate(np.where(new, place, 0))
    keep = np.sort(order[(number <= k) & (place < k)])
    return ids[keep], vectors[keep]


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: list[Best]) -> int:
    """Bring a block's vectors into best; returns how many exact vectors were looked at."""
    if not best:
        return 0
    ids, vectors = without_needless_copies(ids, vectors, best[0].k)
    file = ApproximationFile(vectors)
    step = max(1, BOUND_BYTES // (8 * len(ids)))
    return sum(_search(file, ids, vectors, query_ids[at : at + step], queries[at : at + step], best[at : at + step]) for at in range(0, len(queries), step))


def _search(file: ApproximationFile, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: list[Best]) -> int:
    bounds = file.twice_bounds(queries)
    read = 0
    for j in range(len(queries)):
        bound, own = bounds[:, j], ids == query_ids[j]
        floor = best[j].worst
        alive = np.flatnonzero(~own if floor is None else ~own & (bound >= 2.0 * floor))
        while len(alive):
            step = 4 * best[j].k
            if len(alive) > step:
                first = np.argpartition(-bound[alive], step - 1)[:step]
                now, rest = alive[first], np.delete(alive, first)
            else:
                now, rest = alive, alive[:0]
            best[j].add(ids[now], products(vectors[now], queries[j]))
            read += len(now)
            floor = best[j].worst
            alive = rest if floor is None else rest[bound[rest] >= 2.0 * floor]
    return read


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and whole-number vectors of a batch, by length of vector."""
    lists = batch.column("vector")
    lengths = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten()) if lists.null_count == 0 else np.concatenate([np.zeros(0), *(np.asarray(x.values, dtype=np.float64) for x in lists if x.is_valid)])
    ids = np.asarray(batch.column("vec_id"))
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield ids[rows], whole_numbers(flat[starts[rows][:, None] + np.arange(n)]).reshape(len(rows), int(n))


def best_ranks(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """vectors (vec_id, embedding); is_query: a condition on vec_id. Result: query_id, rank, vec_id, score.

    Queries are taken in passes of bounded size, each broadcast to all tasks, which scan their own rows; a task's best k of
    each query are what is shuffled.
    """
    spark = vectors.sparkSession
    sound = only(vectors, vec_id="long", embedding="array<double>").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).select("vec_id", F.col("embedding").alias("vector"))
    asked = sound.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    size = asked.agg(F.sum(8 * F.size("vector") + 16).alias("n")).first().n or 0
    passes = max(1, -(-size // pass_bytes))
    found: DataFrame | None = None
    for p in range(passes):
        rows = (asked if passes == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p)).collect()
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(r.vector) for r in rows}:
            same = sorted((r.vec_id, r.vector) for r in rows if len(r.vector) == n)
            by_length[n] = np.array([i for i, _ in same], np.int64), whole_numbers(np.array([v for _, v in same], np.float64).reshape(len(same), n))
        sent = spark.sparkContext.broadcast(by_length)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries = sent.value
            best = {n: [Best(k) for _ in ids] for n, (ids, _) in queries.items()}
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in queries}

            def search(n: int) -> None:
                if held[n]:
                    search_block(np.concatenate([i for i, _ in held[n]]), np.concatenate([v for _, v in held[n]]), *queries[n], best[n])
                    held[n] = []

            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    for ids, values in _vectors(batch.slice(at, BLOCK_ROWS)):
                        if (n := values.shape[1]) in held:
                            held[n].append((ids, values))
                            if sum(len(i) for i, _ in held[n]) >= BLOCK_ROWS:
                                search(n)
            for n in queries:
                search(n)
                sizes = [len(b.ids) for b in best[n]]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[n][0], sizes)), pa.array(np.concatenate([b.ids for b in best[n]])), pa.array(np.concatenate([b.scores for b in best[n]]))], names=["query_id", "vec_id", "score"])

        part = best_ranks(sound.mapInArrow(run, "query_id long, vec_id long, score long"), k)
        if passes > 1:  # asked now, so that neither the driver nor the workers hold the queries of more than one pass
            part = materialize(part, "top-k")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op7_exact_top_k": op7}
ORACLES = {
    "op7_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
