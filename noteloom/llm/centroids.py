"""Centroid clustering (Lloyd's rounds) with exact annulus search.

Centroids are sorted by norm. A vector's distance to one centroid, that of its last cluster, bounds the distance to its
nearest from above; by the triangle inequality the nearest one's norm differs from the vector's by no more. The centroids with
norms in that annulus, widened by what rounding may cost, are found by binary search and compared exactly, in whole numbers; of equal ones the
smaller number wins, and as both edges belong to the annulus no tie is lost.

Vectors take part if they have exactly the asked number of components, none null or non-finite; component x becomes
floor(64 x), kept within 2 ** 27 either way so that squared distances have 64 bits. Vectors with a null id take part, but start no
centroid while others can; of equal ids the least vector comes first. Repeated rows are clustered each. With fewer vectors than centroids there
are as many centroids as vectors; an empty table gives an empty result. Empty clusters keep their centroids.

Each round writes the vectors with their clusters, so that a lost executor costs no earlier round; a task hands on one sum for each
cluster, and what reaches the driver are the centroids: as many numbers as clusters times components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only, table, tidied

SCALE, DIMENSIONS, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Components are kept within this, so that 64 squared differences fit into 62 bits.
LARGEST = 1 << 27
#: Vectors compared at once.
BLOCK_ROWS = 4096


class Annulus:
    """Centroids (rows of whole numbers) in order of their norms."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.compared = 0

    def nearest(self, vectors: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; last: a centroid of each, whose distance is the bound."""
        best = last.astype(np.int64)
        distance = squares(vectors - self.centroids[best])
        norms, bound = np.sqrt((vectors.astype(np.float64) ** 2).sum(1)), np.sqrt(distance.astype(np.float64))
        slack = 1e-6 + 1e-9 * (norms + bound)
        first = np.searchsorted(self.norms, norms - bound - slack, "left")
        stop = np.searchsorted(self.norms, norms + bound + slack, "right")
        self.compared += int((stop - first).sum())
        # the annuli of a block are gone through together, one centroid at a time: those vectors whose annulus has it
        for place in range(int(first.min(initial=0)), int(stop.max(initial=0))):
            rows = np.flatnonzero((first <= place) & (place < stop))
            if not len(rows):
                continue
            number = int(self.order[place])
            found = squares(vectors[rows] - self.centroids[number])
            better = (found < distance[rows]) | ((found == distance[rows]) & (number < best[rows]))
            best[rows[better]], distance[rows[better]] = number, found[better]
        return best, distance


def squares(differences: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", differences, differences)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dimensions)


def whole(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and whole components of the vectors that take part."""
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) == dimensions) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    kept = only(vectors, vec_id="long", embedding="array<double>").where(F.coalesce(sound, F.lit(False)))

    def floor(c: Column) -> Column:
        return F.floor(F.greatest(F.least(scale * c, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")

    return kept.select("vec_id", F.transform(x, floor).alias("v"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: str = "1") -> list[list[int]]:
    """The vectors whose ids have the smallest hashes: a top-k of the table."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in kept.select(hashed.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()]


def assigned(state: DataFrame, centroids: list[list[int]], distance: bool = False) -> DataFrame:
    """state (vec_id, v, cluster) with the cluster of the nearest centroid (and its squared distance)."""
    sent = state.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))
    dimensions = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                found, squared = search.nearest(_matrix(part.column("v"), dimensions), np.asarray(part.column("cluster")))
                columns = [part.column("vec_id"), part.column("v"), pa.array(found.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(squared)] if distance else columns, names=["vec_id", "v", "cluster", "distance"][: 3 + distance])

    return state.mapInArrow(run, "vec_id long, v array<int>, cluster int" + (", distance long" if distance else ""))


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids moved to the floors of their vectors' means; sums are exact, in decimals beyond a task."""
    k, dimensions = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors, cluster = _matrix(batch.column("v"), dimensions), np.asarray(batch.column("cluster"))
            for c in np.unique(cluster):
                sums[c] += vectors[cluster == c].sum(0)
            counts += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    terms = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("place", "x"))
    totals = terms.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    by_place = {(r.cluster, r.place): int(r.x) for r in totals}
    return [[by_place[c, d + 1] // by_place[c, 0] for d in range(dimensions)] if (c, 0) in by_place else list(old) for c, old in enumerate(centroids)]


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = "1") -> DataFrame:
    """vectors (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""

    def make() -> DataFrame:
        kept = materialize(whole(vectors, dimensions, scale), "vectors")
        centroids = first_centroids(kept, clusters, seed)
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        if not centroids:
            return kept.sparkSession.createDataFrame([], none)
        state = kept.withColumn("cluster", F.lit(0))
        for r in range(rounds):
            state = materialize(assigned(state, centroids), f"clusters-{r}")
            centroids = moved(state, centroids)
        last = materialize(assigned(state, centroids, distance=True).drop("v"), "clustered")
        total = F.sum(F.col("distance").cast("decimal(38,0)"))
        sums = {r.cluster: int(r.s) for r in last.groupBy("cluster").agg(total.alias("s")).collect()}
        return _described(last, sums, centroids)

    return tidied("centroids", make)


def _described(last: DataFrame, sums: dict[int, int], centroids: list[list[int]]) -> DataFrame:
    """Rows with what is known of their cluster: a short list, looked up by number."""
    limit = (1 << 63) - 1
    whole_sum = min(limit, sum(sums.values()))
    inertia = F.array(*(F.lit(min(limit, sums.get(c, 0))).cast("long") for c in range(len(centroids))))
    hashes = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids))
    return last.select("vec_id", "cluster", "distance", F.get(inertia, "cluster").alias("cluster_inertia"), F.lit(whole_sum).cast("long").alias("inertia"), F.get(hashes, "cluster").alias("centroid_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT 16))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min([CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), k]) AS m FROM v CROSS JOIN c{i} c GROUP BY r)")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT m[2] AS k, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM a{i} JOIN v USING (r)) GROUP BY k, j),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e FROM s{i} GROUP BY k) n USING (k))""")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, m[1] AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia, CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} c ON c.k = m[2]"""


QUERIES = {"op13_centroids": op13}
ORACLES = {"op13_centroids": _oracle()}
