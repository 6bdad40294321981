"""Best-fit packing of documents' tokens into sequences, certified by lower bounds.

Pieces of documents (of `capacity` tokens at most) are dealt to partitions; each packs its own by best-fit decreasing
and computes, from dual-feasible functions, how many sequences its pieces need at least, parts of a sequence included.
A partition that uses no more than that is certified and keeps its sequences. Any other hands on the pieces of its
emptiest sequences, in proportion to its gap; they meet those of other partitions and are packed anew, round after
round, until a round leaves one partition or saves no sequence. A task never packs more than `group_pieces` at once.
Only lengths travel; a piece's tokens never do. report() certifies the whole: sequences, lower bound, gap.

Null texts count as empty; an empty text has the end id alone. Rows with equal doc_id are packed each. Ties are
broken by doc_id and piece. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, only, table, text_blocks
from .tokens import text_encoder, vocabulary_path

CAPACITY = 2048
#: Pieces that one task packs at once at most.
GROUP_PIECES = 40_000
#: Sequences that a partition hands on for each one over its bound: enough pieces to find better partners among.
HANDED = 8


def bound_of_counts(n: np.ndarray, capacity: int = CAPACITY) -> Fraction:
    """n: how many pieces have each size from 0 to capacity. No packing has fewer bins: the best of the dual-feasible functions u(k), U(eps) and the plain sum, not rounded."""
    n, x = n.astype(object), np.arange(capacity + 1, dtype=np.int64)
    best = Fraction(int((n * x).sum()), capacity)
    for k in range(1, 33):  # u(k): x stays where (k+1)x/C is whole, else it becomes floor((k+1)x/C) C/k; all times k
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        best = max(best, Fraction(int((n * value).sum()), k * capacity))
    count_to, sum_to = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * x)))  # over sizes below i
    eps = np.arange(1, capacity // 2 + 1)  # U(eps): above C-eps a whole bin, below eps nothing
    value = (count_to[-1] - count_to[capacity - eps + 1]) * capacity + sum_to[capacity - eps + 1] - sum_to[eps]
    return max(best, Fraction(int(value.max(initial=0)), capacity))


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of the sizes has fewer bins."""
    return ceil(bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity))


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes in falling order: each one's bin and offset, and the bins' fills. The fullest bin that has room is taken, of equal ones the newest."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    some = 0  # bit r: a bin with room r
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, size in enumerate(sizes.tolist()):
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            room, chosen = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = chosen, fills[chosen]
        fills[chosen] += size
        left = room - size
        if left:
            rooms[left].append(chosen)
            some |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def open_bins(sizes: np.ndarray, fills: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Which bins a partition hands on: none if their number is certified by its bound, else the emptiest, HANDED times as many as the gap."""
    gap = len(fills) - bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity)
    out = np.zeros(len(fills), bool)
    out[np.argsort(fills, kind="stable")[: ceil(HANDED * gap)]] = True
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (doc_id, piece, start, length and more columns): the same with sequence_id and offset.

    Each round's rows are written to the shared folder, as later rounds read what earlier ones decided.
    """
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, open boolean"

    def run(round_: int):
        def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for frame in frames:
                while len(frame):
                    room = group_pieces - sum(map(len, held))
                    held.append(frame[:room])
                    frame = frame[room:]
                    if sum(map(len, held)) == group_pieces:
                        yield pd.concat(held, ignore_index=True)
                        held = []
            if held:
                yield pd.concat(held, ignore_index=True)

        def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            first = (np.int64(round_) << 56) + (np.int64(TaskContext.get().partitionId()) << 32)
            for rows in chunks(frames):
                rows = rows.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
                sizes = rows["length"].to_numpy()
                bins, offsets, fills = best_fit_decreasing(sizes, capacity)
                yield rows.assign(sequence_id=first + bins, offset=offsets, open=open_bins(sizes, fills, capacity)[bins])
                first += len(fills)

        return packed

    out, rest, n, before, round_ = [], pieces, pieces.count(), None, 0
    while True:
        # a task's share varies by a few roots of its size: with a tenth of room, a second chunk is rare
        groups = -(-10 * n // (9 * group_pieces)) if n > group_pieces else 1
        # by what tells pieces apart, not round-robin: a task that runs again gets the same rows
        dealt = rest.repartition(groups, F.xxhash64("doc_id", "piece", "start", F.lit(round_))) if groups > 1 else rest.coalesce(1)
        done = materialize(dealt.mapInPandas(run(round_), schema), "packing")
        # distinct sequences of this round, as each fills its offsets from 0
        got = done.agg(F.count(F.when(F.col("offset") == 0, 1)).alias("bins"), F.count(F.when(F.col("open") & (F.col("offset") == 0), 1)).alias("open"), F.count(F.when(F.col("open"), 1)).alias("pieces")).first()
        if groups == 1 or not got.open or (before is not None and got.bins >= before):
            return reduce(DataFrame.unionByName, [*out, done.drop("open")])
        out.append(done.where(~F.col("open")).drop("open"))
        rest, n, before, round_ = done.where("open").select(columns), got.pieces, got.open, round_ + 1


def report(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """sequences, bound (no packing of the same pieces has fewer) and gap. At most one row for each length comes to the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").agg(F.count(F.lit(1))).collect():
        counts[length] = n
    sequences, bound = packed.where("offset = 0").count(), ceil(bound_of_counts(counts, capacity))
    return {"sequences": sequences, "bound": bound, "gap": sequences - bound}


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Documents (doc_id, text) as pieces: doc_id, piece, start, length, ids_crc32."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        for batch, texts in text_blocks(batches):
            rows: list[tuple] = []
            for number, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                raw = ids + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((number, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return only(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Documents (doc_id, text) packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(documents, tokenizer or vocabulary_path("word_bpe_49k.json"), capacity), "pieces")
    return pack(pieces, capacity)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6}
ORACLES: dict[str, str] = {}
