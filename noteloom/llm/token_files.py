"""Token-ID output: Re-Pair compressed shards of token ids, with random access to each document.

A shard (one row of the written table, at most `shard_tokens` ids unless one document is longer) is compressed by
itself: frequent pairs of neighbouring ids become nonterminals, the commonest first, until none pays for its rule. It
stores the rules, the length each nonterminal expands to, the shortened sequence and, for each document, its id, its place in the sequence and
its token count, so that one document, or any part of it, is decoded without the rest.

Pairs never reach across documents. Null texts count as empty; an empty text has the end id alone. Rows with equal
doc_id are all written, ordered by text; null ids come first. An empty table gives no shard and an empty result.
The files are a Parquet table in the shared folder, so that any store that Spark can write to will do, and a lost
task's part is written anew.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, only, table, text_blocks
from .tokens import text_encoder, vocabulary_path

MAGIC = b"RPR1"
HEADER = struct.Struct("<4sIIIIB3x")
END_ID = 0
#: Ids of one shard, unless one document has more.
SHARD_TOKENS = 1 << 18
#: A rule takes 12 bytes in a shard, as much as six symbols of two bytes; a pair that is replaced less often gains nothing.
MIN_COUNT = 6
#: Pairs of about the same frequency are replaced in one round; it steers cost and, a little, the size of the grammar.
FALL = 64
SPREAD = np.uint64(0x9E3779B97F4A7C15)


# --- grammar -----------------------------------------------------------------


def frequent_pairs(key: np.ndarray, min_count: int, fall: int) -> tuple[np.ndarray, int, np.ndarray]:
    """The pairs that occur at least as often as a fall-th of the commonest, rising in frequency; that least count; and the only places where these pairs can be.

    Pairs are counted by hashed buckets first, and only those of buckets with enough of them are sorted.
    """
    return frequent_and_alive(key, min_count, fall)[:3]


def frequent_and_alive(key: np.ndarray, min_count: int, fall: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """As frequent_pairs(), and which pairs may occur min_count times: a pair that does not never will, as a new symbol stands in each pair that arises."""
    bits = max(8, len(key).bit_length())
    bucket = ((key.view(np.uint64) * SPREAD) >> np.uint64(64 - bits)).view(np.int64)
    sizes = np.bincount(bucket, minlength=1 << bits)
    around = sizes[bucket]
    fullest = key[np.flatnonzero(bucket == sizes.argmax())]
    fullest = np.unique(fullest[fullest >= 0], return_counts=True)[1]
    # the commonest pair occurs as often as this or more
    bound = max(min_count, int(fullest.max(initial=0)) // fall)
    alive, places = around >= min_count, np.flatnonzero(around >= bound)
    ordered = np.sort(key[places])
    ordered = ordered[np.searchsorted(ordered, 0) :]
    if not len(ordered):
        return ordered, min_count, places, alive
    edge = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    counts = np.diff(np.append(edge, len(ordered)))
    least = max(min_count, int(counts.max()) // fall)
    often = counts >= least
    return ordered[edge[often]][np.argsort(counts[often], kind="stable")], least, places, alive


def occurrences(pairs: np.ndarray, chosen: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chosen pairs begin, and which they are, without overlaps: the more frequent pair comes first, and of a run of one pair (as in aaaa) every second.

    pairs: those at the places where to look. Pairs are looked up in a hash table in which a pair may hide a less frequent one, whose turn then comes in a later round.
    """
    bits = max(8, (4 * len(chosen)).bit_length())
    slot = lambda keys: (keys.view(np.uint64) * SPREAD) >> np.uint64(64 - bits)
    slots = np.full(1 << bits, -1, np.int32)
    slots[slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
    place = slots[slot(pairs)]
    hit = np.flatnonzero(place >= 0)
    at, place, pairs = places.take(hit), place.take(hit), pairs.take(hit)
    same = np.flatnonzero(chosen.take(place) == pairs)
    at, place = at.take(same), place.take(same)
    touches = np.diff(at) == 1
    follows = np.flatnonzero(touches & (place[1:] == place[:-1])) + 1
    if len(follows):
        begin = np.arange(len(at))
        begin[follows] = 0
        second = (at - at[np.maximum.accumulate(begin)]) % 2 == 1
        at, place = at[~second], place[~second]
        touches = np.diff(at) == 1
    wins = np.ones(len(at), bool)
    wins[1:] &= ~touches | (place[1:] > place[:-1])
    wins[:-1] &= ~touches | (place[:-1] > place[1:])
    return at[wins], place[wins]


def repair(ids: np.ndarray, last: np.ndarray, min_count: int = MIN_COUNT, fall: int = FALL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Replace frequent pairs by nonterminals, from the commonest down, until no round finds a pair that occurs min_count times.

    A round replaces all pairs that occur at least as often as a fall-th of the commonest, and are replaced min_count
    times. last marks ids that end a document; no pair starts there. Returns the sequence, its marks, the rules (n x 2),
    the expansion lengths of the nonterminals, and the first nonterminal's number.
    """
    base = int(ids.max()) + 1 if len(ids) else 1
    sequence = ids.astype(np.int32 if base + len(ids) < 1 << 31 else np.int64)
    rules, lengths = [np.zeros((0, 2), np.int64)], np.ones(base, np.int64)
    only_once = False
    alive = ~last  # where a pair begins that may still be replaced; only these are counted
    alive[-1:] = False
    while True:
        begins = np.flatnonzero(alive)
        key = sequence.take(begins).astype(np.int64)
        key <<= 32
        key |= sequence.take(begins + 1)
        chosen, least, places, may = frequent_and_alive(key, min_count, 1 << 40 if only_once else fall)
        if not len(chosen):
            break
        alive[begins[~may]] = False
        at, place = occurrences(key[places], chosen, begins[places])
        pays = np.bincount(place, minlength=len(chosen)) >= min_count
        at, place = at[pays[place]], place[pays[place]]
        if not len(at):  # what is common only overlaps itself or others: one look at all pairs, then an end
            if least == min_count:
                break
            only_once = True
            continue
        only_once = False
        pairs = chosen[pays]
        new = np.stack((pairs >> 32, pairs & 0xFFFFFFFF), 1)
        number = len(lengths) + np.cumsum(pays) - 1
        lengths = np.concatenate((lengths, lengths[new].sum(1)))
        rules.append(new)
        sequence[at] = number[place]
        last[at] = last[at + 1]
        alive[at] = ~last[at]
        before = at[at > 0] - 1
        alive[before] = ~last[before]
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        left = np.flatnonzero(keep)
        sequence, last, alive = sequence.take(left), last.take(left), alive.take(left)
        alive[-1:] = False
    return sequence.astype(np.int64), last, np.concatenate(rules), lengths[base:], base


class Expansions:
    """Decodes symbols: what stands for at most SHORT ids is looked up, longer nonterminals are first replaced by their rules."""

    SHORT = 64

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, base: int):
        self.rules, self.base = rules, base
        self.sizes = np.concatenate((np.ones(base, np.int64), lengths.astype(np.int64)))
        short = np.flatnonzero(lengths <= self.SHORT) + base
        flat, owner = short, np.arange(len(short))
        while len(flat) and (big := flat >= base).any():  # all short rules at once, a step deeper each time
            flat, owner = self._step(flat, big), np.repeat(owner, 1 + big)
        self.starts = np.zeros(base + len(rules), np.int64)
        self.starts[short] = np.cumsum(self.sizes[short]) - self.sizes[short]
        self.flat = flat

    def _step(self, sequence: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = np.repeat(sequence, 1 + which)
        at = np.flatnonzero(which) + np.arange(int(which.sum()))
        pair = self.rules[sequence[which] - self.base]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        return out

    def of(self, sequence: np.ndarray) -> np.ndarray:
        while len(sequence) and (long := self.sizes[sequence] > self.SHORT).any():
            sequence = self._step(sequence, long)
        sizes = self.sizes[sequence]
        ends = np.cumsum(sizes)
        out = np.repeat(sequence, sizes)
        inside = out >= self.base
        place = np.arange(len(out)) - np.repeat(ends - sizes - self.starts[sequence], sizes)
        out[inside] = self.flat[place[inside]]
        return out


def expand(sequence: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    return Expansions(rules, lengths, base).of(sequence)


def pack_shard(doc_ids: list[int | None], ids: list[bytes], **options) -> bytes:
    """The bytes of one shard."""
    counts = np.array([len(x) // 4 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    last = np.zeros(len(flat), bool)
    last[np.cumsum(counts) - 1] = True
    sequence, last, rules, lengths, base = repair(flat, last, **options)
    stops = np.flatnonzero(last) + 1
    width = 2 if base + len(rules) <= 1 << 16 else 3 if base + len(rules) <= 1 << 24 else 4
    body = sequence.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    known = np.array([i is not None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], "<i8")
    return b"".join((
        HEADER.pack(MAGIC, base, len(rules), len(sequence), len(counts), width), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
        numbers.tobytes(), known.tobytes(), counts.astype("<u4").tobytes(), stops.astype("<u4").tobytes(), np.ascontiguousarray(body.T).tobytes(),
    ))


class Shard:
    """Reads what pack_shard() wrote."""

    def __init__(self, raw: bytes):
        magic, self.base, n_rules, n, n_docs, width = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", n_rules)
        numbers, known = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [i if k else None for i, k in zip(numbers.tolist(), known.tolist(), strict=True)]
        self.counts, self.stops = take("<u4", n_docs), take("<u4", n_docs)
        planes = take("u1", width * n).reshape(width, n)
        self.sequence = sum((planes[k].astype(np.int64) << (8 * k) for k in range(width)), np.zeros(n, np.int64))

    def all_ids(self) -> np.ndarray:
        return expand(self.sequence, self.rules, self.lengths, self.base)

    def ids(self, index: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop of the index-th document; only the symbols that reach into that span are expanded."""
        symbols = self.sequence[int(self.stops[index - 1]) if index else 0 : int(self.stops[index])]
        stop = int(self.counts[index]) if stop is None else min(stop, int(self.counts[index]))
        if start >= stop:
            return np.zeros(0, np.int64)
        sizes = np.ones(len(symbols), np.int64)
        big = symbols >= self.base
        sizes[big] = self.lengths[symbols[big] - self.base]
        ends = np.cumsum(sizes)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.few(symbols[a:b])[start - skipped : stop - skipped]

    def few(self, symbols: np.ndarray) -> np.ndarray:
        """As all_ids(), for a few symbols: without a table of all rules."""
        while len(symbols) and (big := symbols >= self.base).any():
            symbols = Expansions._step(self, symbols, big)
        return symbols


# --- tables ------------------------------------------------------------------


def write_token_files(documents: DataFrame, tokenizer: str, ranks: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, **options) -> DataFrame:
    """Encode documents (doc_id, text) in ascending doc_id order (ranks: as in TextEncoder); the written table of shards: part, shard, first_doc, last_doc, n_docs, n_tokens, payload."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, shard = text_encoder(tokenizer, ranks), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, shard
            numbers = [i for i, _ in held]
            payload = pack_shard(numbers, [x for _, x in held], **options)
            out = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "first_doc": [numbers[0]], "last_doc": [numbers[-1]], "n_docs": [len(held)], "n_tokens": [size], "payload": [payload]}, schema=SHARDS)
            held, size, shard = [], 0, shard + 1
            return out

        for batch, texts in text_blocks(batches):
            for number, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                if held and size + len(ids) // 4 + 1 > shard_tokens:
                    yield flush()
                held.append((number, ids + end))
                size += len(ids) // 4 + 1
        if held:
            yield flush()

    SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    ordered = only(documents, doc_id="long", text="string").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(run, "part int, shard int, first_doc long, last_doc long, n_docs long, n_tokens long, payload binary"), "token-files")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, start (ids before it in all files), n_tokens, ids (little-endian unsigned 32-bit)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens")).withColumn("part_start", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "shard", "n_tokens").withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("inside")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raw in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                shard = Shard(raw.as_py())
                flat = shard.all_ids().astype("<u4").tobytes()
                counts = shard.counts.astype(np.int64)
                stops = np.cumsum(counts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.doc_ids, pa.int64()), "start": start + stops - counts, "n_tokens": counts,
                    "ids": pa.array([flat[4 * (b - a) : 4 * b] for a, b in zip(counts.tolist(), stops.tolist(), strict=True)], pa.binary()),
                })

    return shards.select("part", "shard", "payload").join(places, ["part", "shard"]).select("start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table written by write_token_files() and read back: doc_id, start, n_tokens, ids_crc32."""
    shards = write_token_files(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken"))
    return read_token_files(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_files": op8}
ORACLES: dict[str, str] = {}
__all__ = ["Shard", "expand", "op8", "pack_shard", "read_token_files", "repair", "write_token_files"]
