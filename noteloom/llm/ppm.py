"""Language-model scores: a unigram base, and prediction by partial matching over bytes.

The model is a trie of byte contexts up to ORDER bytes long, counted over the training documents. A symbol that a
context has not seen costs that context's escape, q/(n+q) for n symbols of q kinds seen, and goes to the next shorter
context, where all symbols of the longer one are excluded; below the empty context all other symbols are alike. Each
text is scored from its start to an end symbol.

The trie is never in one place. Contexts of at most two symbols have 257 * 258 * 258 entries at most and go to all.
Documents are dealt to blocks by hash. A block asks once for each of its distinct longest contexts with next symbol,
with its training count: these go to the bucket of the context's last three symbols, which has all longer contexts with
that end, adds up, computes each cost and answers each block. Word counts travel alike. There are as many buckets as
pairs of blocks, so that a bucket is asked as much at any size of the corpus, but for what is common everywhere: a bucket
that is asked for more than GROUP_BYTES of keys is dealt to parts. Each part adds up its own blocks' counts, FAN_IN parts
are added to one until one is left, and with those sums, which are as long as there are different contexts in a bucket
and no longer, each part answers its own blocks.

Null texts count as empty: one end token, the end symbol's cost. Null ids count as the text ''. Rows with equal doc_id
are scored each. Without training documents the base is log10(0.5/0.5) a token. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_blocks, free_shuffles, materialize, only, table, tidied
from .words import U64, hash_words, mix

ORDER = 4
BITS = 9
SYMBOLS, END, START = 257, 256, 257
BLOCK_BYTES = 8 << 20
#: Bytes of keys that one group is asked for at most, and sums that are added at once; they steer cost, not results.
GROUP_BYTES, FAN_IN = 24 << 20, 64
#: Distinct contexts that a task holds before it adds them up.
HELD_KEYS = 1 << 20
REQUESTS = "kind string, bucket long, block long, n long, keys binary, counts binary"
SUMS = "kind string, bucket long, part long, keys binary, counts binary"
ANSWERS = "kind string, bucket long, block long, found binary"
END_WORD = U64(0)
KEYS = {"word": "<u8", "gram": "<i8"}


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 != 1


# --- the model ---------------------------------------------------------------


def contexts(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all symbols with their contexts (order symbols before, then the symbol, 9 bits each), and symbols per text."""
    counts = np.array([len(t) + 1 for t in texts], np.int64)
    stream = np.full(int(counts.sum()) + order * len(texts), START, np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    # each text: order start symbols, its bytes, an end symbol
    first = np.cumsum(counts + order) - counts
    lengths = counts - 1
    where = np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(raw))
    stream[where] = raw
    stream[first + lengths] = END
    key = np.zeros(len(stream) - order, np.int64)
    for k in range(order + 1):
        key <<= BITS
        key |= stream[k : len(stream) - order + k]
    real = np.ones(len(stream), bool)
    real[(np.cumsum(counts + order) - counts - order)[:, None] + np.arange(order)] = False
    return key[real[order:]], counts


class Short:
    """Counts after two symbols, after one and after none, from the sorted keys of all symbols seen after two."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        size = 1 << 2 * BITS
        heads, tails = keys >> BITS, keys & (size - 1)
        self.keys, self.c2 = keys, counts.astype(np.float64)
        self.n2, self.q2 = np.bincount(heads, self.c2, size), np.bincount(heads, minlength=size).astype(np.float64)
        after_one = np.bincount(tails, self.c2, size)
        self.below2 = np.bincount(heads, after_one[tails], size)  # of the counts after one symbol, those of symbols seen after two
        self.c1 = after_one.reshape(1 << BITS, 1 << BITS)  # [context symbol, symbol]
        self.n1, self.q1 = self.c1.sum(1), (self.c1 > 0).sum(1).astype(np.float64)
        self.c0 = self.c1.sum(0)
        self.n0, self.q0 = self.c0.sum(), float((self.c0 > 0).sum())
        self.below1 = (self.c1 > 0).astype(np.float64) @ self.c0  # of the empty context's counts, those of symbols seen after one

    def after_two(self, keys: np.ndarray) -> np.ndarray:
        return values_at(keys, self.keys, self.c2)


def values_at(wanted: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of the wanted ones among sorted keys, 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, values[at], values.dtype.type(0))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log10(part / whole), 0 where there is nothing to choose from."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(whole > 0, np.log10(part / whole), 0.0)


class Costs:
    """log10 probabilities of symbols in their contexts, from the longest context down."""

    def __init__(self, n: int):
        self.total, self.open = np.zeros(n), np.ones(n, bool)
        self.n_out, self.q_out = np.zeros(n), np.zeros(n)  # of the next context's counts, those that are excluded

    def look(self, c: np.ndarray, n: np.ndarray, q: np.ndarray, below: np.ndarray) -> None:
        """One context of each symbol: the symbol's count, all counts, their kinds, and what the next shorter context counts for these."""
        whole = n - self.n_out + q - self.q_out
        hit = self.open & (c > 0)
        self.total[hit] += np.log10(c[hit] / whole[hit])
        self.open &= ~hit
        self.total[self.open] += _share((q - self.q_out)[self.open], whole[self.open])
        self.n_out, self.q_out = below, q


def costs(keys: np.ndarray, trained: np.ndarray, counts: np.ndarray, short: Short, order: int = ORDER) -> np.ndarray:
    """log10 probabilities of keys. trained: sorted, all those that share their last three context symbols with one of keys; order: 2 or more."""
    low, pair = (1 << BITS) - 1, (1 << 2 * BITS) - 1
    found = Costs(len(keys))
    for length in range(order, 2, -1):
        mask = (1 << (BITS * (length + 1))) - 1
        grams, group = np.unique(trained & mask, return_inverse=True)
        c = np.bincount(group, counts, len(grams))
        heads, head_of = np.unique(grams >> BITS, return_inverse=True)
        n, q = np.bincount(head_of, c, len(heads)), np.bincount(head_of, minlength=len(heads)).astype(np.float64)
        if length > 3:
            shorter, to = np.unique(grams & (mask >> BITS), return_inverse=True)
            total = np.bincount(to, c, len(shorter))[to]
        else:
            total = short.after_two(grams & (mask >> BITS))
        below = np.bincount(head_of, total, len(heads))
        own = keys & mask
        found.look(values_at(own, grams, c), *(values_at(own >> BITS, heads, x) for x in (n, q, below)))
    head, last, symbol = (keys >> BITS) & pair, (keys >> BITS) & low, keys & low
    found.look(short.after_two(keys & ((pair << BITS) | low)), short.n2[head], short.q2[head], short.below2[head])
    found.look(short.c1[last, symbol], short.n1[last], short.q1[last], short.below1[last])
    found.look(short.c0[symbol], np.full(len(keys), short.n0), np.full(len(keys), short.q0), np.zeros(len(keys)))
    found.total[found.open] -= np.log10(max(1.0, SYMBOLS - short.q0))
    return found.total


# --- tables ------------------------------------------------------------------


def _distinct(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the sum of each one's weights, and each value's place among them."""
    codes, found = pd.factorize(values)
    order = np.argsort(found, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[codes]
    return found[order], np.bincount(codes, weights, len(found)).astype(np.int64), codes


def _block(ids: list, texts: list[bytes], order: int):
    train = np.array([in_training(i) for i in ids], bool)
    hashes, n_words = hash_words(texts)
    hashes[hashes == END_WORD] = U64(1)
    doc = np.repeat(np.arange(len(ids)), n_words)
    grams, n_symbols = contexts(texts, order)
    words = _distinct(np.concatenate((hashes, np.zeros(len(ids), U64))), np.concatenate((train[doc], train)).astype(np.float64))
    return train, n_words, doc, words, n_symbols, _distinct(grams, np.repeat(train, n_symbols).astype(np.float64))


def _buckets(kind: str, keys: np.ndarray, n: int) -> np.ndarray:
    if kind == "word":
        return (keys % U64(n)).astype(np.int64)
    return (mix((keys >> BITS).astype(U64) & U64((1 << 3 * BITS) - 1)) % U64(n)).astype(np.int64)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has entries, and their places, in order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, edges) if len(order) else ():
        yield int(bucket[at[0]]), at


def _after_two(documents: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys of the symbols seen after two, their training counts, and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch, texts in byte_blocks(batches):
            size += sum(map(len, texts))
            chosen = [t for i, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True) if in_training(i)]
            if chosen:
                codes, found = pd.factorize(contexts(chosen, 2)[0])
                keys.append(found)
                counts.append(np.bincount(codes, minlength=len(found)))
            if sum(map(len, keys)) > HELD_KEYS:
                found, total, _ = _distinct(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [found], [total]
        found, total, _ = _distinct(np.concatenate(keys), np.concatenate(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total, size))], names=["key", "n"])

    got = documents.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    keys, n = (got.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    return keys[keys >= 0], n[keys >= 0], int(n[keys < 0].sum())


def _arrays(frame: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in frame.column(column).to_pylist()]


def _added(kind: str, keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their counts, and the place of each of the given keys."""
    found, place = np.unique(np.concatenate([np.zeros(0, KEYS[kind]), *keys]), return_inverse=True)
    return found, np.bincount(place, np.concatenate([np.zeros(0), *counts]), len(found)).astype(np.int64), place


def add_up(frame: pa.Table, count: str) -> pa.Table:
    """Requests or sums of one kind, bucket and part: the sums of what was trained."""
    kind, bucket, part = (frame.column(c)[0].as_py() for c in ("kind", "bucket", "part"))
    found, total, _ = _added(kind, _arrays(frame, "keys", KEYS[kind]), _arrays(frame, "counts", count))
    seen = total > 0
    return pa.table({"kind": [kind], "bucket": [bucket], "part": [part], "keys": [found[seen].tobytes()], "counts": [total[seen].astype("<i8").tobytes()]})


def answer(frame: pa.Table, short: Short, order: int, sums: pa.Table | None = None) -> pa.Table:
    """Requests of one kind and bucket, or part of a bucket, and the sums of the whole bucket (else the requests' own): an answer for each request, and once the bucket's total of words."""
    head = frame if sums is None else sums
    kind, bucket = head.column("kind")[0].as_py(), head.column("bucket")[0].as_py()
    keys = _arrays(frame, "keys", KEYS[kind])
    found, total, place = _added(kind, keys, _arrays(frame, "counts", "<u4"))
    if sums is None:
        trained, counts, first = found[total > 0], total[total > 0], True
    else:
        (trained,), (counts,), first = _arrays(sums, "keys", KEYS[kind]), _arrays(sums, "counts", "<i8"), sums.column("part")[0].as_py() == 0
    value = values_at(found, trained, counts).astype("<i8") if kind == "word" else costs(found, trained, counts.astype(np.float64), short, order).astype("<f8")
    out = [value[p].tobytes() for p in np.split(place, np.cumsum([len(k) for k in keys])[:-1])] if keys else []
    kinds, blocks = [kind] * len(out), frame.column("block").to_pylist()
    if kind == "word" and first:
        kinds, blocks, out = [*kinds, "total"], [*blocks, None], [*out, np.array([counts.sum(), len(counts)], "<i8").tobytes()]
    return pa.table({"kind": pa.array(kinds, pa.string()), "bucket": pa.array([bucket] * len(out), pa.int64()), "block": pa.array(blocks, pa.int64()), "found": pa.array(out, pa.binary())})


def answered(requests: DataFrame, short, order: int, group_bytes: int) -> DataFrame:
    """requests (REQUESTS): ANSWERS. short: a broadcast Short."""
    by = ["kind", "bucket"]
    parts = F.ceil(8 * F.sum("n") / group_bytes)
    hot = materialize(requests.groupBy(by).agg(parts.alias("parts")).where("parts > 1"), "hot")
    plain = requests.join(hot, by, "left_anti").groupBy(by).applyInArrow(lambda frame: answer(frame, short.value, order), ANSWERS)
    most = hot.agg(F.max("parts")).first()[0]
    if most is None:
        return plain
    dealt = requests.join(hot, by).select(*by, F.pmod("block", "parts").alias("part"), "block", "keys", "counts")
    sums = materialize(dealt.groupBy(*by, "part").applyInArrow(lambda frame: add_up(frame, "<u4"), SUMS), "sums")
    while most > 1:
        most = -(-most // FAN_IN)
        folded = sums.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy(*by, "part")
        sums = materialize(folded.applyInArrow(lambda frame: add_up(frame, "<i8"), SUMS), "sums")
    told = sums.drop("part").join(hot, by).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "keys", "counts")
    split = dealt.groupBy(*by, "part").cogroup(told.groupBy(*by, "part")).applyInArrow(lambda frame, sums: answer(frame, short.value, order, sums), ANSWERS)
    return plain.union(split)


def score_documents(documents: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """documents (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    documents = only(documents, doc_id="long", text="string")
    *after_two, size = _after_two(documents)
    short = spark.sparkContext.broadcast(Short(*after_two))
    blocks = max(1, -(-size // block_bytes))
    buckets = max(1, blocks // 2)
    dealt = documents.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)))

    def ask(frame: pa.Table) -> pa.Table:
        block, texts = frame.column("block")[0].as_py(), [(t or "").encode() for t in frame.column("text").to_pylist()]
        *_, words, _, grams = _block(frame.column("doc_id").to_pylist(), texts, order)
        rows = [
            (kind, b, block, len(at), keys[at].astype(KEYS[kind]).tobytes(), counts[at].astype("<u4").tobytes())
            for kind, (keys, counts, _) in (("word", words), ("gram", grams)) for b, at in _split(_buckets(kind, keys, buckets))
        ]
        return pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["kind", "bucket", "block", "n", "keys", "counts"])

    def answers_to_all() -> DataFrame:
        requests = materialize(dealt.groupBy("block").applyInArrow(ask, REQUESTS), "requests")
        free_shuffles(spark)
        return answered(requests, short, order, group_bytes)

    answers = tidied("ppm", answers_to_all)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2, np.int64)
        for batch in batches:
            for x in batch.column("found").to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(total[:1]), pa.array(total[1:])], names=["tokens", "kinds"])

    totals = answers.where("kind = 'total'").select("found").mapInArrow(add, "tokens long, kinds long").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    n_train, kinds = totals.tokens or 0, totals.kinds or 0

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("doc_id").to_pylist()
        texts = [(t or "").encode() for t in left.column("text").to_pylist()]
        train, n_words, doc, words, n_symbols, grams = _block(ids, texts, order)
        got = {(k, b): x for k, b, x in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "found")), strict=True)}
        values = []
        for kind, keys, sort in (("word", words[0], "<i8"), ("gram", grams[0], "<f8")):
            value = np.zeros(len(keys), sort)
            for b, at in _split(_buckets(kind, keys, buckets)):
                value[at] = np.frombuffer(got[kind, b], sort)
            values.append(value)
        counts = values[0][words[2]]
        logs = np.log10((counts + 0.5) / (n_train + 0.5 * (kinds + 1)))
        owner = np.concatenate((doc, np.arange(len(ids))))
        base, known = np.bincount(owner, logs, len(ids)), np.bincount(owner, counts > 0, len(ids)).astype(np.int64)
        total = np.add.reduceat(values[1][grams[2]], np.cumsum(n_symbols) - n_symbols)
        return pa.Table.from_arrays([left.column("doc_id"), pa.array(~train), pa.array(n_words + 1), pa.array(known), pa.array(np.full(len(ids), n_train)), pa.array(base), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = answers.where("kind <> 'total'").select("block", "kind", "bucket", "found")
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_ppm_score": op10}
ORACLES: dict[str, str] = {}
