"""MinHash near-duplicates: bottom-k sketches of word shingles from one hash function.

1. Documents with equal shingle sets form a class; only classes go on.
2. A class's sketch is its K least shingle hashes. Two sets with Jaccard similarity 0.8 or more share at least
   need(n) values of their sketches (surely for sets up to 51, else with a chance of loss under 2e-8 at exactly 0.8: that of fewer than 32 in 64 draws),
   so it is enough to list a class under its size(sketch) - need(n) + 1 rarest values: the inverted lists.
3. Each list's most central class (the one whose values are the commonest) is its leader; all members are compared
   with it: the union's sketch estimates the similarity, full sets then decide. Pairs within a list of n copies are
   thus n, not n squared.
4. Lists that still span several components are looked through again, one of those with the same members. Where at most
   SHORT_LIST members are outside the main component they are compared with all, first by odd sketches, which bound from
   below by how many values two sets differ and so lose no link. Else all members are compared with its smallest set L.
   Let x and y be linked members of different components: one of them is not linked to L, so it shares too few values
   with L, and since y is not smaller than L, x and y must share values that L lacks: at least 4/9 (|x| + |y|) less what
   either shares with L. Members are therefore listed anew under (L, value) for the rarest of their values outside L
   that a member outside the main component has, by the same prefix rule, and the lists so made are looked through in
   the same way. Each such list lacks L, so this ends. No link between components is lost, whatever the
   size of a list, and no list of n members is turned into n squared pairs.
5. Components: minimum labels with pointer jumping.

Words are runs of bytes other than space and 0x09-0x0D, A-Z as a-z. Fewer words than a shingle: the whole sequence
is one. Null, empty and wordless texts have an empty set and are linked with nothing. Rows with equal doc_id count as
rows of one document: what is linked to one is reachable from the other. Null ids are kept as they are, each row
for itself. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_blocks, free_shuffles, materialize, only, table, tidied
from .words import U64, hash_words, mix

K = 64
WIDTH, PERCENT = 5, 80
#: Estimates under this are taken as below 0.8: over 5.9 standard deviations of a sketch's estimate.
LINK_FLOOR = 0.5
#: Sketch values have this bit flipped: as signed longs, in which Spark sorts, they are then in the order of the hashes.
SIGN = U64(1 << 63)
#: In lists with no more members than this outside their main component, these are compared with all; it steers cost only, not results.
SHORT_LIST = 256
#: Tables of labels, links and lists with no more rows than this are broadcast; it steers cost only.
FEW = 1 << 15
#: Bits of an odd sketch; they steer cost only.
ODD_BITS = 512
FACTORS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    words, counts = hash_words(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    if len(words) >= width:
        n = len(words) - width + 1
        sums = np.zeros(n, U64)
        for k in range(width):
            sums += words[k : k + n] * FACTORS[k]
        sums = mix(sums)
    out = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= width:
            found = np.sort(sums[a : b - width + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif b > a:
            out.append(mix(np.sum(words[a:b] * np.array(FACTORS[: b - a], U64), keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """For each of ODD_BITS buckets, whether an odd number of the set's values fall into it.

    Where the bits of two sets differ, one of them has a value that the other lacks; so two sets differ by no fewer
    values than by bits, whatever they have in common.
    """
    counts = np.bincount((values & U64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


def may_link(n: Column, odd_a: Column, odd_b: Column) -> Column:
    """False where sets of n values in all differ by too many bits to be linked."""
    bits = sum((F.bit_count(odd_a[k].bitwiseXOR(odd_b[k])) for k in range(ODD_BITS // 64)), F.lit(0))
    return (100 + PERCENT) * bits <= (100 - PERCENT) * n


def few(table: DataFrame) -> bool:
    """Whether a written table has at most FEW rows."""
    return table.count() <= FEW


def meet(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner", small: bool = False) -> DataFrame:
    """left.join(right), dealt out and sorted unless right is known to be small.

    Spark goes by the bytes of files, in which rows that repeat their arrays are few; in a broadcast they are many times that, and it passes whole through the driver.
    """
    return left.join(right.hint("broadcast" if small else "merge"), on, how)


def need(n: Column, k: int) -> Column:
    """How many sketch values a set of n shingles shares with any set that is 80 % similar: certain where the union of both fits into a sketch."""
    return F.when(n <= k * PERCENT // 100, F.ceil(n * PERCENT / 100)).otherwise(F.lit(k // 2)).cast("int")


def sketches(documents: DataFrame, width: int, k: int) -> DataFrame:
    """documents (doc_id, text): doc_id, text_hash, n_shingles, class (of the whole set), sketch, odd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_blocks(batches):
            sets = shingle_sets(texts, width)
            sketch = [(s[:k] ^ SIGN).view(np.int64) for s in sets]
            classes = [int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            odd = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([odd_sketch(s) for s in sets])), ODD_BITS // 64).cast(pa.list_(pa.int64()))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sketch])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sketch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), lists, odd], names=["doc_id", "text_hash", "n_shingles", "class", "sketch", "odd"])

    return documents.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class long, sketch array<long>, odd array<long>")


def full_sets(documents: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted (class, doc_id, text_hash): class, members (its sorted shingle hashes, 8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_blocks(batches):
            sets = [s.tobytes() for s in shingle_sets(texts, width)]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(sets, pa.binary())], names=["class", "members"])

    same = documents.doc_id.eqNullSafe(wanted.doc_id) & (documents.text_hash == wanted.text_hash)
    texts = meet(documents, wanted, same).select("class", "text").dropDuplicates(["class"])
    return texts.mapInArrow(run, "class long, members binary")


def estimate(a: Column, b: Column, k: int) -> Column:
    """Jaccard similarity as the union's sketch shows it."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def compared(pairs: DataFrame, classes: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """pairs (a, b): those with an estimate of LINK_FLOOR or more, with common and joint (sizes of intersection and union)."""
    side = lambda x: classes.select(F.col("class").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    # of few pairs Spark sees itself what is small
    put = DataFrame.join if few(pairs) else meet
    likely = put(put(pairs, side("a"), "a"), side("b"), "b").where(estimate(F.col("sketch_a"), F.col("sketch_b"), k) >= LINK_FLOOR).select("a", "b")
    whole = lambda x: sets.select(F.col("class").alias(x), F.col("members").alias(f"set_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, joint = [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.sort(np.concatenate((x, y)))
                n = int((both[1:] == both[:-1]).sum())
                common.append(n)
                joint.append(len(both) - n)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(joint, pa.int64())], names=["a", "b", "common", "joint"])

    return put(put(likely, whole("a"), "a"), whole("b"), "b").mapInArrow(run, "a long, b long, common long, joint long")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): node, label (the least node of its component), for nodes with an edge."""
    edges = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    small = few(edges)  # as are all tables made of them
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = meet(edges, labels.select(F.col("node").alias("b"), F.col("label").alias("next")), "b", small=small).groupBy(F.col("a").alias("node")).agg(F.min("next").alias("next"))
        least = meet(labels, near, "node", "left", small).select("node", "label", F.least("label", F.coalesce("next", "label")).alias("to"))
        # the old label hears of the new one, so that whole trees move at once; then labels follow labels
        told = least.select(F.col("label").alias("node"), "to").union(least.select("node", "to")).groupBy("node").agg(F.min("to").alias("to"))
        step = materialize(meet(labels, told, "node", "left", small).select("node", "label", F.least("label", F.coalesce("to", "label")).alias("to")), "labels")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = materialize(meet(step, jump, "to", "left", small).select("node", "label", F.least("to", F.coalesce("further", "to")).alias("to")), "labels")
        labels = new.select("node", F.col("to").alias("label"))
        if new.where("label <> to").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b)."""
    name = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    small = few(labels)
    ends = meet(meet(links, name("a"), "a", "left", small), name("b"), "b", "left", small).select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    ends = materialize(ends.where("a <> b").distinct(), "ends")
    if ends.isEmpty():
        return labels
    over = components(ends).select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = meet(labels, over, "label", "full").select(F.coalesce("node", "label").alias("node"), F.coalesce("to", "label").alias("label"))
    # labels that are nodes themselves, without links until now
    return materialize(moved.union(over.select(F.col("label").alias("node"), F.col("to").alias("label"))).distinct(), "labels")


def inverted_lists(classes: DataFrame, k: int) -> DataFrame:
    """value, class, weight (how common the class's values are): each class under its rarest values, where it is not alone."""
    pairs = classes.select("class", F.explode("sketch").alias("value"))
    # written, so that both sides of the join are shuffled for it, and Spark can split a value that many classes have
    shared = materialize(pairs.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    listed = meet(pairs, shared, "value").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"), F.sum(F.log2("df")).alias("weight"))
    sizes = classes.select("class", F.size("sketch").alias("size"), need(F.col("n_shingles"), k).alias("need"))
    room = F.size("found") - F.col("need") + 1  # values with no other class come first among the rarest
    return meet(listed, sizes, "class").where(room > 0).select("class", "weight", F.explode(F.slice("found", F.lit(1), room)).alias("f")).select(F.col("f.value").alias("value"), "class", "weight")


def beside(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """stars (leader, class, ...): also size and leader_size of the two sets, common, and extras: class's values that leader lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], batch.select(["leader", "class", "weight", "outside"])
            for x, y in zip(batch.column("led"), batch.column("own"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                extra = y[x[at] != y]
                rows.append((len(x), len(y), len(y) - len(extra), extra.astype(np.int64)))
            sizes = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(r[3]) for r in rows]))), pa.int32())
            extras = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[3] for r in rows] or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*kept.columns, *sizes, extras], names=[*kept.schema.names, "leader_size", "size", "common", "extras"])

    pairs = meet(meet(stars, sets.select(F.col("class").alias("leader"), F.col("members").alias("led")), "leader"), sets.select("class", F.col("members").alias("own")), "class")
    return pairs.select("leader", "class", "weight", "outside", "led", "own").mapInArrow(run, "leader long, class long, weight double, outside boolean, leader_size long, size long, common long, extras array<long>")


def spanning(told: DataFrame) -> DataFrame:
    """told (key, class, n, weight, label): of the lists with several components key, leader (the smallest class), main (the largest component), others (members outside it).

    Lists with the same members say the same, so one of them is enough: members are told apart by 128 bits.
    """
    marks = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"mark_{k}") for k in (0, 1)]
    least = F.min(F.struct("n", (-F.col("weight")).alias("w"), "class")).alias("least")
    parts = told.groupBy("key", "label").agg(F.count(F.lit(1)).alias("members"), least, *marks)
    both = [F.bit_xor(f"mark_{k}").alias(f"mark_{k}") for k in (0, 1)]
    lists = parts.groupBy("key").agg(F.sum("members").alias("members"), F.max(F.struct("members", "label")).alias("main"), F.min("least").getField("class").alias("leader"), *both)
    found = lists.where("members > main.members").select("key", "leader", F.col("main.label").alias("main"), (F.col("members") - F.col("main.members")).alias("others"), "members", "mark_0", "mark_1")
    one = found.groupBy("members", "mark_0", "mark_1").agg(F.min(F.struct("key", "leader", "main", "others")).alias("one"))
    return one.select("one.*")


def pairs_within(short: DataFrame) -> DataFrame:
    """short (key, class, n, label, odd, main): each member outside its list's main component with the members of other components that it may be linked to: a, b.

    A pair that meets in several lists is made in the least of them only.
    """
    own = materialize(short.groupBy("class").agg(F.sort_array(F.collect_list("key")).alias("keys")), "own-lists")
    short = materialize(meet(short, own, "class").select("key", "class", "n", "label", "odd", "main", "keys"), "short")
    one, two = (short.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("class", "n", "label", "odd", "keys")), "main") for x in "ab")
    close = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    fits = (F.col("label_a") != F.col("label_b")) & close & may_link(F.col("n_a") + F.col("n_b"), F.col("odd_a"), F.col("odd_b"))
    first = F.get(F.array_intersect("keys_a", "keys_b"), F.lit(0)) == F.col("key")
    pairs = meet(one.where("label_a <> main").drop("main"), two.drop("main"), "key").where(fits & first)
    return pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def across(lists: DataFrame, classes: DataFrame, sets: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """lists (key, class, weight): node, label, the components by edges and by all links between lists' members."""
    share = PERCENT / (100 + PERCENT)
    linked = 100 * F.col("common") >= PERCENT * (F.col("size") + F.col("leader_size") - F.col("common"))
    sizes = classes.select("class", F.col("n_shingles").alias("n"), "odd")
    # links found on the way join the components at the end: members linked to one leader need no link of their own
    labels, near, links = components(edges), None, edges.select("a", "b")
    small = few(labels)
    while True:
        told = meet(meet(lists, sizes, "class"), labels.withColumnRenamed("node", "class"), "class", "left", small).withColumn("label", F.coalesce("label", "class"))
        told = materialize(told, "told")
        spans = materialize(spanning(told), "spans")
        few_spans = few(spans)
        short = meet(told, spans.where(F.col("others") <= SHORT_LIST).select("key", "main"), "key", small=few_spans)
        pairs = materialize(pairs_within(short), "near")
        near = pairs if near is None else near.union(pairs)
        long = spans.where(F.col("others") > SHORT_LIST)
        if long.isEmpty():
            break
        stars = meet(told, long, "key", small=few_spans).where("class <> leader").groupBy("leader", "class").agg(F.first("weight").alias("weight"), F.max(F.col("label") != F.col("main")).alias("outside"))
        seen = materialize(beside(stars, sets), "beside")
        links = links.union(seen.where(linked).select(F.col("leader").alias("a"), F.col("class").alias("b")))
        need = F.greatest(F.lit(1), F.ceil((F.col("size") + F.col("leader_size")) * share - 1e-6) - F.col("common")).cast("int")
        held = seen.select("leader", "class", "weight", "outside", need.alias("need"), F.explode("extras").alias("value"))
        # of two linked members of different components one is outside the main one, so that only its values count
        shared = held.groupBy("leader", "value").agg(F.count(F.lit(1)).alias("df"), F.max("outside").alias("outside")).where("df > 1 and outside").drop("outside")
        shared = materialize(shared, "shared")
        found = meet(held.drop("outside"), shared, ["leader", "value"]).groupBy("leader", "class").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"), F.first("weight").alias("weight"), F.first("need").alias("need"))
        room = F.size("found") - F.col("need") + 1
        listed = found.where(room > 0).select("leader", "class", "weight", F.explode(F.slice("found", F.lit(1), room)).alias("f"))
        lists = materialize(listed.select(F.xxhash64("leader", "f.value").alias("key"), "class", "weight"), "lists")
    rest = compared(materialize(near.distinct(), "near"), classes, sets, k).where(100 * F.col("common") >= PERCENT * F.col("joint"))
    return joined(labels, links.union(rest.select("a", "b")))


def linked(documents: DataFrame, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """documents (doc_id, text): their sketches, a row each, and the classes' components by their links (node, label)."""
    spark = documents.sparkSession
    documents = only(documents, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    rows = materialize(sketches(documents, width, k), "sketches")
    classes = materialize(rows.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd")), "classes")
    lists = materialize(inverted_lists(classes, k), "lists")
    free_shuffles(spark)
    wanted = meet(classes, lists.select("class").distinct(), "class", "left_semi").select("class", "one.doc_id", "one.text_hash")
    sets = materialize(full_sets(documents, wanted, width), "sets")
    free_shuffles(spark)

    led = materialize(lists.groupBy("value").agg(F.max(F.struct("weight", "class")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("value", F.col("top.class").alias("leader")), "leaders")
    members = materialize(meet(lists, led, "value").select("value", "class", "leader"), "members")
    stars = materialize(members.where("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct(), "star-pairs")
    edges = materialize(compared(stars, classes, sets, k).where(100 * F.col("common") >= PERCENT * F.col("joint")).select("a", "b"), "stars")
    return rows, across(lists.withColumnRenamed("value", "key"), classes, sets, edges, k)


def representatives(documents: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """documents (doc_id, text): doc_id and text_hash of the row with the least of each group of linked texts, and of each row with an empty set.

    Rows with equal doc_id are texts like any others here: only links put them into one group.
    """
    return tidied("representatives", lambda: least_rows(*linked(documents, width, k)))


def least_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    placed = meet(rows.where("n_shingles > 0"), labels.withColumnRenamed("node", "class"), "class", "left", few(labels)).withColumn("label", F.coalesce("label", "class"))
    least = placed.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    return least.union(rows.where("n_shingles = 0").select("doc_id", "text_hash").distinct())


def near_duplicates(documents: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """documents (doc_id, text): doc_id, n_shingles, component_id, kept, in one row for each of documents.

    With a k of a quarter more than the largest set, sketches are whole sets, and no link at all can be lost.
    """
    return tidied("near-duplicates", lambda: with_components(*linked(documents, width, k)))


def with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    # classes that share a document are one component too
    placed = meet(rows.where("n_shingles > 0").select("doc_id", "class"), labels.select(F.col("node").alias("class"), "label"), "class", "left", few(labels)).select("doc_id", "class", F.coalesce("label", "class").alias("label"))
    repeated = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("a", "b")
    tied = meet(placed, repeated.select("a").union(repeated.select("b")).distinct().withColumnRenamed("a", "label"), "label", "left_semi") if not repeated.isEmpty() else None
    if tied is not None:
        links = meet(tied.where("doc_id is not null"), tied.where("doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("least")), "doc_id").where("label <> least").select(F.col("label").alias("a"), F.col("least").alias("b")).distinct()
        over = components(links)
        placed = meet(placed, over.select(F.col("node").alias("label"), F.col("label").alias("over")), "label", "left").select("doc_id", "class", F.coalesce("over", "label").alias("label"))
    # written, so that both sides of the join are shuffled for it, and Spark can split a large component
    groups = materialize(placed.groupBy("label").agg(F.min("doc_id").alias("component_id")), "groups")
    by_class = meet(placed.select("class", "label").distinct(), groups, "label").select("class", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = meet(rows.select("doc_id", "n_shingles", "class"), by_class, "class", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


QUERIES = {"op3_near_dedup": op3}
#: All pairs of classes that share a shingle, and all that can be reached from each class.
ORACLES = {
    "op3_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), d AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS c FROM s),
c AS (SELECT c, min(doc_id) AS least, any_value(s) AS s, any_value(n) AS n FROM d WHERE n > 0 GROUP BY c),
x AS (SELECT c, n, unnest(s) AS x FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT r.a AS c, min(least) AS component_id FROM r JOIN c ON r.b = c.c GROUP BY r.a)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM d LEFT JOIN m USING (c)
"""
}
