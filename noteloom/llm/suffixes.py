"""Suffix-array deduplication: the bytes covered by a LENGTH-byte string that starts at two places.

1. Anchors. Of the GRAM-byte strings within each LENGTH-byte window, the one with the least hash is the window's anchor;
   equal windows have equal anchors at equal offsets. An anchor stands for all windows that chose it, about one for each
   170 bytes of text. Only anchors whose hash occurs twice or more go on.
2. Fragments. The bytes of an anchor's windows travel, with those of all anchors of that hash, to one task.
3. Groups too large for one task (over GROUP fragments) are split by further bytes, until none is. Equal fragments of
   a group are one from then on, and all their windows are repeated. The windows of the others are dealt, by the
   anchor's offset in the window, to PARTS ranges; all windows of a range share more bytes than the anchor's, and these
   bytes are the new group's key. A range of one offset has whole windows as keys, so this ends.
4. Sorting. The suffixes that start at anchors are sorted deep-shallow: multikey quicksort, eight bytes a character,
   to a shallow depth, then a blind trie for each group that still shares a prefix. So are the reversed strings before
   the anchors. A window is repeated if and only if it has the same right class (from the common prefixes of sorted
   suffixes) and the same left class as another.

Keys of 64 bits only bring fragments together; sorting decides. Two things are taken as equal by 128 bits of SHA-256:
whole texts, and fragments of groups that are split. Texts that equal another as a whole are repeated as a whole, and
only one of them is a witness for the others.
Null texts count as empty. Texts shorter than LENGTH keep all bytes. Rows with equal doc_id are documents of their
own, so equal rows repeat each other. An empty table gives an empty result. The id -2^63 stands for null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_blocks, free_shuffles, materialize, numbered, table, tidied
from .words import U64, mix

LENGTH, GRAM = 400, 64
#: 50 words of five bytes, the blank included: a passage of more words is caught unless its words are shorter on average.
PASSAGE = 250
#: Fragments of one group that a task sorts at most (3 MB at LENGTH 400); larger groups are split PARTS ways a round. It steers cost, not results.
GROUP, PARTS = 4000, 4
#: Fragments sorted at once (whole groups, so up to GROUP more).
SORT_MEMBERS = 4000
#: Places that a task turns into runs of documents at once; more only if one document has them.
PLACES = 1 << 15
NO_ID = -(1 << 63)
_PLACE_BITS = 21
_random = np.random.Generator(np.random.PCG64(77))
_BYTES = _random.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]
#: A fragment: the bytes of spans windows from first on, with `before` bytes before the anchor; the anchor's offset in a window is from low to high; salts: parts to which a large group's equal fragments are dealt.
FRAGMENT = {"key": pa.int64(), "same": pa.binary(), "k1": pa.int64(), "k2": pa.int64(), "copied": pa.bool_(), "low": pa.int32(), "high": pa.int32(), "salts": pa.int64(), "first": pa.int64(), "before": pa.int64(), "spans": pa.int64(), "data": pa.binary()}
FRAGMENTS = "key long, same binary, k1 long, k2 long, copied boolean, low int, high int, salts long, first long, before long, spans long, data binary"
RUNS = "k1 long, k2 long, start long, end long"


# --- anchors -----------------------------------------------------------------


def rolling(raw: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each string of that many bytes."""
    base, parts, n, value = _BASES[which], [], 1, _BYTES[which][raw]
    rest = length
    while True:  # hashes of 1, 2, 4 ... bytes; those of length's binary digits make up the whole
        if rest & 1:
            parts.append((n, value))
        rest >>= 1
        if not rest:
            break
        value = value[:-n] * U64(pow(base, n, 1 << 64)) + value[n:]
        n *= 2
    count = len(raw) - length + 1
    out, at = np.zeros(count, U64), 0
    for n, value in reversed(parts):
        out = out * U64(pow(base, n, 1 << 64)) + value[at : at + count]
        at += n
    return mix(out)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    n = 1
    count = len(values) - width + 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return values[:count] if n == width else np.minimum(values[:count], values[width - n : width - n + count])


def find_anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: hashes and places of its anchors, and the first and last start of the windows of each."""
    nothing = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = [nothing] * len(texts)
    limit = 1 << 20
    group: list[int] = []
    size = 0

    def whole(members: list[int]) -> None:
        joined = np.frombuffer(b"".join(texts[i] for i in members), np.uint8)
        ends = np.cumsum([len(texts[i]) for i in members])
        starts = ends - np.array([len(texts[i]) for i in members])
        hashes = rolling(joined, gram)
        low = U64((1 << _PLACE_BITS) - 1)
        least = sliding_minimum((hashes & ~low) | np.arange(len(hashes), dtype=U64), length - gram + 1)
        owner = (least & low).astype(np.int64)
        valid = np.zeros(len(owner) + 1, np.int8)
        np.add.at(valid, starts, 1)
        np.add.at(valid, np.minimum(ends - length + 1, len(owner)), -1)
        valid = np.cumsum(valid[:-1]).astype(bool)
        owner[~valid] = -1
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        last = np.append(first[1:], len(owner)) - 1
        real = owner[first] >= 0
        first, last = first[real], last[real]
        place = owner[first]
        cuts = np.searchsorted(first, ends)
        before = 0
        for i, start, cut in zip(members, starts.tolist(), cuts.tolist(), strict=True):
            part = slice(before, cut)
            out[i] = (hashes[place[part]], place[part] - start, first[part] - start, last[part] - start)
            before = cut

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > limit:  # in overlapping parts, each window in one of them
            parts = []
            for at in range(0, len(text) - length + 1, limit - length):
                found = find_anchors([text[at : at + limit - 1]], length, gram)[0]
                parts.append((found[0], *(x + at for x in found[1:])))
            out[i] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            continue
        if size + len(text) > limit:
            whole(group)
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        whole(group)
    return out


def clipped(found: tuple[np.ndarray, ...], windows: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Anchors as in find_anchors(), of the windows that start from one of the first to the last places only; an anchor may come several times."""
    hashes, place, first, last = found
    starts, stops = (np.array([x[k] for x in windows], np.int64) for k in (0, 1))
    begin = np.searchsorted(stops, first)
    n = np.maximum(np.searchsorted(starts, last, "right") - begin, 0)
    at = np.repeat(np.arange(len(first)), n)
    run = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return hashes[at], place[at], np.maximum(first[at], starts[run]), np.minimum(last[at], stops[run])


# --- sorting -----------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of big-endian words, and which of them in that order equal their predecessor.

    All segments are parted in step: below, at and above their pivots; the middle parts go on to the next word.
    """
    n, depth_end = words.shape
    order = np.arange(n)
    starts, depths = np.zeros(1, np.int64), np.zeros(1, np.int64)  # of segments; ends are the next starts
    done_equal = np.zeros(n, bool)
    if n == 0:
        return order, done_equal
    sizes = np.array([n])
    while len(starts):
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        segment = np.repeat(np.arange(len(starts)), sizes)
        rows = order[at]
        value = words[rows, depths[segment]]
        pivot = words[order[starts + sizes // 2], depths][segment]
        part = segment * 3 + (value >= pivot) + (value > pivot)
        moved = np.argsort(part, kind="stable")
        order[at] = rows[moved]
        part = part[moved]
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        new_sizes = np.diff(np.append(edge, len(part)))
        middle = part[edge] % 3 == 1
        new_depths = depths[part[edge] // 3] + middle
        new_starts = at[edge]
        full = (new_depths == depth_end) & (new_sizes > 1)
        for a, m in zip(new_starts[full].tolist(), new_sizes[full].tolist(), strict=True):
            done_equal[a + 1 : a + m] = True
        on = (new_sizes > 1) & (new_depths < depth_end)
        starts, sizes, depths = new_starts[on], new_sizes[on], new_depths[on]
    return order, done_equal


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of strings, and the common prefix of each with the one before (0 for the first).

    Inner nodes hold only the depth where strings part. A string first goes down blindly, by the bytes at those depths;
    one comparison with the leaf it meets tells where it parts from the trie.
    """
    # a node: [depth, {byte: node or leaf}]; a leaf: list of equal strings' numbers
    root: list | tuple = ([0],)
    for i in range(1, len(strings)):
        s, n = strings[i], len(strings[i])
        node = root
        while isinstance(node, list):
            branch = node[1]
            depth = node[0]
            node = branch.get(s[depth] if depth < n else -1) or next(iter(branch.values()))
        other = strings[node[0][0]]
        part = common_prefix(s, other)
        if part == n == len(other):
            node[0].append(i)
            continue
        parent, node = None, root
        while isinstance(node, list) and node[0] < part:
            parent, node = node, node[1][s[node[0]]]
        own = s[part] if part < n else -1
        if isinstance(node, list) and node[0] == part:
            node[1][own] = ([i],)
            continue
        new = [part, {own: ([i],), other[part] if part < len(other) else -1: node}]
        if parent is None:
            root = new
        else:
            parent[1][s[parent[0]]] = new
    order: list[int] = []
    common: list[int] = []
    stack = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, list):
            depth = node[0]
            children = sorted(node[1].items())
            for _, child in reversed(children[1:]):
                stack.append((child, depth))
            stack.append((children[0][1], shared))
        else:
            same = node[0]
            order += same
            common.append(shared)
            common += [len(strings[same[0]])] * (len(same) - 1)
    return order, common


def deep_shallow(strings: list[bytes], shallow: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of strings, and the common prefix of each with the one before (0 for the first)."""
    n = len(strings)
    head = b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings)
    words = np.frombuffer(head, ">u8").astype(U64).reshape(n, shallow // 8)
    order, equal = multikey_quicksort(words)
    lengths = np.array([len(s) for s in strings], np.int64)[order] if n else np.zeros(0, np.int64)
    common = np.zeros(n, np.int64)
    if n > 1:
        bytes_ = np.frombuffer(head, np.uint8).reshape(n, shallow)[order]
        differ = bytes_[1:] != bytes_[:-1]
        first = np.where(differ.any(1), differ.argmax(1), shallow)
        common[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    starts = np.flatnonzero(equal & ~np.concatenate(([False], equal[:-1]))) - 1
    edges = np.flatnonzero(~equal)
    stops = np.append(edges, n)[np.searchsorted(edges, starts, "right")]
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        members = order[a:b].tolist()
        inside, shared = blind_trie([strings[i] for i in members])
        order[a:b] = [members[i] for i in inside]
        common[a + 1 : b] = shared[1:]
        if a:  # the first of the group may have changed
            common[a] = common_prefix(strings[order[a - 1]], strings[order[a]])
        if b < n:
            common[b] = common_prefix(strings[order[b - 1]], strings[order[b]])
    return order, common


def repeated_windows(fragments: list[bytes], before: np.ndarray, spans: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of fragments occur in another fragment: a row for each, by the window's start.

    before: bytes before the anchor; spans: the number of windows. Fragments of several groups may come together: windows of different groups differ.
    """
    n = len(fragments)
    rights = [f[b:] for f, b in zip(fragments, before.tolist(), strict=True)]
    lefts = [f[:b][::-1] for f, b in zip(fragments, before.tolist(), strict=True)]
    order_r, common_r = deep_shallow(rights)
    order_l, common_l = deep_shallow(lefts, 16)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    most = int(spans.max())
    out = np.zeros((n, most), bool)
    shortest, longest = int((before - spans + 1).min()), int(before.max())
    for d in range(shortest, longest + 1):  # d: the anchor's offset in the window
        start = before - d
        rows = np.flatnonzero((start >= 0) & (start < spans))
        if len(rows) < 2:
            continue
        class_r[order_r] = np.cumsum(common_r < length - d)
        class_l[order_l] = np.cumsum(common_l < d)
        key = class_r[rows] * (n + 1) + class_l[rows]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        if same.any():
            twice = np.zeros(len(rows), bool)
            twice[by[1:][same]] = True
            twice[by[:-1][same]] = True
            found = rows[twice]
            out[found, start[found]] = True
    return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags in each row: row, first, last."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    rows, first = np.nonzero(step == 1)
    return rows, first, np.nonzero(step == -1)[1] - 1


# --- tables ------------------------------------------------------------------


def keyed(documents: DataFrame) -> DataFrame:
    """k1, k2: what tells documents apart; text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def anchors(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """k1, k2, n_bytes, same (a digest of the text), found: array of (hash, place, first, last). Where documents have a column inside, of the windows in these runs only."""
    limited = "inside" in documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_blocks(batches):
            if limited:
                windows = [[(a, b - length) for a, b in merged(runs) if b - a >= length] for runs in batch.column("inside").to_pylist()]
                searched = find_anchors([t if w else b"" for t, w in zip(texts, windows, strict=True)], length, gram)
                found = [clipped(f, w) for f, w in zip(searched, windows, strict=True)]
            else:
                found = find_anchors(texts, length, gram)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))), pa.int32())
            hashes, place, first, last = (np.concatenate([f[k] for f in found]) for k in range(4))
            items = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(place, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["hash", "place", "first", "last"])
            digests = pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array([len(t) for t in texts], pa.int64()), digests, pa.ListArray.from_arrays(offsets, items)], names=["k1", "k2", "n_bytes", "same", "found"])

    return documents.mapInArrow(run, "k1 long, k2 long, n_bytes long, same binary, found array<struct<hash: long, place: int, first: int, last: int>>")


def part_of(row: dict, low: int, high: int, length: int) -> dict | None:
    """A fragment's windows whose anchor's offset is from low to high, as a fragment of the group that shares their common bytes; None without such windows."""
    least, most = max(low, row["before"] - row["spans"] + 1), min(high, row["before"])
    if least > most:
        return None
    start = row["before"] - most  # in row's data
    data = row["data"][start : row["before"] - least + length]
    common = data[most - low : most + length - high]
    key = hashlib.sha256(b"%d %d %d " % (row["key"], low, high) + common).digest()[:8]
    same = hashlib.sha256(b"%d %d " % (least, most) + data).digest()[:16]
    changed = {"key": int.from_bytes(key, "little", signed=True), "same": same, "low": low, "high": high, "first": row["first"] + start, "before": most, "spans": most - least + 1, "data": data}
    return row | changed


def fragments_of(batches: Iterator[pa.RecordBatch], length: int, gram: int, split: bool) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, copied, found, text): the fragment of each anchor found; split: as a fragment of a group that is to be split."""
    for batch in batches:
        found = plain_fragments(batch, length, gram)
        if split:
            yield from fragment_batches(part_of(row, 0, length - gram, length) for part in found for row in part.to_pylist())
        else:
            yield from found


def plain_fragments(batch: pa.RecordBatch, length: int, gram: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    lists = batch.column("found")
    items = lists.flatten()
    hashes, place, first, last, salts = (np.asarray(x).astype(np.int64) for x in items.flatten())
    row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
    texts = [t.encode() for t in batch.column("text").to_pylist()]
    edges = np.flatnonzero(np.diff(np.cumsum(last - first + length) // limit)) + 1
    for part in np.split(np.arange(len(row)), edges) if len(row) else ():
        a, b, owner = first[part], last[part], row[part]
        data = [texts[r][i:j] for r, i, j in zip(owner.tolist(), a.tolist(), (b + length).tolist(), strict=True)]
        columns = {
            "key": hashes[part], "same": pa.nulls(len(part), pa.binary()), "low": np.zeros(len(part), np.int32), "high": np.full(len(part), length - gram, np.int32), "salts": salts[part],
            "first": a, "before": place[part] - a, "spans": b - a + 1, "data": data,
        } | {c: batch.column(c).take(pa.array(owner)) for c in ("k1", "k2", "copied")}
        yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[c], pa.Array) else pa.array(x, kind) for c, kind in FRAGMENT.items()], names=list(FRAGMENT))


def fragment_batches(rows: Iterator[dict], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row["data"])
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, pa.schema(FRAGMENT))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, pa.schema(FRAGMENT))


def united(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of documents in order of k1, k2 and start; overlapping and touching ones are one."""
    order = np.lexsort((start, k2, k1))
    k1, k2, start, end = k1[order], k2[order], start[order], end[order]
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    above = np.cumsum(new) * (int(end.max(initial=0)) + 1)  # so that no end reaches into the next document
    reach = np.maximum.accumulate(above + end)
    new[1:] |= (above + start)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return k1[first], k2[first], start[first], (reach - above)[np.append(first[1:], len(new))[: len(first)] - 1]


def listed(counts: np.ndarray, **columns: np.ndarray) -> pa.Array:
    """Lists of so many structs each."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in columns.values()], names=list(columns)))


def document_runs(places: DataFrame, n: int, at_once: int = PLACES) -> DataFrame:
    """places: lists of (k1, k2, start, end), n of them in all: k1, k2, runs, a row a document.

    Places become no rows: a task gives what it has of a bucket of documents as one list, runs that touch united.
    """
    buckets = max(1, -(-n // at_once))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, start, end = united(*map(np.asarray, batch.column("places").flatten().flatten()))
            bucket = (mix(k1.view(U64) ^ mix(k2.view(U64))) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            numbers, counts = np.unique(bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), listed(counts, k1=k1[order], k2=k2[order], start=start[order], end=end[order])], names=["bucket", "places"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of bucket."""
        held: list[pa.StructArray] = []
        current = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                k1, k2, start, end = united(*map(np.asarray, pa.concat_arrays(held).flatten()))
                first = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
                yield pa.RecordBatch.from_arrays([pa.array(k1[first]), pa.array(k2[first]), listed(np.diff(np.append(first, len(k1))), start=start, end=end)], names=["k1", "k2", "runs"])

        for batch in batches:
            lists = batch.column("places")
            for i, number in enumerate(batch.column("bucket").to_pylist()):
                if number != current:
                    yield from flush()
                    held, current = [], number
                held.append(lists.slice(i, 1).flatten())
        yield from flush()

    dealt = places.mapInArrow(deal, "bucket long, places array<struct<k1: long, k2: long, start: long, end: long>>")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "k1 long, k2 long, runs array<struct<start: long, end: long>>")


def split_groups(fragments: DataFrame, length: int, group: int, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """fragments of groups of any size, keyed by part_of(): fragments of groups of at most `group`, and what was found while splitting, as document_runs()."""

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for row in batch.to_pylist():
                    width = -(-(row["high"] - row["low"] + 1) // parts)
                    for low in range(row["low"], row["high"] + 1, width):
                        part = part_of(row, low, min(low + width - 1, row["high"]), length)
                        if part:
                            yield part

        yield from fragment_batches(rows())

    rest, found, n = [], [], 0
    large = fragments
    salt = F.pmod(F.xxhash64("k1", "k2", "first"), F.col("salts"))
    # what is least of equal fragments is their witness; an anchor's windows occur once at a place, and equal rows of a table are one witness
    row = F.struct("k1", "k2", "first", *(c for c in FRAGMENT if c not in ("k1", "k2", "first", "key", "same")))
    while True:
        # the bytes of equal fragments travel once from each task, and no list of places is longer than a part
        places = F.collect_list(F.struct("k1", "k2", F.col("first").alias("start"), (F.col("first") + F.col("spans") - 1 + length).alias("end"), "copied"))
        salted = materialize(large.groupBy("key", "same", salt.alias("salt")).agg(F.min(row).alias("one"), places.alias("places")), "salted")
        free_shuffles(fragments.sparkSession)
        kinds = materialize(salted.groupBy("key", "same").agg(F.sum(F.size("places")).alias("n"), F.min("one").alias("one")), "kinds")
        # written, so that both sides of its join are shuffled for it, and Spark can split a key that many kinds have
        numbers = materialize(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "numbers")
        equal = salted.select("key", "same", "places").join(kinds.where("n > 1").select("key", "same"), ["key", "same"])
        found.append(equal.select(F.transform(F.filter("places", lambda p: ~p["copied"]), lambda p: p.dropFields("copied")).alias("places")))
        n += kinds.where("n > 1").agg(F.sum("n")).first()[0] or 0
        left = kinds.join(numbers, "key").select("key", "same", "one.*", "n", "kinds").withColumn("copied", F.col("copied") | (F.col("n") > 1))
        rest.append(left.where(F.col("kinds") <= group).select(*FRAGMENT))
        large = left.where(F.col("kinds") > group).select(*FRAGMENT)
        if large.isEmpty():
            return reduce(DataFrame.union, rest), document_runs(reduce(DataFrame.union, found), n)
        large = large.mapInArrow(children, FRAGMENTS)


def sorted_runs(fragments: DataFrame, length: int) -> DataFrame:
    """fragments of groups of bounded size: the runs (k1, k2, start, end) of windows that two of a group have."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of key."""
        names = ("key", "k1", "k2", "copied", "first", "before", "spans", "data")
        held: list[tuple] = []
        groups = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > groups:  # else each is alone
                _, k1, k2, copied, first, before, spans, data = zip(*held, strict=True)
                k1, k2, first, before, spans = (np.array(x, np.int64) for x in (k1, k2, first, before, spans))
                flags = repeated_windows(list(data), before, spans, length)
                flags[np.array(copied, bool)] = False
                row, a, b = runs_of(flags)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[row], k2[row], first[row] + a, first[row] + b + length)], names=["k1", "k2", "start", "end"])

        current = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[0] != current:
                    if len(held) >= SORT_MEMBERS:
                        yield from flush()
                        held, groups = [], 0
                    current = row[0]
                    groups += 1
                held.append(row)
        yield from flush()

    return fragments.repartition("key").sortWithinPartitions("key").mapInArrow(find, RUNS)


def repeated_runs(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """documents (k1, k2, text): k1, k2, runs (array of start and end of repeated bytes; they may overlap)."""
    return tidied("runs", lambda: found_runs(documents, length, gram, group))


def longer_runs(documents: DataFrame, shorter: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """As repeated_runs(), given its result for a shorter length: whatever is repeated at this length lies in a run of that."""

    def found() -> DataFrame:
        inside = shorter.select("k1", "k2", F.col("runs").alias("inside"))
        limited = materialize(documents.join(inside, ["k1", "k2"]), "inside")
        free_shuffles(documents.sparkSession)
        return found_runs(limited, length, gram, group)

    return tidied("longer-runs", found)


def found_runs(documents: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    spark = documents.sparkSession
    scanned = materialize(anchors(documents, length, gram), "anchors")
    copies = materialize(scanned.groupBy("same").agg(F.min(F.struct("k1", "k2")).alias("one"), F.count(F.lit(1)).alias("n")), "copies")
    witness = scanned.where(f"n_bytes >= {length}").join(copies, "same").where((F.col("k1") == F.col("one.k1")) & (F.col("k2") == F.col("one.k2")))
    placed = witness.dropDuplicates(["k1", "k2"]).select("k1", "k2", (F.col("n") > 1).alias("copied"), F.explode("found").alias("f")).select("k1", "k2", "copied", "f.*")
    # written, so that both sides of the join are shuffled for it, and Spark can split a hash that many places have
    counts = materialize(placed.groupBy("hash").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "counts")
    found = F.collect_list(F.struct("hash", "place", "first", "last", F.ceil(F.col("members") / group).alias("salts")))
    wanted = materialize(placed.join(counts, "hash").withColumn("large", F.col("members") > group).groupBy("k1", "k2", "large").agg(F.first("copied").alias("copied"), found.alias("found")), "wanted")
    free_shuffles(spark)

    def fragments(large: bool) -> DataFrame:
        rows = documents.join(wanted.where(F.col("large") == large).drop("large"), ["k1", "k2"])
        return rows.select("k1", "k2", "copied", "found", "text").mapInArrow(lambda batches: fragments_of(batches, length, gram, large), FRAGMENTS)

    sent, runs = fragments(False), None
    if not wanted.where("large").isEmpty():
        rest, runs = split_groups(fragments(True), length, group)
        sent = sent.union(rest)
    found = sorted_runs(sent.drop("same", "low", "high", "salts"), length)
    whole = scanned.where(f"n_bytes >= {length}").join(copies.where("n > 1"), "same").select("k1", "k2", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")).distinct()
    found = found.union(whole).select("k1", "k2", F.array(F.struct("start", "end")).alias("runs"))
    return (found if runs is None else found.union(runs)).groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def merged(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching runs become one."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def within_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs cut back to whole characters."""
    out = []
    for a, b in runs:
        while a < b and a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents with repeated bytes taken out of text (whole characters only); null texts stay null. Other columns, whatever their names, stay as they are."""
    rows, at = numbered(documents)
    text, id_ = F.col(at["text"]), F.col(at["doc_id"])
    runs = repeated_runs(keyed(documents), length)
    keys = {"k1": F.coalesce(id_.cast("long"), F.lit(NO_ID)), "k2": F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))}
    joined = rows.withColumns(keys).join(runs, ["k1", "k2"], "left").select(*at.values(), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(at["text"])
            out = []
            for text, runs in zip(batch.column(place).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if text and runs:
                    raw = text.encode()
                    text = without(raw, within_characters(raw, merged(runs))).decode()
                out.append(text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.column(place).type)).drop_columns(["runs"])

    return joined.mapInArrow(run, rows.schema).toDF(*documents.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strings of LENGTH bytes leave, as digests; besides, text: what strings of PASSAGE bytes leave, so that shorter passages can be seen to go too."""
    rows = keyed(table(spark, sf_dir, "documents"))
    passages = repeated_runs(rows, PASSAGE)
    both = passages.withColumnRenamed("runs", "passages").join(longer_runs(rows, passages), ["k1", "k2"], "left")
    joined = rows.join(both, ["k1", "k2"], "left").select("k1", "text", "runs", "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            out = []
            for k1, text, runs, passages in zip(*(batch.column(c).to_pylist() for c in ("k1", "text", "runs", "passages")), strict=True):
                raw, runs = text.encode(), merged(runs)
                kept = without(raw, within_characters(raw, merged(passages))).decode() if passages else text
                out.append((None if k1 == NO_ID else k1, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(raw, runs)).hexdigest(), kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


QUERIES = {"op1_suffix_dedup": op1}
def runs_sql(length: int, name: str) -> str:
    """CTEs to name (r, a, b): the maximal runs of bytes that a string of that length covers which starts twice, of the table n (r, h: text in hexadecimal digits, n_bytes).

    Texts are cut into overlapping parts first, as substr() walks a string from its start.
    """
    return f"""
c_{name} AS (SELECT r, j, substr(h, 4000 * j + 1, 4000 + 2 * {length} - 2) AS h, least(2000, n_bytes - {length} + 1 - 2000 * j) AS k FROM (SELECT r, h, n_bytes, unnest(range(0, (n_bytes - {length}) // 2000 + 1)) AS j FROM n WHERE n_bytes >= {length})),
w_{name} AS (SELECT r, 2000 * j + i AS i, md5(substr(h, 2 * i + 1, 2 * {length})) AS m FROM (SELECT r, j, h, unnest(range(0, k)) AS i FROM c_{name})),
t_{name} AS (SELECT r, i FROM w_{name} JOIN (SELECT m FROM w_{name} GROUP BY m HAVING count(*) > 1) USING (m)),
s_{name} AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM t_{name}),
g_{name} AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM s_{name}),
{name} AS (SELECT r, min(i) AS a, max(i) + {length} AS b FROM g_{name} GROUP BY r, k)"""


def kept_sql(runs: str, name: str) -> str:
    """A CTE name (r, h): what is left of n without the runs."""
    return f"""
cuts_{name} AS (SELECT r, 0 AS p, coalesce(min(a), any_value(n_bytes)) AS q FROM n LEFT JOIN {runs} USING (r) GROUP BY r
 UNION ALL SELECT r, b, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), n_bytes) FROM {runs} JOIN n USING (r)),
{name} AS (SELECT r, string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS h FROM cuts_{name} JOIN n USING (r) GROUP BY r)"""


#: Whether the byte at a place, counted from 0, goes on a character.
_INSIDE = "substr(h, 2 * ({}) + 1, 1) IN ('8', '9', 'A', 'B')"
_FIRST = f"a + CASE WHEN NOT {_INSIDE.format('a')} THEN 0 WHEN NOT {_INSIDE.format('a + 1')} THEN 1 WHEN NOT {_INSIDE.format('a + 2')} THEN 2 ELSE 3 END"
_LAST = f"b - CASE WHEN b = n_bytes OR NOT {_INSIDE.format('b')} THEN 0 WHEN NOT {_INSIDE.format('b - 1')} THEN 1 WHEN NOT {_INSIDE.format('b - 2')} THEN 2 ELSE 3 END"
ORACLES = {
    "op1_suffix_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT r, doc_id, h, length(h) // 2 AS n_bytes FROM d),{runs_sql(LENGTH, "runs")},{kept_sql("runs", "kept")},{runs_sql(PASSAGE, "passages")},
whole AS (SELECT r, {_FIRST} AS a, {_LAST} AS b FROM passages JOIN n USING (r)),{kept_sql("whole", "rest")},
sums AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT n.doc_id, n.n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256, decode(unhex(rest.h)) AS text
FROM n JOIN kept USING (r) JOIN rest USING (r) LEFT JOIN sums USING (r)
"""
}
