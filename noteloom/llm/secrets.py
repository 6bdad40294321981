"""Secret scan: fixed patterns, and guess costs of values in a credential context.

Spans are code points, end exclusive. Base kinds: assign, access, hex. The method adds kind guess: the value of a
credential-like name is segmented into words (of the tokenizers' vocabularies), dates, repeats, keyboard walks and brute-force characters so that the
logarithm of the guesses is least; values that still take 10 ** GUESS_LIMIT guesses or more are reported. A value that is
cheap to guess is judged once: of the names in it, only one at its end, whose value comes after it, is looked at.
Null and empty texts have no spans; texts are scanned whole, in time linear in their length. Repeated rows
and ids are scanned each. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import numbered, only, table, text_blocks
from .tokens import vocabulary_path

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # runs end where [0-9a-f]+ ends: the same spans as [0-9a-f]+ of 24 or more
#: Names of credentials. Those that end ordinary words too (compass, Reisepass) start a word or a camelCase hump; the others may
#: follow letters (dbpassword). A scheme before the value is no part of it.
CONTEXT = re.compile(
    r"""(?:(?ai:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|client|auth)[_-]?(?:key|secret|token)|credentials?|authorization)"""
    r"""|(?:(?<![^\W\d_])|(?<=[a-z])(?=[A-Z]))(?ai:pass|auth|bearer|login))["']?[\x20\t]*[:=][\x20\t]*["']?(?ai:(?:bearer|basic|token)[\x20\t]+)?([!-&(-~À-ÖØ-öø-ɏ]{6,})"""
)
#: No name with its quote and sign takes more characters.
LONGEST_NAME = 32
GUESS_LIMIT = 10.0
#: Common words of passwords and placeholders, commonest first; those of the vocabularies follow.
WORDS = """password secret token admin user login test example changeme default root guest welcome letmein master access
dragon monkey shadow sunshine princess football baseball superman batman iloveyou trustno hello freedom whatever
ninja mustang michael jordan hunter killer soccer hockey george charlie andrew thomas robert daniel jessica ashley
summer winter spring autumn flower orange banana cookie computer internet server system service client database
private public demo sample dummy placeholder your here none null true false string value insert enter xxxx todo
redacted masked hidden undefined empty""".split()  # fmt: skip
#: Rows of keys, each with its shift to the right, in widths of a key.
ROWS = (("1234567890", 0.0), ("qwertyuiop", 0.5), ("asdfghjkl", 0.75), ("zxcvbnm", 1.25))
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
LEET = str.maketrans("013457$@", "oleastsa")
DATE = re.compile(r"(?:19|20)\d{2}[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d{2}|(?:19|20)\d{2}")
_PLACE = {c: (x + shift, y) for y, (row, shift) in enumerate(ROWS) for x, c in enumerate(row)}
#: The direction from each key to those beside, above and below it, and from each letter to those before and after it.
STEPS = (
    {a + b: (x2 > x1, y2 - y1) for a, (x1, y1) in _PLACE.items() for b, (x2, y2) in _PLACE.items() if a != b and abs(x2 - x1) <= 1 and abs(y2 - y1) <= 1},
    {line[i : i + 2]: line[0] for line in (ALPHABET, ALPHABET[::-1]) for i in range(len(line) - 1)},
)
SEGMENT = math.log10(2)
#: Vocabularies in order of merges, so the commoner the earlier: English words, and words of many languages.
VOCABULARIES = ("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken")


def vocabulary_words(name: str) -> list[str]:
    """The tokens that are four letters or more, in their order."""
    with open(vocabulary_path(name), encoding="utf-8") as f:
        if name.endswith(".json"):
            ids = json.load(f)["model"]["vocab"]
            tokens = [t.removesuffix("</w>") for t in sorted(ids, key=ids.get) if t.isascii()]  # others are bytes in disguise
        else:
            tokens = [base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip(" ") for line in f if line.strip()]
    return [t.lower() for t in tokens if len(t) >= 4 and t.isalpha()]


@cache
def ranks() -> tuple[dict[str, int], int]:
    """Each word's rank, and the length of the longest."""
    found = {w: i + 1 for i, w in enumerate(WORDS)}
    for name in VOCABULARIES:
        words = dict.fromkeys(w for w in vocabulary_words(name) if w not in WORDS)
        for i, w in enumerate(words, len(WORDS) + 1):
            found[w] = min(i, found.get(w, i))
    return found, max(map(len, found))


def guess_cost(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses of the cheapest segmentation, and its segments (kind, start, end)."""
    n = len(value)
    low = value.lower()
    if len(low) != n:  # a character whose lower case is longer
        low = value
    plain = low.translate(LEET)
    spans: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]  # by end: (start, cost, kind)
    i = 0
    while i < n:  # runs of one character
        j = i + 1
        while j < n and value[j] == value[i]:
            j += 1
        if j - i >= 3:
            spans[j].append((i, math.log10(36 * (j - i)), "repeat"))
        i = j
    for period in (2, 3, 4):  # runs of a short unit
        i = 0
        while i + 2 * period <= n:
            j = i + period
            while j < n and value[j] == value[j - period]:
                j += 1
            if j - i >= 2 * period:
                spans[j].append((i, math.log10(36**period * (j - i) / period), "repeat"))
                i = j - period + 1
            else:
                i += 1
    for steps in STEPS:  # walks over the keys, or the alphabet; each turn has four ways to go
        i = 0
        while i < n - 2:
            j, turns, before = i + 1, -1, None
            while j < n and (way := steps.get(low[j - 1 : j + 1])) is not None:
                turns += way != before
                before = way
                j += 1
            if j - i >= 3:
                spans[j].append((i, math.log10(50 * (j - i)) + turns * math.log10(4), "walk"))
            i = max(j - 1, i + 1)
    for m in DATE.finditer(value):
        spans[m.end()].append((m.start(), math.log10(365 * 120 * 4 if len(m[0]) > 4 else 120), "date"))
    rank_of, longest = ranks()
    letters = 0  # where the run of letters that ends here begins: words have no others
    for end in range(1, n + 1):
        if not plain[end - 1].isalpha():
            letters = end
        for start in range(max(letters, end - longest), end - 3):
            rank = rank_of.get(plain[start:end])
            if rank:
                raw = value[start:end]
                changed = (2 if raw != low[start:end] else 1) * (2 if low[start:end] != plain[start:end] else 1)
                spans[end].append((start, math.log10(rank * changed + 1), "word"))
    best, back = [0.0] * (n + 1), [(0, "")] * (n + 1)
    for end in range(1, n + 1):
        c = value[end - 1]
        size = 10 if c.isdigit() else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33
        fresh = back[end - 1][1] != "brute"
        best[end], back[end] = best[end - 1] + math.log10(size) + SEGMENT * fresh, (end - 1, "brute")
        for start, cost, kind in spans[end]:
            if (total := best[start] + cost + SEGMENT) < best[end]:
                best[end], back[end] = total, (start, kind)
    segments: list[tuple[str, int, int]] = []
    end = n
    while end:
        start, kind = back[end]
        if kind == "brute" and segments and segments[-1][0] == "brute":
            segments[-1] = ("brute", start, segments[-1][2])
        else:
            segments.append((kind, start, end))
        end = start
    return best[n], segments[::-1]


def scan(text: str, guess_limit: float = GUESS_LIMIT) -> list[tuple[int, int, int]]:
    """Spans (start, end, kind's place in KINDS), sorted by start, then kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
        at, judged = 0, 0
        while m := CONTEXT.search(text, at):
            if m.start(1) < judged:  # the end of a run that is cheap
                at = m.start() + 1
                continue
            value, judged = m[1].rstrip("\",;)]}"), m.end()
            at = judged
            if len(value) >= 6 and guess_cost(value)[0] >= guess_limit:
                spans.append((m.start(1), m.start(1) + len(value), 3))
            else:  # its end may be the name before a secret
                at = max(m.start(1), judged - LONGEST_NAME)
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1])) if spans else spans


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[redacted]") -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def scan_documents(documents: DataFrame, guess_limit: float = GUESS_LIMIT) -> DataFrame:
    """documents (doc_id, text): doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            found = [scan(t, guess_limit) for t in texts]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in found], pa.int64()) for k in range(4)]
            base = [",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans if k < 3) for spans in found]
            every = [",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans) for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array(every)], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return only(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact_documents(documents: DataFrame, guess_limit: float = GUESS_LIMIT) -> DataFrame:
    """documents with each secret replaced by a mark; the other columns, whatever their names, stay as they are."""
    rows, at = numbered(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, at["text"]):
            place = batch.schema.get_field_index(at["text"])
            column = batch.column(place)
            clean = pa.array([redact(t, scan(t, guess_limit)) if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)], column.type)
            yield batch.set_column(place, batch.schema.field(place), clean)

    return rows.mapInArrow(run, rows.schema).toDF(*documents.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_secret_scan": op2}
ORACLES: dict[str, str] = {}
