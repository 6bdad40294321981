"""BPE encoding and decoding of whole texts.

A word's symbols form a doubly linked list; the pairs that may merge wait in a priority queue by (rank, place), and
entries whose symbols have changed meanwhile are skipped. Ids are those of the tokenizers library for the same file;
decoding joins the vocabulary's strings, as that library does for a file without a decoder, or turns their
characters back into bytes for a byte-level file. Null texts count as empty: no ids, an empty decoded text.
Repeated rows and ids each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import only, table, text_blocks
from .tokens import CONTRACTIONS, LETTERS, vocabulary_path

#: Words kept by a worker; when full, the cache starts anew.
CACHE_WORDS = 250_000
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it can be printed, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end_of_word: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocabulary | self.special).items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocabulary[a], self.vocabulary[b]] = rank, self.vocabulary[a + b]
        self.symbols = byte_symbols()
        self.first = [self.vocabulary.get(c) for c in self.symbols]
        self.final = [self.vocabulary.get(c + self.end_of_word) for c in self.symbols]
        self.folds = spec["normalizer"] is not None
        self.decodes_bytes = spec["decoder"] is not None
        words = rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+" if self.folds else rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
        self.any_words = regex.compile(words).findall
        self.simple = re.compile(f"[ \\n\\t!-~{LETTERS}]*").fullmatch
        self.simple_words = re.compile(f"[{LETTERS}]+|{CONTRACTIONS}|[0-9]|[^ \\n\\t0-9{LETTERS}]+").findall if self.folds else self.any_words
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.byte_of = {c: b for b, c in enumerate(self.symbols)}

    def merge(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            left = symbols[i]
            j = after[i] if left >= 0 else -1
            if j < 0 or merges.get((left, symbols[j]), (-1,))[0] != rank:
                continue  # stale: a neighbour has merged since
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                found = merges.get((new, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], new))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1]))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        first = self.first
        symbols = [first[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return self.merge([s for s in symbols if s is not None])

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens; those of the text's own special tokens are given as they are."""
        if "<|" not in text and self.simple(text):
            return self.simple_words(text.lower() if self.folds else text)
        out: list[str] = []
        for part in self.cut(text):
            if part in self.special:
                out.append("\0" + part)
            elif part:
                out += self.any_words("".join(c.lower() for c in unicodedata.normalize("NFC", part)) if self.folds else part)
        return out

    def word_ids(self, word: str) -> list[int]:
        if word[0] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        return self.word(word)

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words(text) for i in self.word_ids(word)]

    def decode(self, ids: list[int]) -> str:
        strings = [self.strings[i] for i in ids]
        if not self.decodes_bytes:
            return " ".join(strings)
        return b"".join(bytes(self.byte_of[c] for c in s) if all(c in self.byte_of for c in s) else s.encode() for s in strings).decode(errors="replace")


@cache
def own_bpe(path: str) -> Bpe:
    """One for each worker process."""
    return Bpe(path)


def encode_documents(documents: DataFrame, tokenizer: str, keep_ids: bool = True) -> DataFrame:
    """documents (doc_id, text): doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256, and with keep_ids ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = own_bpe(tokenizer)
        numbers: dict[str, str] = {}  # a word's ids in decimal
        strings: dict[str, str] = {}  # its decoded string
        whole = bpe.decodes_bytes
        for batch, texts in text_blocks(batches):
            if len(numbers) > CACHE_WORDS:
                numbers.clear()
                strings.clear()
            words = [bpe.words(t) if t else [] for t in texts]
            for word in set().union(*words).difference(numbers):
                ids = bpe.word_ids(word)
                numbers[word] = " ".join(map(str, ids))
                strings[word] = "" if whole else bpe.decode(ids)
            ids = [" ".join(map(numbers.__getitem__, w)) for w in words]
            decoded = [bpe.decode(list(map(int, i.split()))) for i in ids] if whole else [" ".join(map(strings.__getitem__, w)) for w in words]
            out = [batch.column("doc_id"), pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64()), pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids]), pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
            if keep_ids:
                out += [pa.array([list(map(int, i.split())) for i in ids], pa.list_(pa.int32())), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return only(documents, doc_id="long", text="string").mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), keep_ids=False)


QUERIES = {"op5_bpe": op5}
ORACLES: dict[str, str] = {}
