"""Token ids of whole texts, as the tokenizers library gives them, with a bounded cache of pieces."""

from __future__ import annotations

import itertools
import os
import re
from array import array
from functools import cache

import numpy as np

#: Pieces kept by a worker (about 150 bytes each); when full, the cache starts anew.
CACHE_PIECES = 500_000
#: Letters, digits and marks of which each character is normalised and classed by itself, alike in Python and in the library.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
NEWLINE_ID = 198


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The pieces of a byte-level vocabulary where no two characters of white space stand side by side: without looking ahead, which is the slow part of the pattern.
SINGLE_SPACED = f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[^ \\n\\t0-9{LETTERS}]+|[ \\n\\t]"


def ranked(path: str, pattern: str | None = None):
    """A byte-level vocabulary in tiktoken's format; pattern: of its pieces, if not its own."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: By byte, in texts whose only characters are LETTERS, ASCII marks and white space: white space, letters, digits, marks.
KIND = np.full(256, 3, np.uint8)
KIND[:33], KIND[128:], KIND[48:58] = 0, 1, 2
KIND[65:91] = KIND[97:123] = 1
#: The first so many bytes of a number of eight.
FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Words:
    """encode(texts): ids of singly spaced texts (as bytes) of a byte-level vocabulary, cut into words that are looked up together.

    A word is a run of letters, digits or marks with the white space before it; whatever stands beside it, it has the same pieces. What follows an apostrophe
    stays with it, as the two may be a contraction. A word of at most 16 bytes and MOST_IDS ids is kept in the place that its bytes
    hash to, until another takes that place; it is told by all its bytes. Other words are encoded anew in each call.
    """

    BITS, MOST_IDS = 20, 8
    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, single_spaced, bits: int = BITS):
        self.ranked, self.shift, places = single_spaced, np.uint64(64 - bits), 1 << bits
        self.sizes = np.zeros(single_spaced.n_vocab, np.int64)
        for token, number in single_spaced._mergeable_ranks.items():
            self.sizes[number] = len(token)
        self.low, self.high, self.n = np.zeros(places, np.uint64), np.zeros(places, np.uint64), np.zeros(places, np.uint8)
        self.ids = np.zeros((places, self.MOST_IDS), "<u2" if single_spaced.n_vocab <= 1 << 16 else "<u4")

    @staticmethod
    def starts(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where words begin; begins: where texts do."""
        kind = KIND[symbols]
        new = np.ones(len(symbols), bool)
        before, here = kind[:-1], kind[1:]
        new[1:] = (here == 0) | ((here != before) & (before != 0) & ((here != 1) | (symbols[:-1] != ord("'"))))
        new[begins] = True
        return np.flatnonzero(new)

    def _asked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words one after the other, where each word's begin, and how many it has."""
        # a line's end between two words is a piece of one id
        ids = self.ranked.encode_to_numpy((b"\n" + b"\n".join(words)).decode()).astype("<u4")
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w) + 1 for w in words])) + 1
        begins = np.append(0, stops[:-1]) + 1
        return ids, begins, stops - begins

    def encode(self, texts: list[bytes]) -> list[bytes]:
        raw = b"".join(texts)
        if not raw:
            return [b""] * len(texts)
        ends = np.cumsum([len(t) for t in texts])
        begins = np.append(0, ends[:-1])
        padded = raw + bytes(16)
        starts = self.starts(np.frombuffer(raw, np.uint8), begins[begins < ends])
        stops = np.append(starts[1:], len(raw))
        length = stops - starts
        numbers = np.ndarray(len(raw) + 9, np.uint64, padded, 0, (1,))  # eight bytes from each place on
        low, high = numbers[starts] & FIRST_BYTES[np.minimum(length, 8)], numbers[starts + np.minimum(length, 8)] & FIRST_BYTES[np.clip(length - 8, 0, 8)]
        mixed = low * self.SPREAD
        place = (((mixed ^ (mixed >> np.uint64(32)) ^ high) * self.SPREAD) >> self.shift).view(np.int64)
        hit = (self.low[place] == low) & (self.high[place] == high) & (length <= 16)
        n = self.n[place].astype(np.int64)
        found, lost = np.flatnonzero(hit), np.flatnonzero(~hit)
        rows = self.ids.take(place[found], 0)
        kept = rows[np.arange(self.MOST_IDS) < n[found, None]]
        if len(lost):
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts[lost].tolist(), stops[lost].tolist(), strict=True)])
            ids, at, counts = self._asked(list(known))
            n[lost] = counts[which]
            before = np.cumsum(n[lost]) - n[lost]
            asked = ids[np.arange(int(n[lost].sum())) + np.repeat(at[which] - before, n[lost])]
            from_asked = np.repeat(~hit, n)
            flat = np.empty(len(from_asked), "<u4")
            flat[from_asked], flat[~from_asked] = asked, kept
            few = np.flatnonzero((length[lost] <= 16) & (n[lost] <= self.MOST_IDS))
            few = few[np.unique(place[lost[few]], return_index=True)[1]]  # one word for each place
            new, taken = lost[few], place[lost[few]]
            self.low[taken], self.high[taken], self.n[taken] = low[new], high[new], n[new]
            self.ids[taken] = ids[np.minimum(at[which[few]][:, None] + np.arange(self.MOST_IDS), len(ids) - 1)]
        else:
            flat = kept
        borders = 4 * np.append(0, np.cumsum(n))[np.searchsorted(starts, np.append(begins, len(raw)))]
        out = flat.tobytes()
        return [out[a:b] for a, b in itertools.pairwise(borders.tolist())]


class TextEncoder:
    """encode(texts): ids as bytes (little-endian unsigned 32-bit), equal to the library's encode(text, add_special_tokens=False).

    A text is cut into the vocabulary's pieces (words, digits, marks, white space), of which each has its ids whatever
    stands beside it. Pieces not in the cache go to the library, many at a time. Texts with other characters than
    LETTERS, ASCII marks and white space, or with what may be a special token, go to the library whole.
    ranks: the same vocabulary as a file of tiktoken, which then encodes the texts that need not go whole: it is faster.
    """

    def __init__(self, path: str, ranks: str | None = None, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ranked = None if ranks is None else ranked(ranks)
        self.words = None if ranks is None else Words(ranked(ranks, SINGLE_SPACED))
        self.cache: dict[str, bytes] = {}
        self.cache_pieces = cache_pieces
        self.keeps_space = self.library.normalizer is None
        self.simple = re.compile(f"[ \\n\\t!-~{LETTERS}]*").fullmatch
        if self.keeps_space:
            self.pieces = re.compile(f" ?[{LETTERS}]+|{CONTRACTIONS}| ?[0-9]+| ?[^ \\n\\t0-9{LETTERS}]+|[ \\n\\t]+(?![^ \\n\\t])|[ \\n\\t]").findall
        else:
            self.pieces = re.compile(f"[{LETTERS}]+|{CONTRACTIONS}|[0-9]|[^ \\n\\t0-9{LETTERS}]+").findall
            vocabulary = self.library.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @staticmethod
    def wide(text: str) -> bool:
        """Whether two characters of white space stand side by side, in a text whose only characters up to the blank are white space."""
        blank = np.frombuffer(text.encode(), np.uint8) <= 32
        return bool((blank[1:] & blank[:-1]).any())

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """Encoded as one text, cut where pieces end."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 4000):
            part = pieces[at : at + 4000]
            ids = np.array(self.library.encode_batch_fast([("\n" if self.keeps_space else " ").join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            if self.keeps_space:
                stops = np.append(np.flatnonzero(ids == NEWLINE_ID), len(ids))
                starts = np.append(0, stops[:-1] + 1)
            else:
                stops = np.flatnonzero(self.ends[ids]) + 1
                starts = np.append(0, stops[:-1])
            raw = ids.tobytes()
            if len(stops) != len(part):
                out += self._library_ids(part)
            else:
                out += [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is not None:
            whole = [i for i, t in enumerate(texts) if "<|" in t or not self.simple(t)]
            done = dict(zip(whole, self._library_ids([texts[i] for i in whole]) if whole else (), strict=True))
            single = [i for i, t in enumerate(texts) if i not in done and not self.wide(t)]
            done |= zip(single, self.words.encode([texts[i].encode() for i in single]), strict=True)
            return [done[i] if i in done else self.ranked.encode_to_numpy(t).astype("<u4").tobytes() for i, t in enumerate(texts)]
        if len(self.cache) > self.cache_pieces:
            self.cache = {}
        cache, out, pending = self.cache, [b""] * len(texts), []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if "<|" in text or not self.simple(text):
                whole.append(i)
            else:
                pending.append((i, self.pieces(text if self.keeps_space else text.lower())))
        missing = set().union(*(pieces for _, pieces in pending)).difference(cache)
        for keys, ids in ((k, f(k)) for k, f in (([p for p in missing if p.isspace()], self._library_ids), ([p for p in missing if not p.isspace()], self._piece_ids)) if k):
            cache.update(zip(keys, ids, strict=True))
        for i, pieces in pending:
            out[i] = b"".join(map(cache.__getitem__, pieces))
        for i, ids in zip(whole, self._library_ids([texts[i] for i in whole]) if whole else (), strict=True):
            out[i] = ids
        return out


@cache
def text_encoder(path: str, ranks: str | None = None) -> TextEncoder:
    """One for each worker process, as reading a vocabulary takes longer than many a task."""
    return TextEncoder(path, ranks)
