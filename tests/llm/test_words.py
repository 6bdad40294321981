"""Words of singly spaced texts, looked up together."""

from __future__ import annotations

import random
import re

from noteloom.llm.tokens import SINGLE_SPACED, TextEncoder, Words, ranked, vocabulary_path

PARTS = ("the", "'s", "'", "don't", "'tis", "l'homme", "x'll", "..'s", "3rd", "1'5", "42", "a1b2", "Größe", "œuvre", "éé", "§", "###", "end.", "(so)", "supercalifragilistic", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "q" * 40, "0" * 17)


def texts(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice((" ", " ", " ", "\n", "\t", "", "  ")) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_as_the_library_has_it():
    encoder = TextEncoder(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken"))
    plain = ["", " ", "\n", "a", "'", " 's", "'s", "a ", " a", *texts(2000)]
    for bits in (3, 20):  # places that words take from each other, and enough of them
        encoder.words = Words(encoder.words.ranked, bits)
        for _ in range(2):
            assert encoder.encode(plain) == encoder._library_ids(plain)
    assert encoder.words.encode([b"", b""]) == [b"", b""]


def test_known_words_are_not_asked_again():
    words = Words(ranked(vocabulary_path("byte_bpe_50k.tiktoken"), SINGLE_SPACED))
    asked, ask = [], words._asked
    words._asked = lambda some: asked.extend(some) or ask(some)
    some = [t.encode() for t in texts(300) if not re.search(r"\s\s", t)]
    first = words.encode(some)
    assert len(asked) == len(set(asked)) > 40
    asked.clear()
    assert words.encode(some) == first
    assert all(len(w) > 16 or len(words.ranked.encode(w.decode())) > words.MOST_IDS for w in asked)
