"""Pairs that are too rare are counted once, not in each round; white space side by side is told by bytes."""

import random
import re

import numpy as np

from noteloom.llm import token_files
from noteloom.llm.tokens import text_encoder, vocabulary_path


def test_rare_pairs_are_counted_once(monkeypatch):
    ids = np.concatenate([np.arange(100, 20_100), *([np.arange(1, 9)] * 400), np.zeros(1, int)]).astype("<u4")
    count, sizes = token_files.frequent_and_alive, []

    def counted(key, *how):
        sizes.append(len(key))
        return count(key, *how)

    monkeypatch.setattr(token_files, "frequent_and_alive", counted)
    last = np.zeros(len(ids), bool)
    last[-1] = True
    sequence, _, rules, lengths, base = token_files.repair(ids, last)
    assert np.array_equal(token_files.expand(sequence, rules, lengths, base), ids)
    assert len(sequence) < 20_100 and sizes[0] == len(ids) - 1
    assert len(sizes) > 3 and max(sizes[1:]) < 6000


def test_wide():
    encoder, r = text_encoder(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken")), random.Random(3)
    texts = ["", " ", "\n\t", *("".join(r.choice(" \n\taéž!") for _ in range(r.randrange(6))) for _ in range(500))]
    assert [encoder.wide(t) for t in texts] == [bool(re.search("[ \\n\\t]{2}", t)) for t in texts]
