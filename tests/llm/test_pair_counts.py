"""Pairs counted by buckets before they are sorted, and texts cut without looking ahead: the same results, with less to sort."""

import random

import numpy as np
import pytest

from noteloom.llm.token_files import frequent_pairs
from noteloom.llm.tokens import text_encoder, vocabulary_path


@pytest.mark.parametrize("kinds", [1, 3, 40, 4000])
def test_frequent_pairs(kinds):
    r = np.random.default_rng(kinds)
    ids = r.integers(0, kinds, 6000)
    key = (ids[:-1] << 32) | ids[1:]
    ends = np.flatnonzero(r.random(len(key)) < 0.05)
    key[ends] = -1 - ends
    pairs, counts = np.unique(key[key >= 0], return_counts=True)
    for fall in (2, 64):
        chosen, least, places = frequent_pairs(key, 6, fall)
        assert least == max(6, counts.max() // fall)
        assert sorted(chosen.tolist()) == pairs[counts >= least].tolist()
        assert set(np.flatnonzero(np.isin(key, chosen)).tolist()) <= set(places.tolist())


def test_rare_pairs_are_not_sorted():
    key = np.concatenate((np.arange(20_000), np.full(500, 77_777)))
    assert len(frequent_pairs(key, 6, 64)[2]) < 2000


def test_ids_with_and_without_wide_spaces():
    encoder, r = text_encoder(vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken")), random.Random(1)
    texts = ["".join(r.choice([" ", "a", "é", "B", "7", "42", ",", "'s", "'", "\n", "\t", "don't", "...", " y", "!"]) for _ in range(r.randrange(25))) for _ in range(4000)]
    assert 100 < sum(map(bool, map(encoder.wide, texts))) < 3900
    assert encoder.encode(texts) == encoder._library_ids(texts)
