"""Phrases against plain counting, odd texts, and the sketch's promise."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from noteloom.llm import phrases as p

SCHEMA = "doc_id long, lang string, text string, phrase string, f long, n_words int"


def plain(rows, longest=3, least=10, covered=50, top=2000):
    counts = defaultdict(Counter)
    for _, lang, text, *_ in rows:
        small = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", small):
            words = re.findall("[^ \t]+", piece)
            for n in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        found = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        inside = defaultdict(int)
        for w, a in found.items():
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    inside[w[i : i + m]] = max(inside[w[i : i + m]], a)
        rows = []
        for w, a in found.items():
            if 100 * inside[w] >= covered * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            rows.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, w.decode(), -a, left, right, n, -s) for i, (s, a, w, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def said(seed, docs, vocabulary):
    r = random.Random(seed)
    words = ["the", "The", "of", "Été", "été", "co-op", "ß", "\x00x", "a b", "\x1cq", "x" * 3000, *(f"w{i}" for i in range(vocabulary))]
    seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ! ", "\r\n"]
    return ["".join(r.choice(words[: 2 + r.randrange(len(words))]) + r.choice(seps) for _ in range(r.randrange(0, 200))) for _ in range(docs)]


@pytest.mark.parametrize(("options", "small"), [({}, False), ({"longest": 4, "least": 3, "covered": 80, "top": 7}, True), ({"longest": 2, "least": 2, "top": None}, True)])
def test_against_plain_counting(spark, monkeypatch, options, small):
    if small:  # full sketches let everything through, and blocks are cut often
        for name, value in (("SMALLEST", 1 << 9), ("LARGEST", 1 << 9), ("BLOCK", 3000)):
            monkeypatch.setattr(p, name, value)
    texts = said(7, 60, 25)
    rows = [(i, [None, "en", "de", "en", ""][i % 5], t, "p", 1, 2) for i, t in enumerate([*texts, *texts[:9], None, "", " \t\n", "...", "one", "so long " * 30_000])] + [(None, "en", texts[3], None, None, None)]
    got = sorted(tuple(r) for r in p.mine_phrases(spark.createDataFrame(rows, SCHEMA), **options).collect())
    assert got == plain(rows, **{k: v if v is not None else 10**9 for k, v in options.items()})


def test_no_rows(spark):
    assert p.mine_phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    assert p.mine_phrases(spark.createDataFrame([(1, None, None, "", 1, 1), (2, "en", "a b", "", 1, 1)], SCHEMA)).count() == 0


def test_sketches_only_overestimate():
    r = np.random.default_rng(3)
    keys = r.integers(0, 5000, (40, 300))
    sketches = [p.Sketch(1 << 10, 10) for _ in range(4)]
    for i, some in enumerate(keys):
        found, counts = np.unique(some, return_counts=True)
        sketches[i % 4].add(0, (found * 7919) % 1024, counts)
    merged = np.minimum(sum(s.rows[0].astype(int) for s in sketches), 10)
    every = Counter(keys.ravel().tolist())
    assert all(merged[(k * 7919) % 1024] >= min(10, n) for k, n in every.items())
    assert (merged == [min(10, n) for n in np.bincount((keys.ravel() * 7919) % 1024, minlength=1024)]).all()


def test_many_words_in_a_block():
    """More words than fit three times into 64 bits: the same phrases."""
    words = [f"w{i % 9000}" for i in range(20_000)]
    found = p.Phrases([" ".join(words).encode()])
    rows, counts = found.of(3)
    other = p.Phrases([" ".join(words).encode()])
    other.words = other.words + [b""] * (1 << 21)
    again, counts_again = other.of(3)
    assert sorted(zip(map(tuple, rows.tolist()), counts.tolist(), strict=True)) == sorted(zip(map(tuple, again.tolist()), counts_again.tolist(), strict=True))
