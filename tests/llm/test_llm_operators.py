"""Odd rows through every operator, and brute-force versions on small fixtures."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from noteloom.llm import bpe, neardup, packing, ppm, quality, secrets, suffixes, token_files, topk, urls
from noteloom.llm.tokens import TextEncoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, k1 string, q_text string, value int"
WORD, BYTE = (vocabulary_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def texts():
    r = random.Random(5)
    words = ["the", "of", "und", "été", "Größe", "token", "alpha", "beta", "gamma", "delta", "run", "stone"]
    say = lambda n: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))
    shared, long = say(120), say(9000)
    return [None, "", " \n\t", "one", say(60), shared, shared, shared + " more", say(30) + " " + shared + " " + say(30), long, 'password = "hunter2pass" AKIA' + "Q" * 20 + " " + "ab12" * 8, "aaaa " * 300, say(40) + "<|endoftext|>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", "z", i) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[4], (None, texts()[4], None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffixes(docs, none):
    assert suffixes.remove_repeats(none).count() == 0
    runs = {(r.k1, r.k2): suffixes.merged(r.runs) for r in suffixes.repeated_runs(suffixes.keyed(docs)).collect()}
    all_ = [(r.k1, r.k2, r.text.encode()) for r in suffixes.keyed(docs).collect()]
    seen = {}
    for _, _, t in all_:
        for i in range(len(t) - 399):
            seen[t[i : i + 400]] = seen.get(t[i : i + 400], 0) + 1
    for k1, k2, t in all_:
        flags = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                flags[i : i + 400] = 1
        assert [(int(a), int(b)) for a, b in zip(np.flatnonzero(np.diff(flags, prepend=0) == 1), np.flatnonzero(np.diff(flags, prepend=0) == -1), strict=True)] == runs.get((k1, k2), [])


def test_deep_shallow():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 120))) for _ in range(300)] + [b"a" * 90] * 3
    order, common = suffixes.deep_shallow(strings)
    ordered = [strings[i] for i in order]
    assert ordered == sorted(strings)
    assert common[1:].tolist() == [suffixes.common_prefix(a, b) for a, b in zip(ordered, ordered[1:], strict=False)]


def test_neardup(docs, none):
    assert neardup.near_duplicates(none).count() == 0
    rows = neardup.near_duplicates(docs).collect()
    found = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == 15 and found[6] == found[5] == found[7] == 5 and found[0] == 0 and found[8] == 8


def test_neardup_contained(spark):
    """One set inside the other at exactly 0.8: sketches reach far up into the hashes, beyond the signed longs."""
    r, rows = random.Random(11), []
    for n in range(70, 155, 5):
        for _ in range(12):
            words = [f"w{r.getrandbits(60):x}" for _ in range(n + 4)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: n * 4 // 5 + 4]))]
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i][0] * 4 == found[i + 1][0] * 5 for i in range(0, len(rows), 2))
    assert [i for i in range(0, len(rows), 2) if not found[i][1] == found[i + 1][1] == i] == []


def test_repeated_ids(spark):
    """Documents that share an id go only if their own text is a near-duplicate, as comparing all pairs says."""
    r = random.Random(3)
    say = lambda n: [f"w{r.getrandbits(40):x}" for _ in range(n)]
    one, two, three = say(90), say(90), say(90)
    texts = [(1, one), (1, two), (1, two), (1, [*three, "end"]), (1, three), (2, [*one, "end"]), (3, two), (4, [*two, "end"]), (5, say(90)), (6, []), (6, ["!"]), (None, three), (None, say(90))]
    rows = [(i, " ".join(t)) for i, t in texts]
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} if len(t) >= 5 else {tuple(t)} if t else set() for _, t in texts]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a] == rows[b] or sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = [min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in sorted(set(group))]
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in found) == sorted(least)
    assert {(1, rows[0][1]), (1, rows[1][1])} <= {(x.doc_id, x.text) for x in found}


def test_quality(docs, none):
    assert quality.judge(none.select("doc_id", "text"))[0].count() == 0 and quality.filter_documents(none).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {4, 5} <= {r.doc_id for r in kept.collect()} and 11 not in {r.doc_id for r in kept.collect()}


def test_secrets(docs, none):
    assert secrets.scan_documents(none).count() == 0
    rows = {r.doc_id: r for r in secrets.scan_documents(docs).collect()}
    assert (rows[10].n_assign, rows[10].n_access, rows[10].n_hex) == (1, 1, 1) and rows[0].spans == ""
    assert "hunter2pass" not in {r.doc_id: r.text for r in secrets.redact_documents(docs).collect()}[10]
    assert secrets.guess_cost("password1234")[0] < 6 < secrets.guess_cost("x9$Kq2!vLp")[0]


def test_secret_values():
    guesses = lambda t: [t[a:b] for a, b, k in secrets.scan(t) if k == 3]
    clean = ["Login: Register", "mountain pass: elevation", "compass: northwest", "Reisepass: x9$Kq2!vLp", "login: required", "Login: gesellschaft", "pass: montagne", "login: desarrollo", "Login: Straßenbahn", "login: nécessaire", "Auth: Bearer"]
    assert [t for t in clean if guesses(t)] == []
    for t in ["Authorization: Bearer {}", "authorization: basic {}", "Authorization: Token {}", "auth: token: {}", "dbpassword={}", "userPass: {}", "db_pass={}", "login: login: {}"]:
        assert guesses(t.format("x9$Kq2!vLp")) == ["x9$Kq2!vLp"], t


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tokens(path):
    library, ours, fast = Tokenizer.from_file(path), bpe.Bpe(path), TextEncoder(path)
    some = [t or "" for t in texts()] + ["it's İΣ é ½²", " a\n\n b  c", "<|endoftext|>x"]
    ids = [library.encode(t, add_special_tokens=False).ids for t in some]
    assert [ours.encode(t) for t in some] == ids and [np.frombuffer(x, "<u4").tolist() for x in fast.encode(some)] == ids
    assert [ours.decode(i) for i in ids] == [library.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe(docs, none):
    assert bpe.encode_documents(none, WORD).count() == 0
    rows = {r.doc_id: r for r in bpe.encode_documents(docs, WORD).collect()}
    assert rows[0].n_tokens == 0 and rows[0].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_packing(docs, none):
    assert packing.pack_documents(none).count() == 0
    rows = packing.pack_documents(docs).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == packing.lower_bound(np.array([r.length for r in rows]))


def test_token_files(docs, none):
    assert token_files.read_token_files(token_files.write_token_files(none, BYTE)).count() == 0
    library = Tokenizer.from_file(BYTE)
    shards = token_files.write_token_files(docs, BYTE, min_count=2)
    rows = token_files.read_token_files(shards).collect()
    by_id = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows}
    for i, t in enumerate(texts()):
        assert by_id[i] == [*library.encode(t or "", add_special_tokens=False).ids, 0]
    for row in shards.collect():
        shard = token_files.Shard(bytes(row.payload))
        for k, i in enumerate(shard.doc_ids):
            if i is not None and shard.counts[k] > 3:
                assert shard.ids(k, 1, 3).tolist() == by_id[i][1:3]


def test_topk(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(301)] + [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (None, [1.0] * 8), (7, [1.0] * 8), (503, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sound = [(i, topk.whole_numbers(np.array(v))) for i, v in rows if i is not None and i not in (500, 501, 502)]
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.exact_top_k(table, F.col("vec_id") % 100 == 0).collect()}
    for q, v in sound:
        if q % 100 == 0 and len(v) == 8:
            best = sorted((-int(v @ w), i) for i, w in sound if i != q and len(w) == 8)[:10]
            assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]
    assert topk.exact_top_k(table.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no host"), (3, "http://A.Example.com/en/x"), (4, "http://www.example.com/en/x"), (5, "http://a.net/es/1?x"), (6, "http://a.net"), (7, "http://b.org/q/1")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[3] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[4][2:] == ("www.example.com/en/", "allow") and got[5][2:] == ("net/es/", "block") and got[6] == ("a.net", "", None, "allow")
    many = [(i, f"http://h.net/{'es' if i % 2 else 'xx'}/post-{i}") for i in range(60)]
    assert urls.judge_urls(spark.createDataFrame(many, "page_id long, url string")).count() == 60


def test_ppm(docs, none):
    assert ppm.score_documents(none).count() == 0
    rows = ppm.score_documents(docs).collect()
    assert len(rows) == 15 and all(r.score < 0 and r.base_score < 0 for r in rows)


def test_pipeline(spark, docs, none, tmp_path):
    for n, frame in enumerate((docs, none)):
        frame.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{n}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/0").collect()}
    assert 4 in kept and not kept & {0, 1, 2, 3, 6, 11}
    assert corpus_pipeline.run(spark, f"{tmp_path}/1").count() == 0


def test_near_duplicates_of_an_edited_family_against_brute_force(spark, monkeypatch):
    """Copies of one text with edits, near 0.8 to each other: long lists that span components, looked through in rounds."""
    monkeypatch.setattr(neardup, "SHORT_LIST", 2)
    r = random.Random(11)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    family = []
    for _ in range(90):
        words = list(base)
        for _ in range(r.choice([0, 2, 3, 4, 5, 6])):
            at = r.randrange(150)
            words[at] = f"{words[at]}x{r.randrange(2)}"
        family.append(" ".join(words))
    family = family[:40] + [" ".join(t.split()[:130]) for t in family[40:60]] + family[60:]
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) for w in (t.split() for t in family)]
    least = list(range(len(family)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    assert len(set(least)) > 3
    docs = spark.createDataFrame(list(enumerate(family)), "doc_id long, text string")
    found = {row.doc_id: row.component_id for row in neardup.near_duplicates(docs, 4).collect()}
    assert found == dict(enumerate(least))
