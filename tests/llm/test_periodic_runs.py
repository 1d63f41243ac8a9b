"""Runs of words against a search of every stretch."""

from __future__ import annotations

from fractions import Fraction
import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
import pytest

from strata.llm import periodic_runs

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=6, times=4):
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            if length < max(least, times * q):
                continue
            own = words[s : i + q]
            if next(p for p in range(1, q + 1) if all(own[k] == own[k + p] for k in range(length - p))) == q:
                found.append((s, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *own, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def all_runs(words):
    ids, at = periodic_runs.word_numbers([words])
    counts, _ = periodic_runs.lag_matches(ids, at)
    return periodic_runs.runs_of(ids, counts), counts


def random_words(rng):
    kind = rng.randrange(4)
    letters = [str(i).encode() for i in range(rng.choice([1, 2, 3, 30]))]
    words = [rng.choice(letters) for _ in range(rng.randrange(0, 160))]
    if kind:  # blocks repeated, blocks of blocks, with a word changed here and there
        block = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
        words += block * rng.randrange(1, 14) + block[: rng.randrange(len(block))]
    if kind > 1:
        words = (words * rng.randrange(1, 6))[:400]
    if kind > 2 and words:
        words[rng.randrange(len(words))] = b"changed"
    return words


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(600):
        words = random_words(rng)
        assert all_runs(words)[0] == brute_runs(words)


def test_matches_of_all_lags_are_counted():
    """Heavy words by transform, light ones by pairs, several texts at once."""
    rng = random.Random(4)
    texts = [[rng.choice([b"a", b"a", b"a", b"b", str(rng.randrange(40)).encode()]) for _ in range(n)] for n in (0, 3, 900, 4, 2500, 50)]
    ids, at = periodic_runs.word_numbers(texts)
    counts, base = periodic_runs.lag_matches(ids, at)
    for t, words in enumerate(texts):
        own = ids[at[t] : at[t + 1]]
        wanted = [int((own[q:] == own[:-q]).sum()) for q in range(1, len(words) // 4 + 1)]
        assert counts[base[t] : base[t + 1]].tolist() == wanted


def test_runs_of_long_texts_take_no_square_of_their_length():
    one = [b"a"] * 300_000
    assert all_runs(one)[0] == [(0, 300_000, 1)]
    rng = np.random.default_rng(0)
    two = [b"ab"[i : i + 1] for i in rng.integers(0, 2, 120_000)]
    two[5_000:25_000] = two[5_000:7_000] * 10
    runs = all_runs(two)[0]
    assert any(q == 2_000 and s <= 5_000 and s + n >= 25_000 for s, n, q in runs)
    assert sum(q < 30 for _, _, q in runs) == len([r for r in brute_short(two, 29)])


def brute_short(words, most):
    codes = np.array([w[0] for w in words])
    found = []
    for q in range(1, most + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            own = codes[s : e + q]
            if e - s + q >= max(6, 4 * q) and not any((own[p:] == own[:-p]).all() for p in range(1, q)):
                found.append((s, e - s + q, q))
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "x x x x x x", "x y " * 7, "la  la\tla la\nla la la de"]
    texts += [" ".join(w.decode() for w in random_words(rng)) for _ in range(60)]
    texts += ["the cat sat on a mat " * 50 + "dog " * 9, "日本 語 " * 20, " ".join(rng.choice("abc") for _ in range(3000)), "nul \x00 nul \x00 " * 9]
    ids = [*range(len(texts) - 2), None, 5]
    return [*zip(ids, texts), (3, "one"), (3, "one"), (None, None)]


def test_query_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit(7) for x in ("h", "w", "n", "runs", "a", "best", "start", "collapsed")})
    found = sorted((tuple(r) for r in periodic_runs.run_digests(docs).collect()), key=str)
    assert found == sorted((expected(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in found) > 20
    hit = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0]
    assert len(hit) > 3  # some rows have a planted tail


def test_operator_gives_spans_and_text(spark):
    docs = spark.createDataFrame([(1, "so ha ha ha ha ha ha then"), (2, "plain text")], SCHEMA)
    found = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert [tuple(x) for x in found[1].runs] == [(1, 6, 1)] and found[1].collapsed == "so ha then" and found[1].n_words == 8
    assert found[2].runs == [] and found[2].collapsed == "plain text"
    three = periodic_runs.find_runs(docs, least=7).collect()
    assert all(r.runs == [] for r in three)


def test_empty_table_and_megabytes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periodic_runs.run_digests(empty).collect() == []
    rng = random.Random(1)
    vocabulary = ["the", "of", "and", *map(str, range(3000))]
    solid, prose = "ab" * 600_000, " ".join(rng.choices(vocabulary, k=250_000))
    docs = spark.createDataFrame([(1, solid), (4, prose), (9, "w " * 400_000)], SCHEMA)
    found = {r.doc_id: r for r in periodic_runs.run_digests(docs).collect()}
    assert found[1].n_runs == 0 and (found[9].n_runs, found[9].length, found[9].exponent_milli) == (1, 400_000, 400_000_000)
