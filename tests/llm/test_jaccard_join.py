"""The Jaccard join against all pairs."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F
import pytest

from strata.llm import jaccard_join

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words=4):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < words else (tuple(w[i : i + words]) for i in range(len(w) - words + 1)))


def brute(rows, words=4, percent=85):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def prose(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(rng, words, edits, tag):
    words = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = f"{tag}x{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"{tag}y{rng.randrange(10**6)}")
        elif len(words) > 10:
            del words[at]
    return words


def corpus(seed):
    """Templates with copies at all distances around the threshold, some of them edited alike, and shared passages."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = []
    for t in range(10):
        base = prose(rng, rng.choice([12, 40, 90, 200]))
        alike = [edited(rng, base, rng.randrange(1, 6), f"t{t}") for _ in range(3)]
        for i in range(14):
            start = base if i % 2 else rng.choice(alike)
            texts.append(edited(rng, start, rng.choice([0, 1, 1, 2, 3, 5]), f"e{t}_{i}_"))
        texts.append(base[: len(base) * 9 // 10])
        texts.append(base + prose(rng, len(base) // 8))
    for _ in range(25):
        own = prose(rng, rng.randrange(5, 80))
        texts.append(own + passage)
    texts += [prose(rng, n) for n in (1, 2, 3, 4, 5, 6, 7, 300)]
    rows = [" ".join(x) for x in texts] + [texts_upper(" ".join(texts[0])), "\n".join(texts[1]), "", None, " \t\r\n", "a b", "A B", "a", "ÀÉ x y z", "àé x y z"]
    ids = rng.sample(range(10_000), len(rows))
    out = list(zip(ids, rows))
    return out + [(None, rows[3]), (None, rows[3]), (None, "alone and without id here"), (ids[5], rows[40]), (ids[6], rows[6])]


def texts_upper(text):
    return text.upper()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_are_those_of_all_pairs(spark, seed):
    rows = corpus(seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({x: F.lit(1) for x in ("n", "node", "token", "digest", "label", "n_shingles")})
    found = sorted((tuple(r) for r in jaccard_join.join(table).collect()), key=str)
    assert found == brute(rows)
    assert 20 < len({c for _, _, c in found}) < len(found) - 20


def test_other_parameters(spark):
    rows = corpus(4)
    for words, percent in ((2, 70), (5, 95), (1, 100)):
        found = sorted((tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA), words, percent).collect()), key=str)
        assert found == brute(rows, words, percent)


def test_few_rows(spark):
    for rows in ([], [(1, None)], [(1, "")], [(1, "one two three four five")], [(2, "a b c d"), (1, "a b c d")], [(None, "a b c d")]):
        assert sorted((tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_megabyte_texts(spark):
    rng = random.Random(6)
    long = prose(rng, 200_000, 50_000)
    other = list(long)
    for i in range(0, 200_000, 60):
        other[i] = "z"
    rows = [(1, "ab" * 600_000), (2, " ".join(long)), (3, " ".join(other)), (4, " ".join(long[:150_000])), (5, "w " * 500_000)]
    assert sorted((tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize(("edits", "linked"), [(2, False), (1, True)])
def test_copies_of_a_template_are_not_compared_with_each_other(spark, monkeypatch, edits, linked):
    """1,200 copies with words of their own: the pairs that are looked at grow with the copies, not with their square."""
    rng = random.Random(7)
    base = prose(rng, 100)
    rows = []
    for i in range(1_200):
        words = list(base)
        for at in rng.sample(range(100), edits):
            words[at] = f"own{i}_{at}"
        rows.append((i, " ".join(words)))
    seen, compared = [], jaccard_join._compared
    monkeypatch.setattr(jaccard_join, "_compared", lambda pairs, *a, **b: seen.append(pairs.count()) or compared(pairs, *a, **b))
    found = jaccard_join.join(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sum(seen) < 20 * 1_200, seen
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)
    components = {r.component_id for r in found}
    assert (len(components) < 20) if linked else (len(components) > 900)
