"""Hard negatives against all products."""

from __future__ import annotations

from collections import defaultdict
import math
import random

import numpy as np
from pyspark.sql import functions as F
import pytest

from strata.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    held = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v])
        held[i] = min(held.get(i, row), row)
    out = set()
    for a, (y, v) in held.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(v, w)) for i, (_, w) in held.items()}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and held[i][0] == y][:positives]:
            fits = [i for i in order if held[i][0] != y and low * score[p] <= 100 * score[i] <= high * score[p]]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(fits[:negatives])}
    return out


def awkward(n=900, dim=6, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = [rng.gauss(c, 0.4) for c in centres[i % 12]]
        rows.append((i - 50, v, rng.randrange(10)))
    common = [0.25, 0.5, 0.125, -0.25, 0.0, 1.0]
    rows += [(1000 + i, common, i % 3) for i in range(320)]  # a vector that a quarter of all rows has
    rows += [(None, common, 1), (2001, None, 1), (2002, common, None), (2003, [0.1, None, 1.0, 1.0, 1.0, 1.0], 1), (2004, [float("nan")] * 6, 1)]
    rows += [(2005, [float("inf")] * 6, 1), (2006, [1.0, 2.0], 4), (2007, [], 4), (2100, [0.0] * 6, 4), rows[7], (8, common, 9), (300, common, 0)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


def test_all_anchors_and_positives(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit(1) for x in ("x", "v", "score", "rank", "cluster")})
    found = [tuple(r) for r in hard_negatives.every_hundredth(table).collect()]
    assert len(found) == len(set(found)) > 200 and set(found) == brute(rows)


def test_waves_and_clusters_do_not_change_the_result(spark, rows, monkeypatch):
    vectors = hard_negatives.whole_numbers(spark.createDataFrame(rows, SCHEMA))
    wanted = brute(rows, 50, 2, 3, 20, 110)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "HELD", 20)
    monkeypatch.setattr(hard_negatives, "ROWS_OF_TASK", 50)
    found = hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, 2, 3, 20, 110, clusters=40, wave=7)
    assert {tuple(r) for r in found.collect()} == wanted
    found = hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, 2, 3, 20, 110, clusters=1)
    assert {tuple(r) for r in found.collect()} == wanted


def test_large_components_are_exact_and_larger_ones_an_error(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-400_000, 400_000) for _ in range(4)], i % 3) for i in range(201)]
    assert {tuple(r) for r in hard_negatives.every_hundredth(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
    rows[3], rows[100] = (3, [1e12] * 4, 0), (100, [1e12] * 4, 0)
    with pytest.raises(Exception, match="63 bits"):
        hard_negatives.every_hundredth(spark.createDataFrame(rows, SCHEMA)).collect()


def test_few_rows(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 1)], [(100, None, 1)], [(0, [], 1), (1, [], 2), (2, [], 2)]):
        assert {tuple(r) for r in hard_negatives.every_hundredth(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_bounds_hold_and_skip_most_lists():
    """Separated clusters: the range of every list holds its rows' scores, and few ranges reach a window."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 200, (30, 16))
    rows = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(0, 4, (3000, 16))).astype(np.int64)
    centroids = hard_negatives.fit(rows, 30)
    near = hard_negatives.nearest(rows.astype(float), centroids)
    radii = np.array([np.sqrt(((rows[near == c] - centroids[c]) ** 2).sum(axis=1).max(initial=0)) for c in range(len(centroids))])
    low, high = hard_negatives.bounds(rows[:100], centroids, radii)
    score = rows[:100] @ rows.T
    assert (score >= low[:, near]).all() and (score <= high[:, near]).all()
    kth = np.sort(score, axis=1)[:, -10]
    assert (high >= kth[:, None]).mean() < 0.2


def test_ties_go_by_id(spark):
    rows = [(i, [1.0, 0.0], 2) for i in range(101, 140)] + [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (3, [1.25, 0.0], 1)]
    rows += [(i, [0.5, 0.0], 5) for i in range(400, 440) if i % 7]
    found = defaultdict(list)
    for r in hard_negatives.every_hundredth(spark.createDataFrame(rows, SCHEMA)).orderBy("anchor_id", "positive_id", "rank").collect():
        found[r.anchor_id, r.positive_id].append(r.negative_id)
    assert found[100, 3] == [i for i in range(101, 140)][:10] and {k: set() for k in found} and set(brute(rows)) == {
        tuple(r) for r in hard_negatives.every_hundredth(spark.createDataFrame(rows, SCHEMA)).collect()
    }
