"""Closures of many tips by generation: values, cycles, and how much is written on the way."""

from __future__ import annotations

import os

import pytest

from strata.operators import graph
from strata.operators.tables import settled


def edges(spark, n: int):
    rows = spark.range(1, n).selectExpr("id AS child", "explode(IF(id % 5 = 0, array(id div 2, id div 3), array(id div 2))) AS parent")
    return rows.selectExpr("child", "parent", "0 AS ord")


def test_closures_pairs(spark):
    n = 60
    e = edges(spark, n)
    parents: dict[int, set[int]] = {}
    for r in e.collect():
        parents.setdefault(r.child, set()).add(r.parent)
    wanted = {}
    for tip in range(30, n):
        level, step = {tip}, 0
        while level:
            for node in level:
                wanted.setdefault((tip, node), step)
            level, step = {p for node in level for p in parents.get(node, ())}, step + 1
    reach = settled(graph.closures(e, spark.range(30, n).toDF("node")))
    assert {(r.tip, r.node): r.distance for r in reach.collect()} == wanted
    pairs = spark.createDataFrame([(40, 35), (59, 30)], "tip long, other long")
    apart = {(t, o, k): wanted[t, k] for t, o in ((40, 35), (59, 30)) for k in range(n) if (t, k) in wanted and (o, k) not in wanted}
    assert {(r.tip, r.other, r.node): r.distance for r in graph.push_sets(reach, pairs).collect()} == apart
    found = {(r.tip, r.other): (r.ahead, r.behind) for r in graph.ahead_behind(reach, pairs).collect()}
    assert found == {(t, o): (sum(k[:2] == (t, o) for k in apart), sum((o, k) in wanted and (t, k) not in wanted for k in range(n))) for t, o in ((40, 35), (59, 30))}


def test_closures_of_a_cycle(spark):
    e = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 0)], "child long, parent long, ord int")
    with pytest.raises(ValueError):
        graph.closures(e, spark.createDataFrame([(1,)], "node long"))


def test_generations_write_little(spark):
    """What waits is not written again in each round."""
    n = 20_000
    settled(spark.range(1))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def written() -> int:
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)

    before = written()
    assert graph.generations(spark.range(n).toDF("node"), edges(spark, n)).count() == n
    assert written() - before < 40 * n
