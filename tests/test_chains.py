"""First-parent chains of few and of many tips, sent to all tasks or merged, against plain loops."""

from __future__ import annotations

import random

import pytest

from strata.operators import graph


def ways(parents, tip):
    """(node, depth) along every way of first parents."""
    out, at = [], [(tip, 0)]
    while at:
        out += at
        at = [(p, d + 1) for n, d in at for p in parents.get(n, [])]
    return out


def edges_of(spark, parents):
    rows = [(c, p, 0) for c, ps in parents.items() for p in ps] + [(c, c - 1, 1) for c in parents]
    return spark.createDataFrame(rows, "child long, parent long, ord int")


FORESTS = {
    "tree, all": ({n: [n // 2] for n in range(1, 40)}, slice(None), 0),
    "line, last": ({n: [n - 1] for n in range(1, 20)}, slice(-2, None), 1 << 19),
    "bush and line, all": ({n: [0] for n in range(100, 130)} | {n: [n - 1] for n in range(1, 12)}, slice(None), 1 << 19),
    "twice, first": ({1: [0], 2: [1, 1], 3: [2], 4: [1, 2], 5: [4]}, slice(3), 0),
}


@pytest.mark.parametrize("name", sorted(FORESTS))
def test_chains_of_any_tips(spark, monkeypatch, name):
    parents, some, few = FORESTS[name]
    monkeypatch.setattr(graph, "FEW", few)
    nodes = sorted({*parents, *(p for ps in parents.values() for p in ps)})
    tips, edges = nodes[some], edges_of(spark, parents)
    rng = random.Random(few)
    marked = {n: f"m{n}" for n in nodes if rng.random() < 0.4}
    marks = spark.createDataFrame([(n, marked.get(n)) for n in nodes], "node long, mark string")
    table = spark.createDataFrame([(n,) for n in tips], "node long")
    wanted = sorted((t, n, d) for t in tips for n, d in ways(parents, t))

    def rows(found):
        return sorted(tuple(r) for r in found.collect())

    assert rows(graph.chain(edges, table)) == wanted
    assert rows(graph.chain(edges, table, 5)) == [w for w in wanted if w[2] < 5]
    assert rows(graph.marked_chain(edges, table, marks.filter("mark IS NOT NULL"))) == [(*w, marked[w[1]]) for w in wanted if w[1] in marked]
    assert rows(graph.ancestors(edges, table, 5)) == [w[:2] for w in wanted if w[2] == 5]
    if name.startswith("twice"):
        return
    held = set(nodes[1:4])
    low = {t: min((d for n, d in ways(parents, t) if n in held), default=1 << 30) for t in tips}
    stops = spark.createDataFrame([(n,) for n in held], "node long")
    assert rows(graph.chain_until(edges, table, stops)) == [w for w in wanted if w[2] < low[w[0]]]
    first = {t: min(((d, n) for n, d in ways(parents, t) if n in marked), default=None) for t in tips}
    assert rows(graph.nearest(edges, table, marks)) == [(t, first[t][1], first[t][0], marked[first[t][1]]) for t in sorted(tips) if first[t]]


def test_what_was_written_small_is_not_taken_for_few(spark):
    """300,000 steps of one commit each lie in some KB: taken by the size of the files they would be sent to all tasks."""
    edges = spark.range(1, 300_000).select(graph.F.col("id").alias("child"), graph.F.lit(0).cast("long").alias("parent"), graph.F.lit(0).alias("ord"))
    tips = edges.select(graph.F.col("child").alias("node"))
    for width in (1, 2):
        written = graph.settled(edges.select("child", "parent"))
        plan = tips.join(graph._few_or_merged(written, width), tips["node"] == written["child"])._jdf.queryExecution().sparkPlan().toString()
        assert ("SortMergeJoin" in plan) == (width == 2)
