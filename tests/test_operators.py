"""Operators on small cases: empty inputs, nulls, ties, cycles, streams that go on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import graph, matching, ordered, rules
from strata.streaming import coordination as S


def test_dispositions(spark):
    rows = {
        "Unchanged": [("a", "a", "a"), ("a", None, None)], "OursOnly": [("a", "b", "a")], "TheirsOnly": [("a", "a", "b")],
        "BothSame": [("a", "b", "b"), (None, "b", "b")], "Conflict": [("a", "b", "c"), (None, "b", "c")],
        "DeleteVsModify": [("a", None, "b"), ("a", "b", None)], "DeletedOurs": [("a", None, "a")], "DeletedTheirs": [("a", "a", None)],
        "AddedOurs": [(None, "a", None)], "AddedTheirs": [(None, None, "a")],
    }
    flat = [(k, *r) for k, rs in rows.items() for r in rs]
    df = spark.createDataFrame(flat, "want string, b string, o string, t string")
    found = df.select("want", matching.disposition(F.col("b"), F.col("o"), F.col("t")).alias("got"))
    assert all(r.want == r.got for r in found.collect())


def test_match_of_empty_sides(spark):
    none = spark.createDataFrame([], "key long, hash string")
    one = spark.createDataFrame([(1, "x")], "key long, hash string")
    assert matching.match2(none, none).count() == 0
    assert [r.change for r in matching.match2(none, one).collect()] == ["added"]
    assert matching.resolve(matching.match3(none, none, one)).collect()[0].side == "theirs"


def test_merge_sets(spark):
    df = spark.sql("SELECT array('a','b','c') b, array('a','c','d') o, array('a','b','e') t")
    assert df.select(matching.merge_sets(F.col("b"), F.col("o"), F.col("t")).alias("m")).first().m == ["a", "d", "e"]


def test_graph_rejects_cycles_and_stands_diamonds(spark):
    edges = spark.createDataFrame([(4, 2, 0), (4, 3, 1), (2, 1, 0), (3, 1, 0)], "child long, parent long, ord int")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "node long")
    assert {(r.node, r.generation) for r in graph.generations(nodes, edges).collect()} == {(1, 1), (2, 2), (3, 2), (4, 3)}
    tip = spark.createDataFrame([(4,)], "node long")
    assert {(r.node, r.distance) for r in graph.closure(edges, tip).collect()} == {(4, 0), (2, 1), (3, 1), (1, 2)}
    assert [(r.node, r.depth) for r in graph.chain(edges, tip).orderBy("depth").collect()] == [(4, 0), (2, 1), (1, 2)]
    with pytest.raises(ValueError):
        graph.generations(nodes, edges.union(spark.createDataFrame([(1, 4, 0)], "child long, parent long, ord int"))).count()


def test_rules(spark):
    df = spark.createDataFrame([("a/b.txt",), ("build/x",), ("a/build/keep",), ("top",)], "path string")
    held = [rules.PathRule(x) for x in ("build/", "*.txt", "!/a/build/keep")]
    got = {r.path: r.i for r in df.select("path", rules.ignored(F.col("path"), held).alias("i")).collect()}
    assert got == {"a/b.txt": True, "build/x": True, "a/build/keep": False, "top": False}
    ties = [rules.PolicyRule("b", 1, "x > 0", "B"), rules.PolicyRule("a", 1, "x > 0", "A"), rules.PolicyRule("n", 0, "y", "N")]
    inputs = spark.sql("SELECT 1 AS x, CAST(NULL AS BOOLEAN) AS y UNION ALL SELECT 0, FALSE")
    assert sorted((r.action, r.trace) for r in rules.evaluate(inputs, ties, "D").collect()) == [("A", "a,b"), ("D", "")]


def test_scalars(spark):
    df = spark.createDataFrame([("a::b::c",), ("a",)], "s string")
    path, key = T.split_selector(F.col("s"))
    assert [tuple(r) for r in df.select(path, key).collect()] == [("a", "b::c"), ("a", None)]
    one = spark.range(1)
    assert one.select(T.normalized(F.lit("  a \n b "))).first()[0] == "a b"
    assert one.select(T.normalized(F.lit("  "))).first()[0] == "-"
    assert one.select(T.signature(F.lit(" func  F(x int) {\n return }"))).first()[0] == "func F(x int)"
    assert one.select(T.mentions(F.lit("x Foo_bar"), "Foo")).first()[0] is False
    assert one.select(T.mentions(F.lit("x.Foo()"), "Foo")).first()[0] is True


def test_hunks_and_islands(spark):
    df = spark.createDataFrame([("f", n) for n in (1, 2, 9, 30)], "file string, line int")
    assert [(r["first"], r["last"]) for r in ordered.hunks(df, "file", "line").orderBy("hunk").collect()] == [(1, 2), (9, 9), (30, 30)]
    empty = spark.createDataFrame([], "file string, line int")
    assert ordered.hunks(empty, "file", "line").count() == 0


def test_claims_carry_on_over_batches(spark, tmp_path):
    schema = "key string, seq long, agent long, action string"
    source = str(tmp_path / "in")
    spark.createDataFrame([("k", 1, 7, "claim"), ("k", 2, 8, "claim")], schema).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    S.drained(S.claims(stream), str(tmp_path / "state"))
    spark.createDataFrame([("k", 3, 8, "force"), ("k", 4, 7, "release"), ("k", 5, 8, "release"), ("k", 6, 7, "claim")], schema).write.mode("append").parquet(source)
    found = S.drained(S.claims(spark.readStream.schema(schema).parquet(source)), str(tmp_path / "state"))
    got = [(r.seq, r.outcome, r.holder) for r in found.orderBy("seq").collect()]
    assert got == [(1, "granted", 7), (2, "refused", 7), (3, "taken", 8), (4, "ignored", 8), (5, "released", None), (6, "granted", 7)]


def test_ignore_rules(spark):
    paths = ["build", "build/x", "a/build", "a/build/x", "buildx", "foo", "foo/bar", "a/foo", "src7/x", "x7", "d/x7", ".git", "a/.git", ".git/x", "keep.log", "z.log", "m/sub/f", "docs/a/b.md", "docs/b.md"]
    held = rules.ignore_rules(["# c", "build/", "foo", "*7", "*.log", "!keep.log", "docs/**/b.md", ""], modules=["m/sub"])
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path for r in df.filter(rules.ignored(F.col("path"), held)).collect()}
    assert got == {"build", "build/x", "a/build", "a/build/x", "foo", "a/foo", "x7", "d/x7", ".git", "a/.git", "z.log", "m/sub/f", "docs/a/b.md", "docs/b.md"}


def test_streamed_claims_by_hand(spark):
    """Every event of every key, in order, against a plain loop over the table."""
    from strata.plans.streams import stream_claims

    sf_dir = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect()
    holder, wanted = {}, []
    for e in events:
        key = f"{e.user_id // 10}:{e.event_id % 7}"
        held = holder.get(key)
        if e.event_type == "view":
            outcome = "released" if held == e.user_id else "ignored"
            held = None if held == e.user_id else held
        elif e.event_type == "error":
            outcome, held = ("granted" if held is None else "taken"), e.user_id
        else:
            outcome = "granted" if held in (None, e.user_id) else "refused"
            held = e.user_id if held is None else held
        holder[key] = held
        wanted.append((key, e.event_id, e.user_id, outcome, held))
    assert sorted(map(tuple, stream_claims(spark, sf_dir).collect()), key=lambda r: r[1]) == wanted
