"""Hash-chained logs and roll-ups of forests against plain loops."""

from __future__ import annotations

from hashlib import sha256
import random

import pytest

from strata.operators import append_log as A
from strata.operators.forest import rolled_up

NEW = "log string, seq long, body string"


def link(bodies, prev=None):
    """[(hash, prev, body)] of a log, one after the other."""
    out = []
    for body in bodies:
        data = (f'{{"parent":"{prev}",{body}}}' if prev else f"{{{body}}}").encode()
        out.append((sha256(b"blob %d\0" % len(data) + data).hexdigest(), prev, body))
        prev = out[-1][0]
    return out


def as_logs(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.log or "", r.place)):
        out.setdefault(r.log, []).append((r.hash, r.prev, r.body))
    return out


LOGS = {"a": [f'"é":{i}' for i in range(23)], "b": ['"x":1'], "c": ['"same":1'] * 5, None: ['"n":0', '"n":1']}


@pytest.fixture(scope="module")
def linked(spark):
    rows = [(log, i, body) for log, bodies in LOGS.items() for i, body in enumerate(bodies)]
    random.Random(1).shuffle(rows)
    return A.appended(spark.createDataFrame(rows, NEW), "seq").cache()


def test_entries_are_linked_in_order(linked):
    assert as_logs(linked.collect()) == {log: link(bodies) for log, bodies in LOGS.items()}


def test_an_entry_without_body_is_empty_and_an_empty_table_has_none(spark):
    assert as_logs(A.appended(spark.createDataFrame([("a", 1, None)], NEW), "seq").collect()) == {"a": link([""])}
    nothing = A.appended(spark.createDataFrame([], NEW), "seq")
    assert nothing.count() == A.checked(nothing).count() == A.walked(nothing, A.newest(nothing)).count() == A.pruned(nothing, A.newest(nothing), 3).count() == 0


def test_appending_in_two_calls_is_appending_in_one(spark, linked):
    early = linked.filter("place < 9").select("log", "place", "hash", "prev", "body")
    late = spark.createDataFrame([("a", i, LOGS["a"][i]) for i in range(9, 23)] + [("new", 4, "z")], NEW)
    more = as_logs(A.appended(late, "seq", heads=A.newest(early)).collect())
    assert more == {"a": link(LOGS["a"])[9:], "new": link(["z"])}
    assert [r.place for r in A.appended(late, "seq", heads=A.newest(early)).filter("log = 'a'").orderBy("place").collect()] == list(range(9, 23))


def test_walks_end_at_cursors_limits_and_gaps(spark, linked):
    chain = link(LOGS["a"])
    last = chain[-1][0]

    def walk(entries, cursor, limit=None):
        heads = spark.createDataFrame([("a", last, cursor)], "log string, head string, cursor string")
        return [(r.hash, r.prev, r.body) for r in A.walked(entries, heads, limit).orderBy("step").collect()]

    backwards = chain[::-1]
    assert walk(linked, None) == backwards
    assert walk(linked, chain[7][0]) == backwards[:15]
    assert walk(linked, last) == []
    assert walk(linked, "gone") == backwards
    assert walk(linked, chain[7][0], 4) == backwards[:4]
    gap = linked.filter(f"NOT (log <=> 'a' AND hash = '{chain[10][0]}')")
    assert walk(gap, chain[3][0]) == backwards[:12]


def test_damage_is_found(linked, spark):
    a = link(LOGS["a"])
    rows = [("a", h, p, b) for h, p, b in a if h != a[5][0]]
    rows[2] = (*rows[2][:3], "changed")
    fork = link(["other"], a[8][0])[0]
    rows += [("a", *fork), ("z", "0" * 64, None, None)]
    found = {(r.log, r.hash): (r.whole, r.linked, r.forks) for r in A.checked(spark.createDataFrame(rows, "log string, hash string, prev string, body string")).collect()}
    assert found[("a", a[2][0])] == (False, True, 1)
    assert found[("a", a[4][0])] == (True, True, 0) and found[("a", a[6][0])] == (True, False, 1)
    assert found[("a", a[8][0])] == (True, True, 2) and found[("a", fork[0])] == (True, True, 0)
    assert found[("z", "0" * 64)] == (False, True, 0)
    assert sum(not w for w, _, _ in found.values()) == 2 and sum(not k for _, k, _ in found.values()) == 1


@pytest.mark.parametrize("keep", [1, 5, 23, 100])
def test_pruned_logs_are_linked_anew(linked, keep):
    named = linked.filter("log IS NOT NULL")
    wanted = {log: link(bodies[-keep:]) for log, bodies in LOGS.items() if log}
    assert as_logs(A.pruned(named, A.newest(named), keep).collect()) == wanted


def test_logs_are_dealt_anew_behind_a_join_by_log(spark):
    """Spark leaves out a repartition by the keys of a join and, once a side turns out small, reads its rows where they lie: logs began anew in each task."""
    rows = [(f"log{n}", i, f'"n":{n},"i":{i}') for n in range(9) for i in range(30)]
    new = spark.createDataFrame(rows, NEW)
    sizes = new.groupBy("log").count().filter("count > 3").hint("merge")
    found = A.appended(new.join(sizes, "log"), "seq")
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
    found = as_logs(found.collect())
    assert all(found[f"log{n}"] == link([body for log, _, body in rows if log == f"log{n}"]) for n in range(9))


def test_branches_are_put_behind_each_other(spark):
    base = link(["1", "2", "3"])
    ours, theirs = link(["o1", "o2"], base[-1][0]), link(["t1", "t2", "t3"], base[1][0])
    entries = spark.createDataFrame([("a", *e) for e in base + ours + theirs] + [("b", *e) for e in base], "log string, hash string, prev string, body string")
    heads = spark.createDataFrame([("a", ours[-1][0], 4), ("b", base[-1][0], 2)], "log string, head string, place long")
    others = spark.createDataFrame([("a", theirs[-1][0]), ("b", base[1][0])], "log string, head string")
    new = A.merged(entries, heads, others).orderBy("place").collect()
    assert [(r.log, r.place, r.hash, r.prev, r.body) for r in new] == [("a", 5 + i, *e) for i, e in enumerate(link(["t1", "t2", "t3"], ours[-1][0]))]


def plain_totals(parents, spent):
    held = {i: p if p in parents else None for i, p in parents.items()}
    out = {i: [i, 0, 0, 0, 0, None] for i in held}
    for i in held:
        up, d = i, 0
        while True:
            t = out[up]
            t[2], t[3], t[4] = max(t[2], d), t[3] + 1, t[4] + (spent[i] or 0)
            t[5] = spent[i] if t[5] is None else t[5] if spent[i] is None else max(t[5], spent[i])
            if held[up] is None:
                out[i][0], out[i][1] = up, d
                break
            up, d = held[up], d + 1
    return {i: tuple(t) for i, t in out.items()}


@pytest.mark.parametrize("shape", ["random", "line", "star", "lost"])
def test_totals_of_subtrees(spark, shape):
    rng = random.Random(shape)
    n = 120
    make = {"random": lambda i: rng.randrange(i) if i % 11 else None, "line": lambda i: i - 1 if i else None, "star": lambda i: 0 if i else None, "lost": lambda i: i + 1000 if i % 3 else (i - 1 if i else None)}[shape]
    parents = {i: make(i) for i in range(n)}
    spent = {i: rng.choice([None, -4, 7, 100]) for i in parents}
    rows = [(i, p, spent[i], spent[i]) for i, p in parents.items()] + [(None, 3, 5, 5)]
    found = rolled_up(spark.createDataFrame(rows, "id long, parent long, spent long, dearest long"), ["spent"], ["dearest"])
    assert {r.id: (r.root, r.depth, r.height, r.size, r.spent, r.dearest) for r in found.collect()} == plain_totals(parents, spent)


def test_a_cycle_is_an_error_and_no_nodes_are_none(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        rolled_up(nodes)
    assert rolled_up(nodes.limit(0)).count() == 0
    with pytest.raises(ValueError, match="named"):
        rolled_up(nodes.withColumnRenamed("parent", "size"), ["size"])
