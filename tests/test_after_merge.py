"""Rules over merges and impact to a fixpoint, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import entity_merge as M
from strata.operators import merge_rules as R
from strata.operators import module_impact as I

FILES = "path string, lang string, base string, ours string, theirs string"
GO = "package p\n\ntype S interface {{\n\tGet() int\n{}}}\n\nvar (\n\ta = {}\n)\n\nfunc init() {{\n\trun({})\n}}\n"


@pytest.fixture(scope="module")
def matched(spark):
    base = GO.format("", 0, 0)
    rows = [
        ("ours.go", "go", base, GO.format("\t// a note\n\n\tPut()\n\tDrop()\n", 1, 1), base),
        ("theirs.go", "go", base, base, GO.format("\tPut()\n", 0, 2)),
        ("both.go", "go", base, GO.format("\tPut()\n", 1, 1), GO.format("\tDrop()\n", 2, 2)),
        ("note.go", "go", base, GO.format("\t// only a note\n", 0, 0), base),
        ("fewer.go", "go", GO.format("\tPut()\n", 0, 0), base, GO.format("\tPut()\n", 0, 0)),
        ("gone.go", "go", base, None, GO.format("", 1, 1)), ("same.go", "go", base, GO.format("\tPut()\n", 1, 1), GO.format("\tPut()\n", 1, 1)),
        ("x.py", "python", "def init():\n    return 0\n", "def init():\n    return 1\n", "def init():\n    return 2\n"), ("empty.go", "go", None, None, None),
    ]
    return M.matched(M.versions(spark.createDataFrame(rows, FILES))).cache()


def test_rules_of_go(matched):
    found = {(r.path, r.rule, r.severity, r.message) for r in R.diagnostics(matched).collect()}
    more = "S: {} added {} method(s) to interface — implementors may need updating"
    assert found == {
        ("ours.go", "go-interface-impl", "warning", more.format("ours", 2)), ("theirs.go", "go-interface-impl", "warning", more.format("theirs", 1)),
        ("both.go", "go-const-var-block", "info", "a: both sides modified const/var block — consider set-union merge"),
        ("both.go", "go-init-func", "warning", "init() modified on both sides — review carefully, execution order may matter"),
    }


def test_a_rule_of_the_caller(matched):
    def edited(rows):
        return R.diagnostic(rows.filter("disposition = 'Conflict'"), "info", "edited-twice", F.col("base.name"))

    found = R.diagnostics(matched, {**R.DEFAULT, "python": [edited]})
    assert [(r.path, r.message) for r in found.filter("rule = 'edited-twice'").collect()] == [("x.py", "init")]
    assert found.count() == 5
    assert R.diagnostics(matched, {}).count() == 0 and R.diagnostics(matched.limit(0)).count() == 0


def plain_impact(uses, changed):
    found = {n: (0, n, [n]) for n in changed}
    frontier = set(found)
    for step in range(1, 1000):
        by = {}
        for a, b in uses:
            if b in frontier and a not in found:
                by[a] = min(by.get(a, b), b)
        if not by:
            return found
        found |= {a: (step, found[b][1], [*found[b][2], a]) for a, b in by.items()}
        frontier = set(by)


@pytest.mark.parametrize("shape", ["random", "line", "star"])
def test_impact_on_graphs_with_cycles(spark, shape):
    rng = random.Random(3)
    uses = {"random": [(rng.randrange(80), rng.randrange(80)) for _ in range(130)], "line": [(i + 1, i) for i in range(30)] + [(0, 30)], "star": [(i, 0) for i in range(60)] + [(0, 59), (100, 1)]}[shape]
    changed = {"random": [3, 17, 999], "line": [4], "star": [0]}[shape]
    rows = spark.createDataFrame([*uses, *uses[:5], (None, 3), (7, None)], "user long, used long")
    found = I.impacted(rows, spark.createDataFrame([(n,) for n in [*changed, changed[0], None]], "node long"))
    assert {r.node: (r.distance, r.source, r.path) for r in found.collect()} == plain_impact(uses, changed)


def test_references_count_where_the_module_is_required(spark):
    references = [("app", "main", "lib", "Do"), ("lib", "Do", "lib", "help"), ("other", "x", "lib", "Do"), ("top", "t", "app", "main"), ("lib", "help", "top", "t"), (None, "y", "lib", "Do")]
    requires = [("app", "lib"), ("top", "app"), ("lib", "top"), ("other", None)]
    refs = spark.createDataFrame(references, "module string, entity string, uses_module string, uses_entity string")
    needs, changes = spark.createDataFrame(requires, "module string, needs string"), spark.createDataFrame([("lib", "help"), (None, "z")], "module string, entity string")
    found = I.module_impact(refs, needs, changes)
    assert {(r.module, r.entity, r.distance, r.source_entity, ">".join(p.entity for p in r.path)) for r in found.collect()} == {
        ("lib", "Do", 1, "help", "help>Do"), ("app", "main", 2, "help", "help>Do>main"), ("top", "t", 3, "help", "help>Do>main>t")
    }
    assert {tuple(r) for r in I.modules_hit(found).collect()} == {("lib", "app", 1, 2), ("lib", "top", 1, 3)}
    assert I.module_impact(refs.limit(0), needs, changes).count() == I.module_impact(refs, needs, changes.limit(0)).count() == 0
