"""The merge within the row of a file against the same steps as plans over rows of entities."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strata.functions import cutter
from strata.operators import entity_merge as M
from test_entity_merge import CASES, LONG, func, go

FILES = "path string, lang string, base string, ours string, theirs string"
CLASSES = {
    "python": [["class A:\n    x = 1\n\n    def m(self):\n        return 1\n", "class A:\n    x = 2\n\n    def m(self):\n        return 2\n\n    def n(self):\n        pass\n"], ["def f():\n    return 1\n", "def f():\n    return 2\n"], ["import a\n", "import b\n"]],
    "rust": [["impl X {\n    fn a() {}\n\n    fn b() { y() }\n}\n", "impl X {\n    fn a() { z() }\n\n    fn c() {}\n}\n", "impl X {\n    fn b() { w() }\n}\n"], ["fn g() {}\n", "fn h() {}\n"]],
    "typescript": [["class B {\n  m() { return 1 }\n\n  k() { return 2 }\n}\n", "class B {\n  m() { return 3 }\n}\n"], ["const a = 1;\n", "const a = 2;\n"], ["// note\nfunction f() { return 1 }\n", "function f() { return 1 }\n"]],
    "go": [[func("F", *LONG), func("F", "a := 9", *LONG[1:]), func("F", *LONG[:-1], "return b"), func("G", *LONG), func("H", *LONG[:-1], "return c")], ["// doc\n" + func("K", "k()"), func("K", "k()"), func("K", "x()")], ["type T struct {\n\tA int\n}", "type T struct {\n\tA string\n\tB int\n}"], [func("Z"), func("Y"), "/* alone */"]],
}


def texts(rng, lang):
    parts = CLASSES[lang]
    chosen = [rng.choice(p) for p in parts if rng.random() < 0.8]
    rng.shuffle(chosen)
    return ("package p\n\n" if lang == "go" else "") + "\n\n".join(chosen) + "\n"


def test_row_and_plans_merge_alike(spark):
    rng = random.Random(8)
    rows = [(k, *v) for k, v in CASES.items() if v[0]]
    rows += [(f"{lang}{i}", lang, *(texts(rng, lang) for _ in range(3))) for lang in CLASSES for i in range(60)]
    files = spark.createDataFrame(rows, FILES)
    columns = ("path", "key", "disposition", "text", "conflict", "name", "kind")
    planned = M.resolved(M.with_renames(M.matched(M.versions(files)))).cache()
    found = sorted(tuple(r) for r in M.merged_entities(files, *columns[1:]).collect())
    assert found == sorted(tuple(r) for r in planned.select(*columns).collect())
    assert {"RenamedOurs", "RenamedTheirs", "Conflict", "DeleteVsModify"} <= {r[2] for r in found} and sum(r[4] for r in found) > 20
    whole = {r.path: (r.merged, r.conflicts) for r in M.reconstructed(planned).collect()}
    merged = {r.path: (r.merged, r.conflicts) for r in M.merge_files(files).collect() if r.way == "entities"}
    assert len(merged) > 150 and merged == {p: whole[p] for p in merged}


def test_a_merge_moves_and_writes_nothing(spark, monkeypatch):
    """The row of a file has all that its merge needs; a tree is moved once."""
    monkeypatch.setattr(M, "settled", None)
    files = spark.createDataFrame([("a.go", "go", *(go("package p", func("F", x)) for x in "abc"))], FILES)
    plan = M.merge_files(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" not in M.merged_entities(files, "name")._jdf.queryExecution().executedPlan().toString()
    sides = [files.select("path", "lang", F.col(s).alias("text")) for s in M.SIDES]
    trees = M.merge_trees(*sides)
    assert trees._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.way, r.conflicts) for r in trees.collect()] == [("entities", 1)]


def test_plain_go_is_cut_as_by_the_tree(monkeypatch):
    heads = ["package p", 'import "fmt"', 'import (\n\t"a"\n)', func("F", "x(y[1])", args="a int"), "func (r *T) M() { x() }", "type T struct {\n\tA int\n}", "func G() (int, error) { return 1, nil }", "type X = int", 'func S() { x := "}" }', "func é() {}", "func Q() {}; func R() {}", "}", ";"]
    rng = random.Random(3)
    cases = ["".join(rng.choice(heads) + rng.choice(["\n", "\n\n", " ", " // c\n", "\n/* d\n */\n", "\r\n"]) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    plain = cutter._go_plain
    assert sum(plain(t) is not None for t in cases) > 300
    quick = [cutter.cut(t, "go") for t in cases]
    monkeypatch.setattr(cutter, "_go_plain", lambda text: None)
    assert quick == [cutter.cut(t, "go") for t in cases]
