"""Exports, references and changes of files, from one cutting of each text."""

from __future__ import annotations

from strata.functions.extract import extracted
from strata.operators import code


def test_references_cut_each_text_once(spark):
    text = 'package p\n\nimport (\n\t"m/lib"\n\tl "m/lib"\n\tl "n/lib"\n)\n\nfunc A() {\n\tlib.Do()\n\tl.Go(lib.Do)\n\tnone.Say()\n}\n'
    files = spark.createDataFrame([("p/a.go", "go", text), ("p/b.go", "go", "package p\n\nfunc B() {\n\tlib.Do()\n}\n"), ("p/c.go", "go", None)], "path string, lang string, text string")
    found = code.references(extracted(files, ["path"], only=code.REFERENCE_COLUMNS, kinds=code.REFERENCE_KINDS))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted([("m/lib.Do", "p/a.go", "A", 10), ("m/lib.Do", "p/a.go", "A", 11), ("m/lib.Go", "p/a.go", "A", 11), ("n/lib.Go", "p/a.go", "A", 11)])
    assert sorted(map(tuple, code.references(extracted(files, ["path"])).collect())) == rows
    assert [f.name for f in extracted(files, ["path"], only=("name",)).schema] == ["path", "name"]


def test_changes_and_picks_stay_within_the_row_of_a_file(spark):
    before = "package p\n\nfunc A() {}\n\nfunc B() int {\n\treturn 1\n}\n\nfunc F3() {}\n\nfunc F3() {}\n\ntype T struct{}\n"
    after = before.replace("return 1", "return 2").replace("type T struct{}\n", "func (r *R) F3() {}\n\nfunc N() {}\n").replace("func F3() {}\n\nfunc F3() {}", "func F3() {\n\tx()\n}\n\nfunc F3() { y() }")
    rows = [("a.go", "go", before, after), ("b.go", "go", before, before), ("c.go", "go", None, after), ("d.go", "go", before, None), ("e.go", "go", "", ""), ("f.go", "go", "package q\n", "package q")]
    files = spark.createDataFrame(rows, "path string, lang string, old string, new string")
    sides = [extracted(files, ["path"], x) for x in ("old", "new")]
    found = code.file_changes(files, "old", "new")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    wanted = code.entity_changes(*sides)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() > 8
    assert sorted(map(str, code.line_diff_text(found).collect())) == sorted(map(str, code.line_diff_text(wanted).collect()))
    edits = sides[1].filter("name = 'F3'").select("path", "key", "body")
    picked = code.picked(files, "F3", into="old", source="new")
    assert "Exchange" not in picked._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, picked.collect())) == sorted(map(tuple, code.applied_edits(sides[0], edits).collect()))
