"""The structural merge: files that lines alone cannot merge, renames, members, and the cases it leaves to lines and bytes."""

from __future__ import annotations

from strata.functions.members import merge_members
from strata.operators.entity_merge import matched, merge_files, resolved, versions, with_renames
from strata.plans.structural import source_files

HEAD = 'package main\n\nimport "fmt"\n'
HELLO = 'func Hello() {\n\tfmt.Println("hello")\n}'


def func(name, *lines, args=""):
    return f"func {name}({args}) {{\n" + "".join(f"\t{x}\n" for x in lines) + "}"


def go(*parts):
    return "\n\n".join(parts) + "\n"


LONG = ["a := 1", "b := 2", "c := 3", "d := 4", "e := 5", "f := 6", "g := 7", "return a"]
CASES = {
    # both sides add a function, at different places
    "add.go": ("go", go(HEAD.strip(), HELLO), go(HEAD.strip(), HELLO, func("Bye", "bye()")), go(HEAD.strip(), func("Greet", "hi()"), HELLO)),
    # both sides add a function at the same place
    "same.go": ("go", go(HEAD.strip(), HELLO), go(HEAD.strip(), HELLO, func("A", "a()")), go(HEAD.strip(), HELLO, func("B", "b()"))),
    # one function, two changes that lie apart, and one that clashes
    "apart.go": ("go", go("package p", func("F", *LONG)), go("package p", func("F", "a := 9", *LONG[1:])), go("package p", func("F", *LONG[:-1], "return b"))),
    "clash.go": ("go", go("package p", func("F", *LONG)), go("package p", func("F", "a := 8", *LONG[1:])), go("package p", func("F", "a := 9", *LONG[1:]))),
    # deleted here, changed there; deleted here, untouched there
    "gone.go": ("go", go("package p", func("F", "x()"), func("G", "y()")), go("package p", func("G", "y()")), go("package p", func("F", "z()"), func("G", "y()"))),
    "drop.go": ("go", go("package p", func("F", "x()"), func("G", "y()")), go("package p", func("G", "y()")), go("package p", func("F", "x()"), func("G", "z()"))),
    # renamed here, another function added there; renamed and changed a little
    "renamed.go": (
        "go", go("package p", func("Old", *LONG)), go("package p", func("New", *LONG[:-1], "return c")), go("package p", func("Old", *LONG), func("K", "k()")),
    ),
    # both renamed it, to different names; to the same name
    "twice.go": ("go", go("package p", func("Old", *LONG), func("K", "k()")), go("package p", func("One", *LONG), func("K", "k()")), go("package p", func("Two", *LONG), func("K", "k()"))),
    # imports and members
    "imports.go": (
        "go", 'package p\n\nimport (\n\t"a"\n\t"b"\n)\n\nfunc F() {}\n', 'package p\n\nimport (\n\t"a"\n\t"b"\n\t"c"\n)\n\nfunc F() {}\n',
        'package p\n\nimport (\n\t"b"\n\t"d"\n)\n\nfunc F() {}\n',
    ),
    "struct.go": ("go", "package p\n\ntype T struct {\n\tA int\n\tB int\n}\n", "package p\n\ntype T struct {\n\tA int\n\tB int\n\tC int\n}\n", "package p\n\ntype T struct {\n\tA string\n\tB int\n}\n"),
    # no declarations; no grammar; binary
    "empty.go": ("go", "", func("A", "a()") + "\n", func("B", "b()") + "\n"),
    "notes.md": ("", "a\nb\nc\nd\n", "A\nb\nc\nd\n", "a\nB\nc\nd\n"),
    "x.bin": ("", "a\0", "b\0", "c\0"),
    "y.bin": ("", "a\0", "a\0", "c\0"),
    "null.txt": ("", None, "mine\n", None),
}


def files(spark, names=None):
    rows = [(k, *v) for k, v in CASES.items() if names is None or k in names]
    return spark.createDataFrame(rows, "path string, lang string, base string, ours string, theirs string")


def test_merged_files(spark):
    found = {r.path: (r.merged, r.conflicts, r.way) for r in merge_files(files(spark)).collect()}
    assert set(found) == set(CASES)
    text, conflicts, way = found["add.go"]
    assert conflicts == 0 and way == "entities" and text.count("func ") == 3
    assert text.index("func Greet") < text.index("func Hello") < text.index("func Bye")
    assert found["same.go"][1] == 0 and found["same.go"][0].index("func A") < found["same.go"][0].index("func B")
    assert found["apart.go"][:2] == (go("package p", func("F", "a := 9", *LONG[1:-1], "return b")), 0)
    mine, other = func("F", "a := 8", *LONG[1:]), func("F", "a := 9", *LONG[1:])
    assert found["clash.go"][:2] == (f"package p\n\n<<<<<<< ours (func F)\n{mine}\n=======\n{other}\n>>>>>>> theirs (func F)\n\n", 1)
    text, conflicts, _ = found["gone.go"]
    assert conflicts == 1 and f"<<<<<<< ours (func F)\n\n=======\n{func('F', 'z()')}\n>>>>>>> theirs (func F)\n" in text
    text, conflicts, _ = found["drop.go"]
    assert conflicts == 0 and "func F" not in text and func("G", "z()") in text
    text, conflicts, _ = found["renamed.go"]
    assert conflicts == 0 and "func Old" not in text and func("New", *LONG[:-1], "return c") in text and func("K", "k()") in text
    text, conflicts, _ = found["twice.go"]
    assert conflicts == 1 and text.count("func One()") == text.count("func Two()") == 1 and "func Old" not in text
    assert 'import (\n\t"b"\n\t"c"\n\t"d"\n)' in found["imports.go"][0] and found["imports.go"][1] == 0
    assert "type T struct {\n\tA string\n\tB int\n\tC int\n}" in found["struct.go"][0] and found["struct.go"][1] == 0
    assert found["empty.go"] == (func("A", "a()") + "\n" + func("B", "b()") + "\n", 0, "lines")
    assert found["notes.md"] == ("A\nB\nc\nd\n", 0, "lines")
    assert found["x.bin"] == ("b\0", 1, "bytes") and found["y.bin"] == ("c\0", 0, "bytes")
    assert found["null.txt"] == ("mine\n", 0, "lines")


def test_dispositions_and_conflicts(spark):
    rows = with_renames(matched(versions(files(spark, {"renamed.go", "twice.go", "gone.go", "clash.go"}))))
    found = {(r.path, r.disposition) for r in resolved(rows).filter("kind = 'declaration'").collect()}
    assert found == {("renamed.go", "RenamedOurs"), ("renamed.go", "AddedTheirs"), ("twice.go", "Conflict"), ("twice.go", "Unchanged"), ("gone.go", "DeleteVsModify"), ("gone.go", "Unchanged"), ("clash.go", "Conflict")}
    none = spark.createDataFrame([], files(spark).schema)
    assert merge_files(none).count() == 0


def test_one_side_alone_keeps_every_entity(spark):
    """With ours untouched, each entity is as theirs has it."""
    base = go("package p", func("F", "x()"), func("G", "y()"))
    theirs = go("package p", func("F", "x()"), func("H", "h()"), func("G", "z()"))
    df = spark.createDataFrame([("f", "go", base, base, theirs), ("g", "go", base, theirs, theirs)], files(spark).schema)
    found = {r.path: r for r in merge_files(df).collect()}
    for part in (func("F", "x()"), func("H", "h()"), func("G", "z()")):
        assert found["f"].merged.count(part) == found["g"].merged.count(part) == 1
    assert found["f"].conflicts == found["g"].conflicts == 0


def test_members():
    def struct(*fields):
        return "type T struct {\n" + "".join(f"\t{x}\n" for x in fields) + "}"

    def merged(base, ours, theirs):
        return merge_members("declaration", "type_declaration", "go", struct(*base), struct(*ours), struct(*theirs))

    assert merged(["A int"], ["A int", "B int"], ["A int", "C int"]) == struct("A int", "B int", "C int")
    assert merged(["A int", "B int"], ["B int"], ["A int", "B int"]) == struct("B int")
    assert merged(["A int"], ["A string"], ["A bool"]) is None
    assert merged([], ["A string"], ["A bool"]) is None
    assert merged(["A int"], ["A int"], ["A bool"]) == struct("A bool")
    assert merge_members("declaration", "function_declaration", "go", "", "", "") is None
    assert merge_members("import_block", "", "python", "import a\n", "import a\nimport b as c\n", "from d import e, f\n") == "from d import e\nfrom d import f\nimport b as c\n"
    assert merge_members("import_block", "", "rust", "use a::b;\n", "use a::b;\npub use c;\n", "use a::b;\nuse x::{y, z};\n") == "pub use c;\nuse a::b;\nuse x::{y, z};\n"
    assert merge_members("import_block", "", "typescript", "", "import A from 'm'", "import B from 'm'") is None


def test_bodies_are_moved_once_and_no_hashes(spark):
    rows = matched(versions(files(spark, {"renamed.go", "clash.go"})))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert "body_hash" not in rows.select("base.*").columns


def test_source_files_are_dealt_out_once(spark):
    plan = source_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
