"""The text kernel against brute force and by its invariants."""

from __future__ import annotations

import random
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest

from strata.functions import lines
from strata.functions.extract import extract_entities, pieces
from strata.functions.lines import edit_script, merge3, merge_texts, similarity, split_lines
from strata.operators import renames
from strata.plans import texts as plans
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

LINES = st.lists(st.sampled_from("abcd"), max_size=9)


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=300, deadline=None)
@given(LINES, LINES)
def test_edit_script_is_shortest_and_exact(a, b):
    ops = edit_script(a, b)
    assert [s for o, s in ops if o != "+"] == a
    assert [s for o, s in ops if o != "-"] == b
    assert sum(o == "=" for o, _ in ops) == common(a, b)


@settings(max_examples=200, deadline=None)
@given(LINES, LINES)
def test_merge_with_one_side_unchanged_is_the_other(a, b):
    base, side = "\n".join(a), "\n".join(b)
    assert split_lines(merge3(base, side, base)[0]) == split_lines(side)
    assert split_lines(merge3(base, base, side)[0]) == split_lines(side)
    assert merge3(base, side, side)[1] == 0


def test_merge_takes_both_and_marks_conflicts():
    base = "1\n2\n3\n4\n5\n"
    assert merge3(base, "x\n2\n3\n4\n5\n", "1\n2\n3\n4\ny\n") == ("x\n2\n3\n4\ny\n", 0)
    text, n = merge3(base, "1\na\n3\n4\n5\n", "1\nb\n3\n4\n5\n")
    assert n == 1 and text == "1\n<<<<<<< ours\na\n=======\nb\n>>>>>>> theirs\n3\n4\n5\n"
    assert merge3("", "a", "b")[1] == 1


@pytest.mark.parametrize(
    "base, ours, theirs, merged, conflicts",
    [
        ("a b c d", "a B c d", "a b C d", "a B C d", 0),  # neighbours
        ("a b c d", "a B c d", "a b x c d", "a B x c d", 0),  # inserted after a changed line
        ("a b c d", "a x b c d", "A b c d", "A x b c d", 0),
        ("a b c", "a x b c", "a y b c", "a <<<<<<< ours x ======= y >>>>>>> theirs b c", 1),  # both insert at one place
        ("a b c", "a x b c", "a x b c", "a x b c", 0),
        ("a b c", "a x b c", "a B c", "a <<<<<<< ours x b ======= B >>>>>>> theirs c", 1),
        ("a b c d e", "a X e", "a b C d e", "a <<<<<<< ours X ======= b C d >>>>>>> theirs e", 1),
        ("a b c d", "b c d", "a b c", "b c", 0),  # deletions at both ends
        ("a a a a", "a a a", "a a a a b", "a a a b", 0),
        ("a b c", "a c", "a b c d", "a c d", 0),
        ("a b c", "a c", "a B c", "a <<<<<<< ours ======= B >>>>>>> theirs c", 1),
    ],
)
def test_merges(base, ours, theirs, merged, conflicts):
    lines = ["\n".join(x.replace("<<<<<<< ours", "<1").replace(">>>>>>> theirs", ">3").split(" ")) for x in (base, ours, theirs, merged)]
    text, n = merge3(*lines[:3])
    assert (text.replace("<<<<<<< ours", "<1").replace("=======", "=======").replace(">>>>>>> theirs", ">3"), n) == (lines[3], conflicts)


def test_insertions_into_a_blank_place_stand_together():
    assert merge3("", "a\n", "b\n", join_insertions=True) == ("a\nb\n", 0)
    assert merge3("x\n\ny\n", "x\n\na\ny\n", "x\n\nb\ny\n", join_insertions=True) == ("x\n\na\nb\ny\n", 0)
    assert merge3("", "a\n", " a\n", join_insertions=True) == ("a\n", 0)
    assert merge3("k\n", "a\n", "b\n", join_insertions=True)[1] == 1


def test_equal_scripts_are_told_apart():
    assert edit_script("ab", "acbb") == [("=", "a"), ("+", "c"), ("=", "b"), ("+", "b")]
    assert edit_script("a", "b") == [("-", "a"), ("+", "b")]


def test_scripts_are_shortest_and_the_same_however_many_bands_are_kept(monkeypatch):
    rng = random.Random(11)
    for _ in range(300):
        letters = "abcdefgh"[: rng.choice([1, 2, 3, 8])]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(30))] for _ in range(2))
        monkeypatch.setattr(lines, "BANDS", 256)
        monkeypatch.setattr(lines, "FEW", 100)
        script = edit_script(a, b)
        assert [s for op, s in script if op != "+"] == a and [s for op, s in script if op != "-"] == b
        assert sum(op == "=" for op, _ in script) == common(a, b)
        monkeypatch.setattr(lines, "FEW", rng.choice([0, 2, 7]))
        monkeypatch.setattr(lines, "BANDS", rng.choice([1, 2, 5]))
        assert edit_script(a, b) == script


def test_long_texts_without_a_common_line_take_little_memory():
    tracemalloc.start()
    script = edit_script([f"a{i}" for i in range(3_000)], [f"b{i}" for i in range(3_000)])
    assert len(script) == 6_000 and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_similarity():
    assert similarity("", "") == 1.0
    assert similarity("a\nb\nc\nd", "a\nb\nc\nx") == 0.75


@pytest.mark.parametrize(
    "language, text, names",
    [
        ("go", 'package p\n\nimport (\n\t"fmt"\n)\n\n// doc\nfunc A() {\n\tfmt.Println("}")\n}\n\nfunc (s *S) B(x int) int { return x }\n\ntype T struct {\n\ta int\n}\n', ["A", "B", "T"]),
        ("python", "import os\nimport sys\n\n\n@d\ndef f(a):\n    return 'é'\n\n\nclass C:\n    pass\n", ["f", "C"]),
        ("rust", "use std::io;\n\npub fn a() -> u8 {\n    1\n}\n\nstruct S {\n    x: u8,\n}\n", ["a", "S"]),
        ("typescript", "import { a } from 'b'\n\nexport class K {\n  m() { return `}` }\n}\n", ["K"]),
        ("", "plain text\n", []),
        ("python", "def broken(:\n", []),
        ("go", "", []),
    ],
)
def test_pieces_cover_the_text(language, text, names):
    found = pieces(text, language)
    assert "".join(text[a:b] for a, b, *_ in found) == text
    assert [p[5] for p in found if p[2] == "declaration"] == names
    assert all(x[1] == y[0] for x, y in zip(found, found[1:]))


def test_extraction_as_rows(spark):
    files = spark.createDataFrame([("a.go", "package p\nfunc init() {}\nfunc init() {}\n", "go"), ("b", None, None)], "path string, text string, lang string")
    files.createOrReplaceTempView("files")
    spark.udtf.register("extract_entities", extract_entities)
    rows = spark.sql("SELECT path, e.* FROM files, LATERAL extract_entities(text, lang) e ORDER BY path, pos").collect()
    assert [(r.kind, r.name, r.ordinal) for r in rows if r.kind == "declaration"] == [("declaration", "init", 0), ("declaration", "init", 1)]
    assert rows[0].start_byte == 0 and rows[-1].end_byte == len("package p\nfunc init() {}\nfunc init() {}\n")


def test_merge_settles_plain_rows_without_python(spark):
    rows = [(1, "a\nb\nc", "a\nb\nc", "x\nb\nc"), (2, "a", "b", "b"), (3, "a", "b", "c"), (4, None, None, "t"), (5, None, "o", None)]
    df = spark.createDataFrame(rows, "id int, b string, o string, t string")
    found = {r.id: (r.merged, r.conflicts) for r in merge_texts(df, "b", "o", "t").collect()}
    assert found[1] == ("x\nb\nc", 0) and found[2] == ("b", 0) and found[3][1] == 1
    assert found[4] == ("t", 0) and found[5] == ("o", 0)
    plain = df.filter("id < 3").select("id", "b", F.col("b").alias("o"), "t")
    assert [r.conflicts for r in merge_texts(plain, "b", "o", "t").collect()] == [0, 0]


def test_renames_are_one_to_one(spark):
    old = [("f", 1, "a\nb\nc\nd\ne"), ("f", 2, "a\nb\nc\nd\ne"), ("g", 3, "a\nb\nc\nd\ne")]
    new = [("f", 11, "a\nb\nc\nd\nx"), ("f", 12, "a\nb\nc\nd\ne"), ("f", 13, "q")]
    sides = [spark.createDataFrame(x, "kind string, id long, body string") for x in (old, new)]
    found = {(r.old, r.new): r.score for r in renames.assign(renames.candidates(*sides)).collect()}
    assert found == {(1, 12): 1.0, (2, 11): 0.8}


def by_hand(base, ours, theirs):
    """Merge by classes of changes: two are related if their ranges overlap or begin at one line."""
    changes = []
    for side, lines in enumerate((ours, theirs)):
        at, run = 0, None
        for op, line in [*edit_script(base, lines), ("=", None)]:
            if op == "=":
                if run:
                    changes.append((run[0], at, side, run[1]))
                at, run = at + 1, None
            else:
                run = run or (at, [])
                run[1].extend([line] * (op == "+"))
                at += op == "-"
    classes = [{c} for c in range(len(changes))]
    for i, x in enumerate(changes):
        for j, y in enumerate(changes[:i]):
            if x[0] == y[0] or max(x[0], y[0]) < min(x[1], y[1]) or (x[0] < y[0] < x[1]) or (y[0] < x[0] < y[1]):
                one, other = (next(c for c in classes if k in c) for k in (i, j))
                if one is not other:
                    classes.remove(other)
                    one |= other
    out, at, conflicts = [], 0, 0
    for c in sorted((sorted(changes[k] for k in c) for c in classes), key=lambda c: (c[0][0], max(x[1] for x in c))):
        first, last = c[0][0], max(x[1] for x in c)
        texts = []
        for side in (0, 1):
            text, here = [], first
            for a, b, _, lines in (x for x in c if x[2] == side):
                text += base[here:a] + lines
                here = b
            texts.append(text + base[here:last])
        out += base[at:first]
        only = {x[2] for x in c}
        if len(only) == 1 or texts[0] == texts[1]:
            out += texts[min(only)]
        else:
            conflicts += 1
            out += ["<<<<<<< ours", *texts[0], "=======", *texts[1], ">>>>>>> theirs"]
        at = last
    return out + base[at:], conflicts


@settings(max_examples=400, deadline=None)
@given(LINES, LINES, LINES)
def test_merges_by_hand(base, ours, theirs):
    lines, conflicts = by_hand(base, ours, theirs)
    assert merge3("\n".join(base), "\n".join(ours), "\n".join(theirs)) == ("\n".join(lines), conflicts)


def test_whole_table_of_texts_by_brute_force(spark, tmp_path):
    texts = [None, "", "\n", "a", "a\n", "a\nb", "a\na", "a\na\na", "a\nb\n", "\n\n\n", "a\na\na\na\na\na", "a\nb\na\nb\na\nb\n", "a\nb\nc\nd\ne", "a\nb\nc\nd", "x\n\nx\n\nx\n"]
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def replaced(text, at, line):
        lines = text.split("\n")
        lines[at] = line
        return "\n".join(lines)

    def merged(base, ours, theirs):
        lines, n = by_hand(*map(split_lines, (base, ours, theirs)))
        ended = any(t.endswith("\n") for t in (base, ours, theirs))
        return "\n".join(lines) + "\n" * bool(ended and lines), n

    scripts, ends, report = {}, {}, {}
    for i, t in rows:
        t = t or ""
        at = min(2, t.count("\n"))
        a, b = split_lines(t), split_lines(replaced(t, at, "rewritten"))
        n = common(a, b)
        scripts[i] = (n, len(a) - n, len(b) - n)
        ends[i] = merged(t, replaced(t, 0, "OURS"), replaced(t, -1, "THEIRS"))
        ours = replaced(t, at, "ours") if i % 4 in (1, 3) else t
        theirs = replaced(t, at, "theirs") if i % 4 in (2, 3) else t
        m, n = (theirs, 0) if ours == t else (ours, 0) if theirs == t else merged(t, ours, theirs)
        f, c, k = report.get(i % 4, (0, 0, 0))
        report[i % 4] = (f + 1, c + n, k + m.count("\n") + 1)
    assert {r.doc_id: (r.kept, r.removed, r.added) for r in plans.myers_ops_all(spark, str(tmp_path)).collect()} == scripts
    assert {r.doc_id: (r.merged, r.conflicts) for r in plans.diff3_merge_all(spark, str(tmp_path)).collect()} == ends
    assert {r.side: (r.files, r.conflicts, r.lines) for r in plans.merge_preview_all(spark, str(tmp_path)).collect()} == report


def test_renames_are_those_of_the_greedy_order(spark, monkeypatch):
    rng = random.Random(6)
    bodies = ["", "\n", None] + ["same\nbody"] * 7 + ["a\nb\n\n", "a\nb\n"]
    bodies += ["\n".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) + "\n" * rng.randint(0, 1) for _ in range(60)]
    bodies += ["\n".join(x if rng.random() > 0.1 else "z" for x in b.split("\n")) for b in bodies if b]
    rows = [(rng.choice("fg"), i, b) for i, b in enumerate(bodies)]
    sides = [rows[0::2], rows[1::2]]
    scored = [(-similarity(b or "", d or ""), i, j, k) for k, i, b in sides[0] for m, j, d in sides[1] if k == m]
    wanted, used = set(), set()
    for s, i, j, k in sorted(x for x in scored if x[0] <= -0.8):
        if not {(0, i), (1, j)} & used:
            used |= {(0, i), (1, j)}
            wanted.add((k, i, j, -s))
    frames = [spark.createDataFrame(x, "kind string, id long, body string") for x in sides]
    monkeypatch.setattr(GroupedData, "applyInPandas", None)  # no kind is gathered in one task
    assert {tuple(r) for r in renames.renamed(*frames).collect()} == wanted
    assert {tuple(r) for r in renames.assign(renames.candidates(*frames)).collect()} == wanted


def test_hunk_ranges_by_hand(spark):
    from strata.operators.code import hunk_ranges

    rng = random.Random(2)
    scripts = [(i, [("=", "x") if rng.random() < 0.8 else (rng.choice("+-"), "y") for _ in range(rng.randint(0, 40))]) for i in range(40)]
    wanted = set()
    for key, ops in scripts:
        changed = [i for i, (o, _) in enumerate(ops) if o != "="]
        held = sorted({j for i in changed for j in range(max(0, i - 3), min(len(ops), i + 4))})
        runs = [[j for j in held if j - held.index(j) == g] for g in sorted({j - held.index(j) for j in held})]
        for number, run in enumerate(runs, 1):
            old, new = (1 + sum(o in ("=", s) for o, _ in ops[: run[0]]) for s in "-+")
            counts = [sum(ops[j][0] in ("=", s) for j in run) for s in "-+"]
            wanted.add((key, number, old - (not counts[0]), counts[0], new - (not counts[1]), counts[1]))
    df = spark.createDataFrame(scripts, "id long, ops array<struct<op:string,line:string>>")
    assert {tuple(r) for r in hunk_ranges(df, "id").collect()} == wanted
