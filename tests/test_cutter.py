"""The cutter: nesting, the pieces of each language, and merges that keep every declaration once."""

from __future__ import annotations

from collections import Counter
import random

import pytest

from strata.functions.cutter import cut, scan
from strata.functions.extract import entities
from strata.operators.entity_merge import merge_files


def named(text, language):
    found = cut(text, language)
    assert "".join(text[p.start : p.end] for p in found) == text
    assert all(a.end == b.start for a, b in zip(found, found[1:]))
    return [(p.decl_kind, p.receiver, p.name) for p in found if p.kind == "declaration"]


def keys(text, language):
    found = [e["key"] for e in entities(text, language)]
    assert len(found) == len(set(found))
    return [k for k in found if not k.startswith("between:")]


GO = """// Package p is one.
package p

import "fmt"
import (
	"os"
)

// limits
const (
	X = 1
	Y = 2 // two
)

var a, b = 1, 2

type (
	T struct{ n int }
	U = T
)

// F does.
func F() string { return `}` + "}" + string('}') }

func (s *S[K]) M(x map[string]int) (int, error) {
	if x := f(); x > 0 {
		return 0, nil
	}
	return a +
		b, nil
}

func (Plain) N() {}

var table = []int{
	1,
	2,
}

type V interface {
	F() error
}
"""
RUST = """use std::{io, fmt};

#[derive(Debug)]
pub struct S<'a, T: Fn(u8) -> u8> {
    x: &'a T,
}

pub(crate) const fn one() -> [u8; 2] { [b'}', b'\\''] }

impl<'a, T> fmt::Display for S<'a, T> {
    /// shows { it
    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result { write!(f, r#"}"{"#) }

    #[inline]
    pub async fn other<'b>(&'b self) -> char { '}' }
}

trait Empty {}
macro_rules! m { ($x:expr) => { { $x } }; }
pub unsafe extern "C" fn ext(a: i32) {}
static mut Z: [u8; 1] = [0];
enum E { A { x: i32 }, B }
/* outer /* inner */ still { */
mod inner { fn hidden() {} }
m!{ 1 }
"""
SCRIPT = """import { a, b } from './x'
import type { C } from 'c';

// greets
export function greet(name: string): { text: string } {
  return { text: `hi ${name ? `dear ${"}"} ${name}` : '{'}` }
}

export default class K { m() { return `}` } }

abstract class Base<T> extends Other {
  static count = 0
  private readonly re = /[/}]{2}/g;
  handler = (x: number) => {
    return x / 2
  }

  constructor(private x: number) { super() }
  abstract area(): number;
  get size(): number { return 1 }
  async *gen<T>(a: { b: T }): AsyncGenerator<T> { yield a.b }
}

const list = [
  1,
  2,
];
let fn = function () {
  return list.map(x => x / 2)
    .filter(Boolean)
}
interface Shape { area(): number }
type Pair<A> = {
  left: A
} | null
enum Colour { Red, Green }
const enum Small { A }
declare namespace N { const y: number }
overloaded(1)
if (list) {
  go()
} else {
  stop()
}
function over(a: string): void;
function over(a: any) { }
export { list, fn as other }
export * from 'y'
"""
C = """#include <stdio.h>
#include "x.h"

#define MAX(a, b) \\
  ((a) > (b) ? (a) : (b))

typedef struct { int x; } point;
typedef unsigned long size;
typedef int (*callback)(void *);

struct node {
    struct node *next;
};

enum colour { RED, GREEN };

static const char *name(void) {
    return "}";
}

unsigned long f(int a[]) { return '}'; }

int
main(void)
{
    return 0;
}

struct node *make(int n);
static int table[] = { 1, 2 };
int counter = 0, other;
"""
PYTHON = '''#!/usr/bin/env python
"""Doc."""
import os
from a import (
    b,
)

LIMIT = 3  # most

# adds
def add(a, b={"}": 1}):
    """Adds é."""
    return a + b


@wrap(
    1
)
class Decorated:
    def m(self): pass


class Outer(Base, metaclass=dict(a=1)):  # note
    """Doc: outer."""

    size: int = 3

    @property
    def value(self):
        return self.size

    # the inner one
    class Inner:
        def deep(self):
            return "class X:"

    def last(self):
        pass


if __name__ == "__main__":
    add(1, 2)
'''


def test_go():
    assert named(GO, "go") == [
        ("const_declaration", "", "X"), ("var_declaration", "", "a"), ("type_declaration", "", "T"), ("function_declaration", "", "F"),
        ("method_declaration", "S", "M"), ("method_declaration", "Plain", "N"), ("var_declaration", "", "table"), ("type_declaration", "", "V"),
    ]
    assert [p.kind for p in cut(GO, "go")][:1] == ["preamble"] and GO[: cut(GO, "go")[0].end].endswith("package p")
    bodies = {p.name: GO[p.start : p.end] for p in cut(GO, "go")}
    assert bodies["X"].startswith("const (") and bodies["X"].endswith(")") and bodies["table"].endswith("2,\n}")


def test_rust():
    assert named(RUST, "rust") == [
        ("struct_item", "", "S"), ("function_item", "", "one"), ("impl_item", "", "fmt"), ("function_item", "<'a, T> fmt::Display for S<'a, T>", "fmt"),
        ("function_item", "<'a, T> fmt::Display for S<'a, T>", "other"), ("trait_item", "", "Empty"), ("macro_definition", "", "m"), ("function_item", "", "ext"),
        ("static_item", "", "Z"), ("enum_item", "", "E"), ("mod_item", "", "inner"),
    ]


def test_typescript():
    assert named(SCRIPT, "typescript") == [
        ("export_statement", "", "greet"), ("export_statement", "", "K"), ("abstract_class_declaration", "", "Base"),
        ("public_field_definition", "Base", "count"), ("public_field_definition", "Base", "re"), ("public_field_definition", "Base", "handler"),
        ("method_definition", "Base", "constructor"), ("method_signature", "Base", "area"), ("method_definition", "Base", "size"), ("method_definition", "Base", "gen"),
        ("lexical_declaration", "", "list"), ("lexical_declaration", "", "fn"), ("interface_declaration", "", "Shape"), ("type_alias_declaration", "", "Pair"),
        ("enum_declaration", "", "Colour"), ("enum_declaration", "", "Small"), ("internal_module", "", "N"),
        ("function_declaration", "", "over"), ("function_declaration", "", "over"), ("export_statement", "", "list"), ("export_statement", "", "from"),
    ]
    assert [p.label for p in cut(SCRIPT, "typescript") if p.kind == "statement"] == ["overloaded", "if"]


def test_javascript_regular_expressions_and_divisions():
    text = "const a = b / c / d;\nconst r = x.replace(/[}\"'`]/g, '');\nfunction f(i) { return i++ / 2 }\nfunction g() { return /}/.test(`${`}`}`) }\n"
    assert [n for _, _, n in named(text, "javascript")] == ["a", "r", "f", "g"]
    assert [text[s:e] for k, s, e in scan(text, "javascript") if k == "s"] == ["/[}\"'`]/g", "''", "/}/", "`${`}`}`"]


def test_c():
    assert named(C, "c") == [
        ("type_definition", "", "point"), ("type_definition", "", "size"), ("type_definition", "", "callback"), ("struct_specifier", "", "node"),
        ("enum_specifier", "", "colour"), ("function_definition", "", "name"), ("function_definition", "", "f"), ("function_definition", "", "main"),
        ("declaration", "", "make"), ("declaration", "", "table"), ("declaration", "", "counter"),
    ]


def test_python():
    assert named(PYTHON, "python") == [
        ("function_definition", "", "add"), ("decorated_definition", "", "Decorated"), ("class_definition", "", "Outer"), ("decorated_definition", "Outer", "value"),
        ("class_definition", "Outer", "Inner"), ("function_definition", "Outer.Inner", "deep"), ("function_definition", "Outer", "last"),
    ]
    found = keys(PYTHON, "python")
    assert "stmt::LIMIT:0" in found and "stmt:Outer:size:0" in found and "stmt::if __name__:0" in found and "note:stmt::LIMIT:0" in found
    assert any(k.startswith("doc:decl:function_definition::add") for k in found)


@pytest.mark.parametrize(("language", "text"), [("go", GO), ("rust", RUST), ("typescript", SCRIPT), ("c", C), ("python", PYTHON)])
def test_pieces_cover_whatever_is_left_of_a_text(language, text):
    """Cut short anywhere, with any character gone or doubled, the pieces are still the text."""
    rng = random.Random(9)
    for _ in range(250):
        i, j = sorted(rng.sample(range(len(text) + 1), 2))
        for changed in (text[:i], text[i:], text[:i] + text[j:], text[:i] + text[i : i + 1] + text[i:]):
            assert "".join(changed[p.start : p.end] for p in cut(changed, language)) == changed
            keys(changed, language)


@pytest.mark.parametrize(
    ("language", "text", "at", "added"),
    [
        ("go", GO, "var a, b", "const (\n\tQ = 1\n)\n\n"), ("go", GO, "// F does", "// doc\nfunc Ours() {}\n\n"), ("rust", RUST, "trait Empty", "fn ours() {}\n\n"),
        ("rust", RUST, "    #[inline]", "    fn ours() {}\n\n"), ("typescript", SCRIPT, "  constructor", "  ours() { return 1 }\n"), ("typescript", SCRIPT, "const list", "const ours = 2\n"),
        ("c", C, "unsigned long f", "int ours(void) { return 1; }\n\n"), ("python", PYTHON, "    # the inner", "    def ours(self):\n        pass\n\n"),
    ],
)
def test_an_addition_changes_no_other_key(language, text, at, added):
    i = text.index(at)
    before, after = Counter(keys(text, language)), Counter(keys(text[:i] + added + text[i:], language))
    assert not before - after and len(after - before) <= 2, (before - after, after - before)


def test_deep_nesting_and_long_texts_end():
    for text, language in (("(" * 20_000, "go"), ("`${" * 200, "typescript"), ("/*" * 5_000, "rust"), ("func F() {}\n" * 3_000, "go"), ("{[(" * 5_000, "c")):
        assert "".join(text[p.start : p.end] for p in cut(text, language)) == text


# merges -----------------------------------------------------------------------------------------


def build(language, functions, groups):
    """A file of functions, some within a class or an impl, with a group of constants."""
    if language == "go":
        head = "package p\n\nconst (\n" + "".join(f"\t{g} = {v}\n" for g, v in groups) + ")\n\n"
        return head + "\n\n".join(f"// {n} is one.\nfunc {n}() int {{\n\tuse({v})\n\treturn 1\n}}" for n, v in functions) + "\n"
    if language == "typescript":
        head = "const table = [\n" + "".join(f"  '{g}{v}',\n" for g, v in groups) + "];\n\nclass Holder {\n"
        return head + "\n\n".join(f"  /** {n} is one. */\n  {n}(): number {{\n    use({v})\n    return 1\n  }}" for n, v in functions) + "\n}\n"
    if language == "rust":
        head = "static TABLE: [&str; 1] = [\n" + "".join(f'    "{g}{v}",\n' for g, v in groups) + "];\n\nimpl Holder {\n"
        return head + "\n\n".join(f"    /// {n} is one.\n    pub fn {n}(&self) -> u8 {{\n        use_it({v});\n        1\n    }}" for n, v in functions) + "\n}\n"
    head = "TABLE = [\n" + "".join(f"    '{g}{v}',\n" for g, v in groups) + "]\n\n\nclass Holder:\n"
    return head + "\n\n".join(f"    # {n} is one.\n    def {n}(self):\n        use({v})\n        return 1" for n, v in functions) + "\n"


@pytest.fixture(scope="module")
def merged(spark):
    rng = random.Random(12)
    rows, wanted = [], {}
    for i in range(120):
        language = ("go", "typescript", "rust", "python")[i % 4]
        base = [(f"f{j}", 100 + j) for j in range(6)]
        groups = [("x", 1), ("y", 2), ("z", 3), ("u", 4), ("v", 5), ("w", 6)]
        sides, expected, gone, touched = [], dict(base), set(), set()
        for side in ("ours", "theirs"):
            own, own_groups = list(base), list(groups)
            for step in range(rng.randrange(1, 4)):
                j = rng.randrange(6)
                kind = rng.randrange(4)
                if f"f{j}" in touched:
                    continue
                at = next(k for k, (n, _) in enumerate(own) if n == f"f{j}")
                if kind == 0:
                    own[at] = (own[at][0], 900 + i)
                    expected[f"f{j}"] = 900 + i
                elif kind == 1:
                    own.pop(at)
                    gone.add(f"f{j}")
                else:
                    own.insert(at, (f"{side}{step}", 500 + step))
                    expected[f"{side}{step}"] = 500 + step
                    continue
                touched.add(f"f{j}")
            own_groups[1 if side == "ours" else 5] = (side, 7)
            sides.append(build(language, own, own_groups))
        rows.append((f"{i}", language, build(language, base, groups), *sides))
        wanted[f"{i}"] = (language, {k: v for k, v in expected.items() if k not in gone})
    files = spark.createDataFrame(rows, "path string, lang string, base string, ours string, theirs string")
    return wanted, {r.path: r for r in merge_files(files).collect()}, {r[0]: r for r in rows}


def test_disjoint_edits_meet_and_every_declaration_stands_once(merged):
    wanted, found, rows = merged
    clean = 0
    for path, (language, functions) in wanted.items():
        r = found[path]
        assert r.way == "entities"
        if r.conflicts:
            continue
        clean += 1
        names = Counter(p.name for p in cut(r.merged, language) if p.kind == "declaration")
        assert {n: 1 for n in functions} == {n: c for n, c in names.items() if n[:1] in "fot"  and n not in ("table", "TABLE", "ours", "theirs")}, (rows[path], r.merged)
        for name, value in functions.items():
            assert r.merged.count(f"({value})") >= 1 and r.merged.count(f"{name} is one.") == 1, (rows[path], r.merged)
        for side in ("ours", "theirs"):
            assert (f"\t{side} = 7\n" if language == "go" else f"'{side}7'" if language != "rust" else f'"{side}7"') in r.merged
    assert clean > 100


def test_grouped_constants_and_functions_around_them(spark):
    """The group that once swallowed the function behind it."""
    base = "package p\n\nconst (\n\tX = 1\n)\n\nfunc F() {\n\tf()\n}\n\nfunc G() {\n\tg()\n}\n"
    ours = base.replace("\tX = 1\n", "\tX = 1\n\tY = 2\n").replace("\nfunc G", "\nfunc Ours() {}\n\nfunc G")
    theirs = base.replace("\tf()\n", "\tf2()\n").replace("\nfunc G", "\nfunc Theirs() {}\n\nfunc G")
    files = spark.createDataFrame([("a.go", "go", base, ours, theirs)], "path string, lang string, base string, ours string, theirs string")
    r = merge_files(files).first()
    assert r.conflicts == 0 and Counter(n for _, _, n in named(r.merged, "go")) == Counter(["X", "F", "Ours", "Theirs", "G"])
    assert "\tX = 1\n\tY = 2\n" in r.merged and "\tf2()\n" in r.merged


def test_a_container_that_one_side_deleted_and_the_other_filled_is_a_conflict(spark):
    base = "class A {\n  m() { return 1 }\n}\n\nclass B {\n  n() { return 2 }\n}\n"
    ours = "class B {\n  n() { return 2 }\n}\n"
    theirs = base.replace("  m() { return 1 }\n", "  m() { return 1 }\n\n  k() { return 3 }\n")
    files = spark.createDataFrame(
        [("a.ts", "typescript", base, ours, theirs), ("b.ts", "typescript", base, ours, base)], "path string, lang string, base string, ours string, theirs string"
    )
    found = {r.path: r for r in merge_files(files).collect()}
    assert found["a.ts"].conflicts >= 1 and found["b.ts"].conflicts == 0 and "class A" not in found["b.ts"].merged
