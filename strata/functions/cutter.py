"""Source texts as bracket trees, and the pieces that their statements make.

A scanner that knows strings, templates inside templates, regular expressions,
character literals, raw strings, directives and comments gives the tokens of a text;
brackets of all three kinds are matched, so a token or a whole group is one step.  On
that tree the statements of Go, Rust, TypeScript, JavaScript and C are told apart;
Python has its own grammar.  A class, impl or trait with methods gives a header, its
members and what closes it, one below the other; an exported or decorated class is one
piece, as is anything else that nests.

Brackets that do not match end with the group around them; what no rule knows is a
statement, so the pieces always cover the text.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field
import re

# The grammars' names of what a keyword declares.
KINDS = {
    "go": {"func": "function_declaration", "type": "type_declaration", "var": "var_declaration", "const": "const_declaration"},
    "rust": {
        "fn": "function_item", "struct": "struct_item", "enum": "enum_item", "union": "union_item", "trait": "trait_item", "impl": "impl_item", "mod": "mod_item",
        "const": "const_item", "static": "static_item", "type": "type_item", "macro_rules": "macro_definition",
    },
    "typescript": {
        "function": "function_declaration", "class": "class_declaration", "interface": "interface_declaration", "type": "type_alias_declaration",
        "enum": "enum_declaration", "namespace": "internal_module", "module": "module", "const": "lexical_declaration", "let": "lexical_declaration",
        "var": "variable_declaration",
    },
    "c": {"struct": "struct_specifier", "enum": "enum_specifier", "union": "union_specifier", "typedef": "type_definition"},
}
KINDS["javascript"] = {k: KINDS["typescript"][k] for k in ("function", "class", "const", "let", "var")}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "get", "set", "override", "declare", "accessor"}
LANGUAGES = ("go", "rust", "typescript", "javascript", "c", "python")


@dataclass(slots=True)
class Piece:
    """A stretch of a text.  ``label`` names what has no name of its own: the head of a statement, the container that closes."""

    start: int
    end: int
    kind: str
    decl_kind: str = ""
    receiver: str = ""
    name: str = ""
    label: str = ""


# tokens -----------------------------------------------------------------------------------------

_WORD = r"(?P<w>(?:[^\W\d]|\$)[\w$]*|\d(?:[eE][+-]\d|[\w.])*)"
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)"
_SCANNERS = {
    "go": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>{_QUOTED}|`[^`]*(?:`|\Z)|'(?:\\.|[^'\\\n])*')|{_WORD}",
    "rust": (
        rf"(?P<c>{_LINE}|/\*)|(?P<s>b?r(?P<h>\#*)\".*?(?:\"(?P=h)|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)"
        rf"|b?'(?:\\(?:u\{{[^}}]*\}}|x[0-9a-fA-F]{{2}}|.)|[^'\\\n])'|'[^\W\d]\w*)|{_WORD}"
    ),
    "typescript": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))|(?P<t>`)|{_WORD}",
    "c": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<d>^[ \t]*\#(?:\\\n|/\*.*?(?:\*/|\Z)|[^\n])*)|(?P<s>{_QUOTED}|'(?:\\.|[^'\\\n])*')|{_WORD}",
}
_SCANNERS["javascript"] = _SCANNERS["typescript"]
_SCANNERS["python"] = (
    rf"(?P<c>\#[^\n]*)|(?P<s>[rRbBuUfF]{{0,2}}(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|{_QUOTED}|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)))|{_WORD}"
)
_COMPILED = {k: re.compile(rf"\s*(?:{v}|(?P<p>\S))", re.S | re.M) for k, v in _SCANNERS.items()}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "yield", "await"}
_NESTED = re.compile(r"/\*|\*/")
_IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
OPEN = {"(": ")", "[": "]", "{": "}"}


def can_scan(language: str) -> bool:
    return language in _COMPILED


def _nested_comment(text: str, at: int) -> int:
    depth = 1
    for m in _NESTED.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template(text: str, at: int, language: str) -> int:
    """The end of a template literal whose first back tick is before ``at``; what is inserted may hold templates again."""
    while (m := _IN_TEMPLATE.search(text, at)) is not None:
        if m.group() == "`":
            return m.end()
        at = m.end()
        if m.group() == "${":
            depth = 0
            for kind, start, end in scan(text, language, at):
                at = end
                if kind == "p" and text[start] in "{}":
                    depth += 1 if text[start] == "{" else -1
                    if depth < 0:
                        break
    return len(text)


def scan(text: str, language: str, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each token: w words and numbers, s literals, p marks, d directives, c comments."""
    tokens = _COMPILED[language]
    script = language in ("typescript", "javascript")
    last, last_text = "", ""
    while (m := tokens.match(text, at)) is not None:
        kind = m.lastgroup if m.lastgroup != "h" else "s"
        start, at = m.start(kind), m.end()
        if kind == "t":
            kind, at = "s", _template(text, at, language)
        elif kind == "c" and language == "rust" and text.startswith("/*", start):
            at = _nested_comment(text, at)
        elif kind == "p" and script and text[start] == "/" and (last in ("", "p") and last_text not in (")", "]", "}") or last_text in _BEFORE_REGEX):
            if (r := _REGEX.match(text, start)) is not None:
                kind, at = "s", r.end()
        yield kind, start, at
        if kind != "c":
            last, last_text = kind, text[start:at]


@dataclass
class Tree:
    """Significant tokens of a text; ``step[i]`` is the token behind i, or behind the whole group that i opens."""

    text: str
    language: str
    tokens: list[tuple[str, int, int]] = field(default_factory=list)
    step: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        text = self.text
        if self.language in ("go", "c", "python"):  # tokens by themselves: no token depends on the one before
            found = ((m, m.lastgroup) for m in _COMPILED[self.language].finditer(text))
            self.tokens = [(kind, m.start(kind), m.end()) for m, kind in found if kind != "c"]
        else:
            self.tokens = [t for t in scan(text, self.language) if t[0] != "c"]
        n = len(self.tokens)
        step, parent = list(range(1, n + 1)), [-1] * n
        self.step, self.parent = step, parent
        open_: list[int] = []
        marks: list[str] = []  # what would close them
        for i, (kind, start, _) in enumerate(self.tokens):
            if kind == "p":
                mark = text[start]
                if mark in ")]}":
                    if mark in marks:
                        while marks.pop() != mark:
                            step[open_.pop()] = i  # never closed: ends with the group around it
                        step[open_.pop()] = i + 1
                elif mark in OPEN:
                    if open_:
                        parent[i] = open_[-1]
                    open_.append(i)
                    marks.append(OPEN[mark])
                    continue
            if open_:
                parent[i] = open_[-1]
        for o in open_:
            step[o] = n

    def at(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]] if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def start(self, i: int) -> int:
        return self.tokens[i][1]

    def end(self, i: int) -> int:
        return self.tokens[i - 1][2]

    def new_line(self, i: int) -> bool:
        return "\n" in self.text[self.end(i) : self.start(i)] if i else True

    def first_word(self, i: int, j: int) -> str:
        return next((self.at(k) for k in range(i, j) if self.kind(k) == "w"), "")

    def header(self, i: int, j: int) -> str:
        return " ".join(self.text[self.start(i) : self.end(j)].split()) if j > i else ""

    def find(self, i: int, j: int, marks: str) -> int:
        """The first token from i on, groups skipped, that is one of the marks; j without one."""
        while i < j and not (self.kind(i) == "p" and self.at(i) in marks):
            i = self.step[i]
        return min(i, j)

    def body(self, i: int, j: int) -> int:
        """Behind the next braces or semicolon."""
        k = self.find(i, j, "{;")
        return min(self.step[k], j) if k < j else j


def _label(tree: Tree, i: int, j: int) -> str:
    """What tells a statement from others: its words up to the first mark of assignment, call or body."""
    k = i
    while k < j and not (k > i and tree.at(k) in ("=", "(", "{", "[", ":", ";", ",")) and not (k > i and tree.new_line(k)):
        k += 1
    return tree.header(i, k)


def _statement(tree: Tree, i: int, j: int, owner: str) -> Piece:
    return Piece(tree.start(i), tree.end(j), "statement", "", owner, "", _label(tree, i, j))


def _container(tree: Tree, i: int, body: int, end: int, piece: Piece, members: list[Piece], path: str) -> list[Piece]:
    """Header, members and closing of a container whose braces begin at token ``body``; one piece if no member is a declaration."""
    if not any(m.kind == "declaration" for m in members) or tree.at(tree.step[body] - 1) != "}":
        return [piece]
    last = tree.step[body] - 1
    head = Piece(piece.start, tree.end(body + 1), "declaration", piece.decl_kind, piece.receiver, piece.name)
    return [head, *members, Piece(tree.start(last), piece.end, "closing", "", piece.receiver, "", path)]


# languages --------------------------------------------------------------------------------------

# Plain statements of Go as whole matches: all brackets of a body that nest no deeper than two, no literal, no comment, and a line end behind.
_X = r"[^{}()\[\]\"'`/]*+"
_FLAT = rf"{_X}(?:\({_X}\){_X}|\[{_X}\]{_X}|\{{{_X}(?:\({_X}\){_X})*+\}}{_X})*+"
_IN_LINE = r"[^{}()\[\]\"'`/;\n]*+"
_GO_NAME = r"(?:[^\W\d]|\$)[\w$]*+"
_GO_PLAIN = re.compile(
    rf"(?:func[ \t]+(?P<func>{_GO_NAME})[ \t]*\({_IN_LINE}\){_IN_LINE}(?:\({_IN_LINE}\))?[ \t]*\{{{_FLAT}\}}"
    rf"|type[ \t]+(?P<type>{_GO_NAME})[ \t]+(?:struct|interface)[ \t]*\{{{_FLAT}\}}"
    rf"|(?P<package>package)[ \t]+{_GO_NAME}"
    rf"|(?P<import>import)[ \t]*(?:\((?:[^()\"'`/]++|\"[^\"\\\n]*+\")*+\)|\"[^\"\\\n]*+\"))[ \t]*(?=\n|\Z)"
)
_GO_GAP = re.compile(rf"(?:\s++|{_LINE}|{_BLOCK})*+", re.S)


def _go_plain(text: str) -> list[Piece] | None:
    """``_go`` of a text that consists of plain statements; None for any other, which takes the tree."""
    out: list[Piece] = []
    at = _GO_GAP.match(text).end()
    while at < len(text):
        m = _GO_PLAIN.match(text, at)
        if m is None:
            return None
        end = m.end()
        while text[end - 1] in " \t":
            end -= 1
        kind = m.lastgroup
        if kind == "package":
            if out:
                return None
            out.append(Piece(0, end, "preamble"))
        elif kind == "import":
            out.append(Piece(at, end, "import_block"))
        else:
            out.append(Piece(at, end, "declaration", KINDS["go"][kind], "", m[kind]))
        at = _GO_GAP.match(text, end).end()
    return out


def _go(tree: Tree) -> list[Piece]:
    out: list[Piece] = []
    i, n = 0, len(tree.tokens)
    while i < n:
        j = tree.step[i]
        # a line ends a statement behind a word, a literal or a closing bracket
        while j < n and tree.at(j) != ";" and not (tree.new_line(j) and (tree.kind(j - 1) != "p" or tree.at(j - 1) in ")]}")):
            j = tree.step[j]
        word, start, end = tree.at(i), tree.start(i), tree.end(j)
        if word == "package" and not out:
            out.append(Piece(0, end, "preamble"))
        elif word == "import":
            out.append(Piece(start, end, "import_block"))
        elif word == "func" and tree.at(i + 1) == "(":
            name = tree.step[i + 1]
            words = [k for k in range(i + 2, tree.find(i + 2, name, "[")) if tree.kind(k) == "w"]
            receiver = tree.at(words[-1]) if words else ""
            out.append(Piece(start, end, "declaration", "method_declaration" if receiver else KINDS["go"][word], receiver, tree.at(name) if tree.kind(name) == "w" else ""))
        elif word in KINDS["go"]:
            out.append(Piece(start, end, "declaration", KINDS["go"][word], "", tree.first_word(i + 1, j)))
        else:
            out.append(_statement(tree, i, j, ""))
        i = j + (tree.at(j) == ";")
        out[-1].end = max(out[-1].end, tree.end(i))
    return out


def _rust(tree: Tree, i: int, n: int, owner: str = "") -> list[Piece]:
    out: list[Piece] = []
    while i < n:
        while i < n and tree.at(i) == "#":  # attributes stand before what they belong to
            i = tree.step[i + 1 + (tree.at(i + 1) == "!")] if i + 1 < n else n
        if i >= n:
            break
        k = i
        while k < n and (tree.at(k) in ("pub", "async", "unsafe", "default", "extern") or tree.kind(k) == "s" or (tree.at(k) == "(" and tree.at(k - 1) == "pub")):
            k = tree.step[k]
        if tree.at(k) == "const" and tree.at(k + 1) in ("fn", "unsafe", "async", "extern"):
            k = next(x for x in range(k, n + 1) if x == n or tree.at(x) == "fn")
        word, name = tree.at(k), k + 1
        if word == "use" or (word == "crate" and tree.at(k - 1) == "extern"):
            j = min(n, tree.find(i, n, ";") + 1)
            out.append(Piece(tree.start(i), tree.end(j), "import_block"))
        elif word in KINDS["rust"] and not (word == "union" and tree.kind(name) != "w"):
            j = min(n, tree.find(k, n, ";") + 1) if word in ("const", "static", "type") else tree.body(k, n)
            if tree.at(name) in ("!", "mut"):
                name += 1
            while tree.at(name) == "<" or (word == "impl" and tree.kind(name) not in ("w", "") and name < j):
                depth = 0
                for name in range(name, j):  # parameters of an impl
                    depth += {"<": 1, ">": -1 if tree.at(name - 1) != "-" else 0}.get(tree.at(name), 0)
                    if depth <= 0:
                        break
                name += 1
            piece = Piece(tree.start(i), tree.end(j), "declaration", KINDS["rust"][word], owner, tree.at(name) if tree.kind(name) == "w" else "")
            body = tree.find(k, j, "{")
            if word in ("impl", "trait") and body < j:
                path = tree.header(k + 1, body)
                path = f"{owner}.{path}" if owner else path
                out += _container(tree, i, body, j, piece, _rust(tree, body + 1, tree.step[body] - 1, path), path)
            else:
                out.append(piece)
        else:
            j = tree.body(i, n)
            out.append(_statement(tree, i, j, owner))
        i = j
    return out


#: A line that ends or begins with one of these goes on.
_GOES_ON, _CONTINUES = set("=+-*/%&|^<>?:,.!~@"), set("=+-*/%&|^<>?:,.)]([`")
_WORDS_ON = {"in", "of", "instanceof", "extends", "implements", "as", "from", "new", "typeof", "default", "export", "satisfies"}


def _script_end(tree: Tree, i: int, n: int) -> int:
    """The end of a script statement: a semicolon, or a line that the next one does not go on with."""
    j = tree.step[i]
    while j < n and tree.at(j) != ";":
        last, here = tree.at(j - 1), tree.at(j)
        twice = last in ("+", "-") and tree.at(j - 2) == last
        on = (tree.kind(j - 1) == "p" and last in _GOES_ON and not twice) or last in _WORDS_ON or here in _WORDS_ON - {"new", "typeof", "export", "default", "from"}
        on = on or here[:1] in _CONTINUES and not (here in ("+", "-") and tree.at(j + 1) == here) and here != "@"
        if tree.new_line(j) and not on:
            return j
        j = tree.step[j]
    return min(n, j + 1)


def _script_body(tree: Tree, i: int, n: int) -> int:
    """Behind the body of a function whose parameters begin at or behind i; braces of a result type are passed over."""
    k = tree.find(i, n, "({;")
    k = tree.step[k] if tree.at(k) == "(" else k
    typed = tree.at(k) == ":"
    while k < n:
        if tree.at(k) == ";":
            return k + 1
        if tree.at(k) == "{":
            after = tree.step[k]
            if not (typed and (tree.at(after) in ("{", "|", "&", "[", "=") or tree.at(k - 1) in (":", "|", "&", "<", ",", "="))):
                return after
            k = after
        elif tree.new_line(k) and not (tree.kind(k - 1) == "p" and tree.at(k - 1) in _GOES_ON) and tree.at(k)[:1] not in _CONTINUES:
            return k  # a signature without a body
        else:
            k = tree.step[k]
    return n


def _control_end(tree: Tree, i: int, n: int) -> int:
    k = i
    while k < n:
        here = tree.at(k)
        k = tree.step[k]
        if here in ("{", ";") and not (tree.at(k) in ("else", "catch", "finally") or (tree.at(i) == "do" and tree.at(k) == "while")):
            break
    return k


def _members(tree: Tree, i: int, n: int, owner: str) -> list[Piece]:
    """Methods and fields of a class body."""
    out: list[Piece] = []
    while i < n:
        if tree.at(i) == ";":
            i += 1
            continue
        k = i
        while k < n and tree.at(k) == "@":  # decorators
            k = tree.step[k + 1]
            while tree.at(k) in (".", "("):
                k = tree.step[k] + (tree.at(k) == ".")
        while k < n and (tree.at(k) == "*" or (tree.at(k) in MODIFIERS and tree.at(k + 1) not in ("(", "=", ";", ":", "?", "!", "<") and not tree.new_line(k + 1))):
            k += 1
        if tree.at(k) == "{":  # static block
            out.append(_statement(tree, i, tree.step[k], owner))
            i = tree.step[k]
            continue
        name = k + (tree.at(k) == "#")
        after = tree.step[name] if name < n else n
        after += tree.at(after) in ("?", "!")
        if tree.at(after) in ("(", "<"):
            j = min(n, _script_body(tree, after, n))
            has_body = tree.at(j - 1) == "}"
            kind = "method_definition" if has_body else "method_signature"
        else:
            j = _script_end(tree, name, n) if name < n else n
            kind = "public_field_definition" if tree.language == "typescript" else "field_definition"
        label = tree.header(k, after if after > k else k + 1).rstrip("?!")
        out.append(Piece(tree.start(i), tree.end(j), "declaration", kind, owner, label))
        i = max(j, i + 1)
    return out


def _script(tree: Tree) -> list[Piece]:
    kinds, n, out, i = KINDS[tree.language], len(tree.tokens), [], 0
    while i < n:
        k = i
        while k < n and tree.at(k) == "@":
            k = tree.step[k + 1]
            while tree.at(k) in (".", "("):
                k = tree.step[k] + (tree.at(k) == ".")
        exported = tree.at(k) == "export"
        while tree.at(k) in ("export", "default", "declare", "abstract", "async") and tree.kind(k + 1) in ("w", "s") or (tree.at(k) == "const" and tree.at(k + 1) == "enum"):
            k += 1
        word = tree.at(k)
        named = tree.kind(k + 1) in ("w", "s") or tree.at(k + 1) in ("{", "[", "*") or (word in ("function", "class") and exported)
        if word == "import" and tree.at(k + 1) not in ("(", "."):
            j = _script_end(tree, i, n)
            out.append(Piece(tree.start(i), tree.end(j), "import_block"))
        elif word in kinds and named and not (word in ("type", "namespace", "module", "let") and tree.kind(k + 1) not in ("w", "s") and tree.at(k + 1) not in ("{", "[")):
            if word == "function":
                j = _script_body(tree, k + 1, n)
            elif word in ("class", "interface", "enum", "namespace", "module"):
                j = tree.body(k, n)
            else:
                j = _script_end(tree, k, n)
            name = tree.at(k + 1).strip("'\"") if tree.kind(k + 1) in ("w", "s") and tree.at(k + 1) not in ("extends", "implements") else tree.first_word(k + 1, j)
            if tree.at(j) == ";" and not tree.new_line(j):
                j += 1
            abstract = word == "class" and tree.at(k - 1) == "abstract"
            kind = "export_statement" if exported else "abstract_class_declaration" if abstract else kinds[word]
            piece = Piece(tree.start(i), tree.end(j), "declaration", kind, "", name)
            body = tree.find(k, j, "{")
            if kind.endswith("class_declaration") and body < j:
                out += _container(tree, i, body, j, piece, _members(tree, body + 1, tree.step[body] - 1, name), name)
            else:
                out.append(piece)
        elif exported:
            j = _script_end(tree, i, n)
            out.append(Piece(tree.start(i), tree.end(j), "declaration", "export_statement", "", tree.first_word(k + (word == "export"), j)))
        else:
            control = word in ("if", "for", "while", "do", "try", "switch", "with") or word == "{"
            j = _control_end(tree, i, n) if control else _script_end(tree, i, n)
            out.append(_statement(tree, i, j, ""))
        i = j
    return out


def _c(tree: Tree) -> list[Piece]:
    out: list[Piece] = []
    i, n = 0, len(tree.tokens)
    while i < n:
        start = tree.start(i)
        if tree.kind(i) == "d":
            words = tree.at(i).split()
            if re.match(r"\s*#\s*include\b", tree.at(i)):
                out.append(Piece(start, tree.end(i + 1), "import_block"))
            else:
                out.append(Piece(start, tree.end(i + 1), "statement", label=re.split(r"[(]", " ".join(words[:2]))[0]))
            i += 1
            continue
        j, call, assigned, body = i, -1, False, False
        while j < n and tree.at(j) != ";" and tree.kind(j) != "d":
            here = tree.at(j)
            if here == "=":
                assigned = True
            elif here == "(" and call < 0 and not assigned and tree.at(j - 1) not in ("__attribute__", "__declspec", "_Alignas"):
                call = j
            elif here == "{" and not assigned:
                if call >= 0 or tree.kind(j - 1) == "s":  # of a function, or of a linkage
                    j, body = tree.step[j], True
                    break
            j = tree.step[j]
        semicolon = j < n and not body and tree.at(j) == ";"
        j += semicolon
        first = next((k for k in range(i, j) if tree.at(k) not in ("static", "const", "extern", "inline", "volatile", "register")), i)
        word, braces = tree.at(first), tree.find(first, j, "{")
        if call >= 0:
            pointer = tree.at(call + 1) == "*" and tree.step[call] < j and tree.at(tree.step[call]) in ("(", "[", ";", "=")
            name = tree.first_word(call + 2, tree.step[call]) if pointer else tree.at(call - 1)
        else:
            stop = tree.find(first, j, "=,")
            stop = stop if stop < j else j - semicolon
            words = [k for k in _top(tree, first, stop) if tree.kind(k) == "w"]
            name = tree.at(words[-1]) if words else ""
        if not name.isidentifier():
            out.append(_statement(tree, i, j, ""))
        elif word == "typedef":
            out.append(Piece(start, tree.end(j), "declaration", "type_definition", "", name))
        elif word in KINDS["c"] and call < 0 and braces < j and tree.step[braces] >= j - semicolon:
            out.append(Piece(start, tree.end(j), "declaration", KINDS["c"][word], "", tree.at(first + 1) if tree.kind(first + 1) == "w" else ""))
        else:
            out.append(Piece(start, tree.end(j), "declaration", "function_definition" if body else "declaration", "", name))
        i = max(j, i + 1)
    return out


def _top(tree: Tree, i: int, j: int) -> Iterator[int]:
    while i < j:
        yield i
        i = tree.step[i]


def _python(text: str) -> list[Piece]:
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = text.splitlines(keepends=True) if not re.search("[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text) else re.findall(r"[^\n]*\n|[^\n]+", text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))

    def at(line: int, column: int) -> int:
        own = lines[line - 1]
        return starts[line - 1] + (column if own.isascii() else len(own.encode()[:column].decode()))

    def cut(body: list[ast.stmt], owner: str) -> list[Piece]:
        found: list[Piece] = []
        for node in body:
            marked = getattr(node, "decorator_list", [])
            begin, end = at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)
            if marked:
                line = min(d.lineno for d in marked)
                begin = starts[line - 1] + len(lines[line - 1]) - len(lines[line - 1].lstrip())
            if isinstance(node, (ast.Import, ast.ImportFrom)) and not owner:
                found.append(Piece(begin, end, "import_block"))
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
                kind = "decorated_definition" if marked else kind
                path = f"{owner}.{node.name}" if owner else node.name
                members = cut(node.body, path) if kind == "class_definition" else []
                if any(m.kind == "declaration" for m in members):
                    found.append(Piece(begin, _colon(text, begin) + 1, "declaration", kind, owner, node.name))
                    found += members
                else:
                    found.append(Piece(begin, end, "declaration", kind, owner, node.name))
            else:
                head = re.match(r"[^=({:\[\n]*", text[begin:end])
                found.append(Piece(begin, end, "statement", "", owner, "", " ".join((head.group() if head else "").split())))
        return found

    return cut(body, "")


_PYTHON_SKIP = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*|[()\[\]{}:]")


def _colon(text: str, at: int) -> int:
    """The colon that ends the header of a class."""
    depth = 0
    for m in _PYTHON_SKIP.finditer(text, at):
        c = m.group()
        depth += (c in "([{") - (c in ")]}") if len(c) == 1 else 0
        if c == ":" and not depth:
            return m.start()
    return at


_BLANK = re.compile(r"\n[ \t]*\n")


def _between(text: str, begin: int, end: int, first: bool, after: Piece | None) -> list[Piece]:
    """The pieces of a gap: a note on the line of what is before, white space, comments that stand alone, those that document what follows."""
    gap = text[begin:end]
    if not gap.strip():
        return [Piece(begin, end, "interstitial")] if gap else []
    out: list[Piece] = []
    line = gap.find("\n") if "\n" in gap else len(gap)
    if not first and gap[:line].strip():
        out.append(Piece(begin, begin + line, "interstitial", label="note"))
        begin, gap = begin + line, gap[line:]
    lead = len(gap) - len(gap.lstrip())
    core = gap.rstrip()
    doc = len(gap)
    if core.strip() and after is not None and after.kind != "closing" and gap[len(core) :].count("\n") <= 1:
        doc = max([lead, *(m.end() for m in _BLANK.finditer(core))])
        doc += len(gap[doc:]) - len(gap[doc:].lstrip())
    if first and (top := gap[:doc].rstrip()):
        out.append(Piece(begin, begin + len(top), "preamble"))
        if doc > len(top):
            out.append(Piece(begin + len(top), begin + doc, "interstitial"))
    else:
        if lead:
            out.append(Piece(begin, begin + min(lead, doc), "interstitial"))
        if doc > lead and gap[lead:doc].strip():
            out.append(Piece(begin + lead, begin + doc, "interstitial", label="comment"))
    if doc < len(gap):
        out.append(Piece(begin + doc, begin + len(gap), "interstitial", label="doc"))
    return out


def cut(text: str, language: str) -> list[Piece]:
    """All pieces of a text in order; together they are the text.  An empty text has none, one without grammar is one piece."""
    if not text:
        return []
    if language == "python":
        found = _python(text)
    elif language == "go" and (plain := _go_plain(text)) is not None:
        found = plain
    elif language in _COMPILED:
        tree = Tree(text, language)
        found = {"go": _go, "c": _c}.get(language, _script)(tree) if language != "rust" else _rust(tree, 0, len(tree.tokens))
    else:
        found = []
    if not any(p.kind in ("declaration", "import_block") for p in found):
        return [Piece(0, len(text), "interstitial")]
    out: list[Piece] = []
    at = 0
    for p in found:
        if p.kind == "import_block" and out and out[-1].kind == "import_block" and not text[out[-1].end : p.start].strip():
            out[-1].end = at = p.end
            continue
        if at < p.start:
            if text[at : p.start].isspace():
                out.append(Piece(at, p.start, "interstitial"))
            else:
                out += _between(text, at, p.start, not out, p)
        out.append(p)
        at = p.end
    return out + _between(text, at, len(text), False, None)
