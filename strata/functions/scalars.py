"""Names, kinds, globs, protocol strings and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions.text import stripped

# Declaration kinds of the grammars and their short names.
SHORT_KINDS = {
    "func": ("function_declaration", "function_definition", "function_item", "method_declaration"),
    "type": ("type_declaration", "type_spec"),
    "class": ("class_definition", "class_declaration"),
    "struct": ("struct_item",),
    "enum": ("enum_item",),
    "trait": ("trait_item",),
    "impl": ("impl_item",),
    "interface": ("interface_declaration",),
    "var": ("var_declaration",),
    "const": ("const_declaration",),
}
# What a search for a kind means.
KIND_FILTERS = {
    "function": ("function_declaration", "function_definition", "function_item"),
    "func": ("function_declaration", "function_definition", "function_item"),
    "type": ("type_declaration", "type_spec"),
    "method": ("method_declaration", "method_definition"),
    "var": ("var_declaration",),
    "const": ("const_declaration",),
    "class": ("class_declaration", "class_definition"),
    "struct": ("struct_item", "struct_declaration"),
    "interface": ("interface_declaration",),
}
# Formats that hold data and no declarations.
DATA_FORMATS = ("json", "json5", "yaml", "toml", "ini", "csv")
DATA_FORMAT_BYTES = 256 * 1024
BINARY_HEAD = 8192


def short_kind(decl_kind: Column) -> Column:
    found = decl_kind
    for short, kinds in SHORT_KINDS.items():
        found = F.when(decl_kind.isin(*kinds), short).otherwise(found)
    return found


def display_name(kind: Column, decl_kind: Column, receiver: Column, name: Column, identity: Column) -> Column:
    """``func (Recv) Name`` for declarations, the identity key for all else."""
    owner = F.when(F.coalesce(receiver, F.lit("")) != "", F.concat(F.lit(" ("), receiver, F.lit(")"))).otherwise("")
    return F.when(kind == "declaration", F.concat(short_kind(decl_kind), owner, F.lit(" "), name)).otherwise(identity)


def is_kind(decl_kind: Column, wanted: Column) -> Column:
    """Whether a declaration is of a searched kind; a kind without a meaning of its own is looked for inside the name."""
    low = F.lower(wanted)
    found = F.lower(decl_kind).contains(low)
    for name, kinds in KIND_FILTERS.items():
        found = F.when(low == name, decl_kind.isin(*kinds)).otherwise(found)
    return found


def is_data_format(language: Column) -> Column:
    return F.coalesce(language.isin(*DATA_FORMATS), F.lit(False))


def skips_extraction(language: Column, size: Column, forced: Column) -> Column:
    return is_data_format(language) & ~forced & (size > DATA_FORMAT_BYTES)


def is_binary(content: Column, head: int | None = None) -> Column:
    """Whether the bytes (or their first ``head``) hold a NUL."""
    data = F.col("content") if content is None else content
    data = data.cast("binary")
    data = data if head is None else F.substring(data, 1, head)
    return F.contains(data, F.lit(b"\0"))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def short_hash(hash_: Column) -> Column:
    return F.left(hash_, F.lit(8))


def author(name: Column, email: Column) -> Column:
    name, email = stripped(name), stripped(email)
    return F.when(name == "", "").when(email == "", name).otherwise(F.concat(name, F.lit(" <"), email, F.lit(">")))


def zone_offset(seconds: Column) -> Column:
    """+hhmm of an offset in seconds."""
    size = F.abs(seconds)
    return F.concat(
        F.when(seconds < 0, "-").otherwise("+"), F.lpad(F.floor(size / 3600).cast("string"), 2, "0"),
        F.lpad(F.floor(size % 3600 / 60).cast("string"), 2, "0"),
    )


def conflict_annotation(line: Column) -> Column:
    """What stands in parentheses on a conflict marker; empty without any."""
    return F.regexp_extract(line, r"(?s)^.*? \((.*)\)", 1)


def grep_pattern(raw: Column) -> tuple[Column, Column]:
    """The language (lower case, or empty) and the pattern of ``lang::pattern``."""
    at = F.locate("::", raw)
    found = (at > 1) & ~F.substring(raw, F.lit(1), at - 1).rlike(r"[ \t/\\]")
    language = F.when(found, F.lower(F.substring(raw, F.lit(1), at - 1))).otherwise("")
    return language, F.when(found, F.substring(raw, at + 2, F.length(raw))).otherwise(raw)


def glob(pattern: str) -> str:
    """A name glob as an anchored regular expression: * any run, ? one character, [..] a class; none crosses a slash."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2)
        if c == "[" and end > 0:
            out.append(pattern[i : end + 1])
            i = end
        else:
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c == "_" else "\\" + c)
        i += 1
    return "^" + "".join(out) + "$"


def owner_entity(pattern: str, key: Column) -> Column:
    """``kind:glob`` against ``kind:name``; kinds are equal, names match."""
    kind, colon, name = pattern.partition(":")
    at = F.locate(":", key)
    matched = (F.substring(key, F.lit(1), at - 1) == kind) & F.substring(key, at + 1, F.length(key)).rlike(glob(name))
    return F.lit(bool(colon)) & (at > 0) & matched


def config_entity(pattern: str, key: Column) -> Column:
    """Part by part at the colons, each with * and ?; a last part that is * alone matches all that follow."""
    parts = pattern.split(":")
    rest = parts[-1] == "*"
    fixed = parts[:-1] if rest else parts
    inner = [glob(p)[1:-1].replace("[^/]", "[^:]") for p in fixed]
    if rest:  # the fixed parts, then anything or nothing
        return key.rlike("^" + ":".join(inner) + "(:.*)?$" if inner else "^")
    return key.rlike("^" + ":".join(inner) + "$")


def reflog_entity(pattern: str, key: Column) -> Column:
    """``kind:glob``, or a glob of the whole key where the pattern has no colon."""
    return owner_entity(pattern, key) if ":" in pattern else key.rlike(glob(pattern))


def allowed_selector(selector: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in filter(None, (x.strip() for x in patterns)):
        found = found | ((selector == p) | selector.startswith(p[:-1]) if p.endswith("*") else selector == p)
    return found


def is_exported(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def capabilities(raw: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: stripped(x)), lambda x: x != "")))


def limit(raw: Column, key: str) -> Column:
    """A positive number of ``key=number`` in a comma list, the last one; 0 without any."""
    parts = F.transform(F.split(raw, ","), lambda x: stripped(x))
    own = F.filter(parts, lambda x: x.rlike(rf"^{key}\s*=\s*\+?0*[1-9][0-9]*$"))
    return F.coalesce(F.try_to_number(F.regexp_extract(F.element_at(F.concat(F.array(F.lit("")), own), -1), r"([0-9]+)$", 1), F.lit("9" * 18)).cast("long"), F.lit(0))


def object_filter(spec: Column) -> Column:
    """struct<type, blob_limit, tree_depth> of a filter, null for one that is not valid."""
    s = stripped(spec)
    number = F.regexp_extract(s, r"^(?:blob:limit=|tree:)\+?([0-9]+)$", 1).cast("long")
    none = F.lit(0).cast("long")

    def kind(name: str, blob: Column, depth: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), blob.alias("blob_limit"), depth.alias("tree_depth"))

    return (
        F.when(s == "blob:none", kind("blob:none", none, none))
        .when(s.rlike(r"^blob:limit=\+?[0-9]+$"), kind("blob:limit", number, none))
        .when(s.rlike(r"^tree:\+?[0-9]+$"), kind("tree", none, number))
    )


def allows_blob(filter_: Column, size: Column) -> Column:
    return F.when(filter_["type"] == "blob:none", False).when(filter_["type"] == "blob:limit", size < filter_["blob_limit"]).otherwise(True)


def qualified_name(module: Column, package: Column, name: Column) -> Column:
    """module/package.name without the parts that are empty."""
    path = F.array_join(F.filter(F.array(module, package), lambda x: x != ""), "/")
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def entity_changes(data: Column) -> Column:
    """array<struct<path, entity, change>> of ``path:key:change`` items; the key may hold colons, paths are escaped."""
    items = F.filter(F.transform(F.split(data, ","), lambda x: stripped(x)), lambda x: x.rlike("^[^:]*:.*:"))

    def parsed(x: Column) -> Column:
        path = F.substring_index(x, ":", 1)
        for code, char in (("%3A", ":"), ("%2C", ","), ("%25", "%")):
            path = F.replace(path, F.lit(code), F.lit(char))
        middle = F.substring(x, F.locate(":", x) + 1, F.length(x))
        change = F.substring_index(x, ":", -1)
        key = F.left(middle, F.length(middle) - F.length(change) - 1)
        return F.struct(path.alias("path"), key.alias("entity"), change.alias("change"))

    return F.transform(items, parsed)


# The phase of each type of trace event.
PHASES = {
    "authorization": ("spawn_preflight_allowed", "spawn_preflight_advisory", "spawn_preflight_blocked", "spawn_authorized"),
    "activation": ("spawn_consumed", "spawn_attached", "spawn_heartbeat", "spawn_started"),
    "execution": (
        "action_preflight_allowed", "action_preflight_advisory", "action_preflight_blocked", "action_exec_started", "action_exec_finished",
    ),
    "completion": ("spawn_finished",),
}


def phase(event_type: Column) -> Column:
    found = F.lit("other")
    for name, types in PHASES.items():
        found = F.when(event_type.isin(*types), name).otherwise(found)
    return found
