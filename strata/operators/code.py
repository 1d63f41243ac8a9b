"""Code intelligence over extracted entities: exports, references, impact, comments, conflicts, diffs as text.

Entities are the rows of ``extract.extracted`` with the columns path and lang.
Names meet in equi-joins: a body is cut into the names it mentions, never tested
against each name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.extract import entities as cut_entities
from strata.functions.lines import with_edit_script
from strata.functions.scalars import display_name, is_exported, qualified_name
from strata.operators.tables import settled

# How an export's key begins, by declaration kind.
KEY_KINDS = {"function_declaration": "func", "method_declaration": "method", "type_declaration": "type", "var_declaration": "var", "const_declaration": "const"}


def package(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.when(path.contains("/"), F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)).otherwise("")


def exports(entities: DataFrame) -> DataFrame:
    """package, key, name, file of what a package exports: capital names of its files that are no tests."""
    kind = F.col("decl_kind")
    prefix = F.lit(None).cast("string")
    for decl, short in KEY_KINDS.items():
        prefix = F.when(kind == decl, short).otherwise(prefix)
    own = F.when(kind == "method_declaration", F.concat("receiver", F.lit("."), "name")).otherwise(F.col("name"))
    held = entities.filter((F.col("kind") == "declaration") & F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go") & is_exported(F.col("name")))
    rows = held.select(package(F.col("path")).alias("package"), F.concat(prefix, F.lit(":"), own).alias("key"), "name", F.col("path").alias("file"))
    # of equal keys in a package the file that comes last counts
    return rows.filter("key IS NOT NULL").groupBy("package", "key").agg(F.max("name").alias("name"), F.max("file").alias("file"))


#: What ``exports`` and ``references`` read of entities.
EXPORT_COLUMNS, REFERENCE_COLUMNS = ("kind", "decl_kind", "receiver", "name"), ("kind", "name", "start_line", "body")
REFERENCE_KINDS = ("import_block", "declaration")


def references(entities: DataFrame) -> DataFrame:
    """name, file, entity, line of every ``alias.Name`` in a declaration, the alias resolved by the file's imports.

    The entities are read once: imports and uses leave them as rows without bodies, which meet by file and alias.
    """
    def parsed(spec: Column) -> Column:
        target = F.regexp_extract(spec, r'"([^"]+)"', 1)
        alias = F.trim(F.regexp_replace(F.regexp_extract(spec, r'^\s*(?:import\s+)?(\w*)\s*"', 1), r"\s", ""))
        return _use(F.when(alias != "", alias).otherwise(F.substring_index(target, "/", -1)), target)

    def uses(line: Column, i: Column) -> Column:
        used = F.regexp_extract_all(line, F.lit(r"\b[A-Za-z_]\w*\.[A-Z]\w*"), F.lit(0))
        return F.transform(used, lambda x: _use(F.substring_index(x, ".", 1), None, F.substring_index(x, ".", -1), F.col("name"), F.col("start_line") + i))

    quoted = F.regexp_extract_all("body", F.lit(r'(?m)^\s*(?:import\s+)?(\w+\s+)?"([^"]+)"'), F.lit(0))
    found = F.when(F.col("kind") == "import_block", F.transform(quoted, parsed)).when(F.col("kind") == "declaration", F.flatten(F.transform(F.split("body", "\n"), uses)))
    rows = entities.select("path", F.explode(found).alias("x")).select("path", "x.*")
    use = F.when(F.col("target").isNull(), F.struct("name", "entity", "line"))
    met = rows.groupBy("path", "alias").agg(F.collect_list("target").alias("targets"), F.collect_list(use).alias("uses")).filter(F.size("targets") > 0)
    each = met.select("path", F.explode("targets").alias("target"), "uses").select("path", "target", F.explode("uses").alias("use"))
    return each.select(F.concat("target", F.lit("."), "use.name").alias("name"), F.col("path").alias("file"), "use.entity", "use.line")


def _use(alias: Column, target: Column | None, name: Column | None = None, entity: Column | None = None, line: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(
        alias.alias("alias"), text(target).alias("target"), text(name).alias("name"), text(entity).alias("entity"), (F.lit(None) if line is None else line).cast("int").alias("line")
    )


def impact(changes: DataFrame, exported: DataFrame, calls: DataFrame, module: Column) -> DataFrame:
    """key, caller of changes (key, name): call sites of exported entities of that name, as file:entity:line."""
    names = changes.join(exported.select("name", "package").distinct(), "name").select("key", qualified_name(module, F.col("package"), F.col("name")).alias("full"))
    found = names.distinct().join(calls, F.col("full") == calls["name"])
    return found.select("key", F.concat_ws(":", "file", "entity", F.col("line").cast("string")).alias("caller"))


def comment_lines(comments: DataFrame, entities: DataFrame) -> DataFrame:
    """comments (path, key, ...) with the entity's present start_line and end_line, null where it is gone."""
    first = entities.groupBy("path", "key").agg(F.min_by(F.struct("start_line", "end_line"), "pos").alias("at"))
    return comments.join(first, ["path", "key"], "left").select(*comments.columns, "at.start_line", "at.end_line")


def conflicts(files: DataFrame) -> DataFrame:
    """path, no, name, ours, theirs of each conflict block of marked texts (path, text)."""
    block = r"(?ms)^<<<<<<< ours[^\n]*\n.*?^>>>>>>> theirs[^\n]*"
    rows = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(block), F.lit(0))).alias("no", "b"))
    head = F.substring_index("b", "\n", 1)
    inner = F.regexp_extract("b", r"(?ms)^<<<<<<< ours[^\n]*\n(.*?)^>>>>>>> theirs", 1)
    name = F.regexp_extract(head, r" \((.*)\)", 1)
    return rows.select("path", "no", name.alias("name"), F.regexp_extract(inner, r"(?s)^(.*?)\n?=======\n", 1).alias("ours"), F.regexp_extract(inner, r"(?s)=======\n(.*?)\n?$", 1).alias("theirs"))


def resolved_text(text: Column, take: str) -> Column:
    """A marked text with every conflict replaced by its ``ours`` or ``theirs`` side."""
    side = "$1" if take == "ours" else "$2"
    return F.regexp_replace(text, r"(?ms)^<<<<<<< ours[^\n]*\n(.*?)^=======\n(.*?)^>>>>>>> theirs[^\n]*\n?", side)


def entity_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, key, name, change, before_body, after_body of declarations and imports that differ."""
    fields = F.struct("pos", "body", "body_hash", display_name(F.col("kind"), F.col("decl_kind"), F.col("receiver"), F.col("name"), F.col("key")).alias("name"))
    b, a = (df.filter("kind != 'interstitial'").groupBy("path", "key").agg(F.min(fields).alias(n)) for df, n in ((before, "b"), (after, "a")))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("modified")
    joined = b.join(a, ["path", "key"], "full_outer").filter(~F.col("b.body_hash").eqNullSafe(F.col("a.body_hash")))
    return joined.select("path", "key", F.coalesce("a.name", "b.name").alias("name"), change.alias("change"), F.col("b.body").alias("before_body"), F.col("a.body").alias("after_body"), F.coalesce("b.pos", "a.pos").alias("pos"))


_CHANGED = "path string, key string, change string, before_body string, after_body string, pos int, kind string, decl_kind string, receiver string, own string"


def file_changes(files: DataFrame, before: str, after: str) -> DataFrame:
    """``entity_changes`` of two versions that stand in one row (path, lang): each is cut once, and only what differs leaves Python.

    There is one row for each path; equal versions are not cut.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, lang, b, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b or "") != (a or ""):
                    out += _changed(path, _by_key(b, lang), _by_key(a, lang))
            columns = list(zip(*out, strict=True)) or [()] * 10
            kinds = [pa.int32() if i == 5 else pa.string() for i in range(10)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _CHANGED.split(", ")])

    found = files.select("path", "lang", before, after).mapInArrow(rows, _CHANGED)
    name = display_name(F.col("kind"), F.col("decl_kind"), F.col("receiver"), F.col("own"), F.col("key"))
    return found.select("path", "key", name.alias("name"), "change", "before_body", "after_body", "pos")


def _by_key(text: str | None, language: str) -> dict[str, dict]:
    """What stands between entities left out; the first of equal keys counts."""
    return {e["key"]: e for e in reversed(cut_entities(text or "", language)) if e["kind"] != "interstitial"}


def _changed(path: str, before: dict[str, dict], after: dict[str, dict]) -> Iterator[tuple]:
    for key in {**before, **after}:
        b, a = before.get(key), after.get(key)
        if b is None or a is None or b["body"] != a["body"]:
            named, first = a or b, b or a
            change = "added" if b is None else "removed" if a is None else "modified"
            yield path, key, change, b and b["body"], a and a["body"], first["pos"], named["kind"], named["decl_kind"], named["receiver"], named["name"]


def entity_diff_text(changes: DataFrame) -> DataFrame:
    """path, text: one line for each changed entity, as people read it."""
    mark = F.when(F.col("change") == "added", "+").when(F.col("change") == "removed", "-").otherwise("~")
    line = F.concat(F.lit("  "), mark, F.lit(" "), "name", F.lit("     ("), "change", F.lit(")\n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "key", line.alias("line"))))
    return changes.groupBy("path").agg(F.concat("path", F.lit(":\n"), F.array_join(ordered["line"], "")).alias("text"))


def line_diff_text(changes: DataFrame) -> DataFrame:
    """path, key, text: a unified listing of each changed entity; only modified ones meet the kernel."""
    def listed(body: Column, mark: str) -> Column:
        return F.array_join(F.transform(F.split(F.rtrim(body), "\n"), lambda x: F.concat(F.lit(mark), x, F.lit("\n"))), "")

    label = F.concat("path", F.lit("::"), "name", F.lit("\n"))
    changes = settled(changes)  # both branches read it
    plain = changes.filter("change != 'modified'").withColumn(
        "text",
        F.when(F.col("change") == "added", F.concat(F.lit("+++ b/"), label, listed(F.col("after_body"), "+"))).otherwise(
            F.concat(F.lit("--- a/"), label, listed(F.col("before_body"), "-"))
        ),
    )
    ops = with_edit_script(changes.filter("change = 'modified'"), "before_body", "after_body")
    text = F.array_join(F.transform("ops", lambda x: F.concat(F.translate(x["op"], "=", " "), x["line"], F.lit("\n"))), "")
    ops = ops.withColumn("text", F.concat(F.lit("--- a/"), label, F.lit("+++ b/"), label, text)).drop("ops")
    return plain.unionByName(ops).select("path", "key", "text")


def hunk_ranges(scripts: DataFrame, key: str, context: int = 3) -> DataFrame:
    """key, hunk, old_start, old_count, new_start, new_count of edit scripts in column ops (array of op, line).

    Changes whose contexts meet are one hunk; an empty side starts a line earlier.
    """
    def counted(op: str) -> Column:
        return F.col("op").isin("=", op).cast("long")

    rows = scripts.select(key, F.posexplode("ops").alias("i", "x")).select(key, "i", F.col("x.op").alias("op"))
    w = Window.partitionBy(key).orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("old", 1 + F.coalesce(F.sum(counted("-")).over(before), F.lit(0))).withColumn("new", 1 + F.coalesce(F.sum(counted("+")).over(before), F.lit(0)))
    last = F.last(F.when(F.col("op") != "=", F.col("i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(F.when(F.col("op") != "=", F.col("i")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = rows.withColumn("held", F.coalesce(F.col("i") - last <= context, F.lit(False)) | F.coalesce(following - F.col("i") <= context, F.lit(False))).filter("held")
    breaks = F.coalesce(F.col("i") - F.lag("i").over(w) > 1, F.lit(True)).cast("long")
    near = near.withColumn("starts", breaks).withColumn("hunk", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = near.groupBy(key, "hunk").agg(F.min("old").alias("o"), F.sum(counted("-")).alias("old_count"), F.min("new").alias("n"), F.sum(counted("+")).alias("new_count"))
    return found.select(key, "hunk", (F.col("o") - (F.col("old_count") == 0).cast("long")).alias("old_start"), "old_count", (F.col("n") - (F.col("new_count") == 0).cast("long")).alias("new_start"), "new_count")


def replaced(text: Column, pattern: str, replacement: str) -> tuple[Column, Column]:
    """A text with every match replaced, and the number of matches."""
    return F.regexp_replace(text, pattern, replacement), F.regexp_count(text, F.lit(pattern))


def applied_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, text with entity bodies replaced: edits (path, key, body) on files' entities; the rest stays byte for byte.

    ``files`` are entity rows; an edit whose key is not there changes nothing.
    """
    rows = files.join(edits.select("path", "key", F.col("body").alias("new_body")), ["path", "key"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new_body", "body").alias("body"))))
    return rows.groupBy("path").agg(F.array_join(ordered["body"], "").alias("text"))


def picked(files: DataFrame, name: str, into: str, source: str) -> DataFrame:
    """path, text: ``applied_edits`` of the entities of a name in one version (path, lang) to another in the same row; no bodies are moved.

    Texts without the name in the version that is picked from stay as they are; empty ones have no row.
    """
    def edited(text: str, other: str, language: str) -> str:
        if name not in other or text == other:
            return text
        new = {e["key"]: e["body"] for e in cut_entities(other, language) if e["name"] == name}
        return "".join(new.get(e["key"], e["body"]) for e in cut_entities(text, language))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, languages, texts, others = (c.to_pylist() for c in batch.columns)
            out = [(p, edited(t, o or "", lang)) for p, lang, t, o in zip(paths, languages, texts, others, strict=True) if t]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["path", "text"])

    return files.select("path", "lang", into, source).mapInArrow(rows, "path string, text string")
