"""Trees, entities, entity lists and tags: their canonical texts, read and written, and what objects refer to.

Objects come as the table of ``records`` (hash, type, size, data).  Parsers keep
the hash, so that a damaged object can be found again, and skip header lines of
unknown name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import stripped
from strata.sources.records import parse_commits

VERSION = "version 1"
MODES = {"dir": "40000", "file": "100644"}  # fixed values: the names that older trees use


def _text(objects: DataFrame, kind: str) -> DataFrame:
    t = F.col("data").cast("string").alias("t")
    return objects.filter(F.col("type") == kind).select("hash", t)


def _cut(text: Column) -> tuple[Column, Column]:
    """Header lines and body, at the first empty line."""
    at = F.locate("\n\n", text)
    return F.split(F.substring(text, F.lit(1), at - 1), "\n"), F.substring(text, at + 2, F.length(text))


def _value(head: Column, name: str) -> Column:
    own = F.get(F.filter(head, lambda x: x.startswith(name + " ")), F.lit(0))
    return F.coalesce(F.substring(own, F.lit(len(name) + 2), F.length(own)), F.lit(""))


def parse_trees(objects: DataFrame) -> DataFrame:
    """hash, name, mode, is_dir, blob, entities, subtree of each tree entry; a hash that is absent is null."""
    lines = _text(objects, "tree").select("hash", F.explode(F.split("t", "\n")).alias("line")).filter("trim(line) != '' AND NOT startswith(line, 'version ')")
    tabbed = F.col("line").contains("\t")
    name = F.when(tabbed, F.substring_index("line", "\t", 1)).otherwise(F.substring_index("line", " ", 1))
    rest = F.split(F.substring("line", F.length("name") + 2, F.length("line")), " ", 4)
    mode = rest[0]
    for old, new in MODES.items():
        mode = F.when(rest[0] == old, new).otherwise(mode)
    lines = lines.withColumn("name", name).select("hash", "name", mode.alias("mode"), *(F.nullif(rest[i], F.lit("-")).alias(n) for i, n in ((1, "blob"), (2, "entities"), (3, "subtree"))))
    return lines.select("hash", "name", "mode", (F.col("mode") == MODES["dir"]).alias("is_dir"), "blob", "entities", "subtree")


def tree_texts(entries: DataFrame, by: str) -> DataFrame:
    """by and the canonical text of each tree: entries (name, mode, blob, entities, subtree) in the order of their names."""
    def dash(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("-"))

    line = F.concat("name", F.lit("\t"), F.concat_ws(" ", F.coalesce("mode", F.lit(MODES["file"])), dash("blob"), dash("entities"), dash("subtree")))
    listed = F.array_sort(F.collect_list(F.struct(F.col("name").cast("binary").alias("n"), line.alias("line"))))
    return entries.groupBy(by).agg(F.concat(F.lit(VERSION + "\n"), F.array_join(listed["line"], "\n"), F.lit("\n")).alias("text"))


def parse_entity_lists(objects: DataFrame) -> DataFrame:
    """hash, language, path, pos and entity, for each entity of each list."""
    head, body = _cut(F.col("t"))
    refs = F.filter(F.transform(F.split(body, "\n"), lambda x: stripped(x)), lambda x: x != "")
    lists = _text(objects, "entitylist").select("hash", _value(head, "language").alias("language"), _value(head, "path").alias("path"), refs.alias("refs"))
    return lists.select("hash", "language", "path", F.posexplode("refs").alias("pos", "entity"))


def entity_list_text(language: Column, path: Column, refs: Column) -> Column:
    head = F.concat(F.lit(f"{VERSION}\nlanguage "), language, F.lit("\npath "), path, F.lit("\n\n"))
    return F.concat(head, F.array_join(F.transform(refs, lambda r: F.concat(r, F.lit("\n"))), ""))


def parse_entities(objects: DataFrame) -> DataFrame:
    """hash, kind, name, decl_kind, receiver, body_hash and body of each entity."""
    head, body = _cut(F.col("t"))
    fields = {"kind": "kind", "name": "name", "declkind": "decl_kind", "receiver": "receiver", "bodyhash": "body_hash"}
    return _text(objects, "entity").select("hash", *(_value(head, k).alias(n) for k, n in fields.items()), body.alias("body"))


def entity_text(kind: Column, name: Column, decl_kind: Column, receiver: Column, body: Column) -> Column:
    return F.concat(
        F.lit(f"{VERSION}\nkind "), kind, F.lit("\nname "), name, F.lit("\ndeclkind "), decl_kind, F.lit("\nreceiver "), receiver,
        F.lit("\nbodyhash "), F.sha2(body, 256), F.lit("\n\n"), body,
    )


def parse_tags(objects: DataFrame) -> DataFrame:
    """hash, target and body of each tag object."""
    head, body = _cut(F.col("t"))
    return _text(objects, "tag").select("hash", stripped(_value(head, "target")).alias("target"), body.alias("body"))


def tag_text(target: Column, body: Column) -> Column:
    return F.concat(F.lit(f"{VERSION}\ntarget "), target, F.lit("\n\n"), body)


def references(objects: DataFrame) -> DataFrame:
    """(child, parent): every hash that an object of any type names; blobs and entities name none."""
    commits = parse_commits(objects)
    trees = parse_trees(objects)
    inside = F.explode(F.array_compact(F.when(F.col("is_dir"), F.array("subtree")).otherwise(F.array("blob", "entities"))))
    lists = parse_entity_lists(objects).select(F.col("hash").alias("child"), F.col("entity").alias("parent"))
    return (
        commits.select(F.col("hash").alias("child"), F.explode(F.concat(F.array("tree"), "parents")).alias("parent"))
        .unionByName(trees.select(F.col("hash").alias("child"), inside.alias("parent")))
        .unionByName(lists)
        .unionByName(parse_tags(objects).select(F.col("hash").alias("child"), F.col("target").alias("parent")))
    )
