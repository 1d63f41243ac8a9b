"""Readers and writers of versioned objects and line-oriented records.

All schemas are explicit.  Object tables are keyed by content hash, so a write
is an anti join and an append, and a repeated write changes nothing.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECTS = "hash string, type string, size long, data binary"
COMMITS = "hash string, tree string, parents array<string>, author string, timestamp long, message string"
_ENVELOPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("size", T.LongType()), T.StructField("data", T.BinaryType())])


def envelope_hash(kind: Column, data: Column) -> Column:
    head = F.concat(kind, F.lit(" "), F.octet_length(data).cast("string"), F.lit("\0")).cast("binary")
    return F.sha2(F.concat(head, data), 256)


@F.pandas_udf(_ENVELOPE)
def open_envelope(content: pd.Series) -> pd.DataFrame:
    """type, size and data of loose objects, deflated or plain; nulls where the envelope is damaged."""
    rows = []
    for raw in content:
        try:
            raw = zlib.decompress(raw)
        except (zlib.error, TypeError):
            raw = raw or b""
        head, mark, data = raw.partition(b"\0")
        kind, _, size = head.decode("latin-1").partition(" ")
        rows.append((kind, int(size), data) if mark and size.isdigit() and int(size) == len(data) else (None, None, None))
    return pd.DataFrame(rows, columns=["type", "size", "data"])


def read_loose(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a folder of loose files, two hex digits of the hash naming the inner folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = F.regexp_replace(F.regexp_extract("path", r"([0-9a-f]{2}/[0-9a-f]{62})$", 1), "/", "")
    return files.select(named.alias("hash"), open_envelope("content").alias("o")).filter("hash != ''").select("hash", "o.*")


def put(objects: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (type, data) that the object table lacks, with hash and size: what to append."""
    rows = new.select(envelope_hash(F.col("type"), F.col("data")).alias("hash"), "type", F.octet_length("data").cast("long").alias("size"), "data")
    return rows.dropDuplicates(["hash"]).join(objects.select("hash"), "hash", "left_anti")


def damaged(objects: DataFrame) -> DataFrame:
    """Objects whose content does not hash to their key."""
    return objects.filter(~envelope_hash(F.col("type"), F.col("data")).eqNullSafe(F.col("hash")))


def commit_text(tree: Column, parents: Column, author: Column, timestamp: Column, message: Column) -> Column:
    """A commit's canonical text: header lines, an empty line, the message."""
    lines = F.transform(parents, lambda p: F.concat(F.lit("parent "), p))
    head = F.concat(
        F.array(F.concat(F.lit("tree "), tree)), lines,
        F.array(F.concat(F.lit("author "), author), F.concat(F.lit("timestamp "), timestamp.cast("string"))),
    )
    return F.concat(F.array_join(head, "\n"), F.lit("\n\n"), message)


def parse_commits(objects: DataFrame) -> DataFrame:
    """Commit rows of an object table; header lines of unknown name are skipped."""
    text = objects.filter("type = 'commit'").select("hash", F.col("data").cast("string").alias("t"))
    cut = F.locate("\n\n", F.col("t"))
    text = text.select("hash", F.split(F.substring("t", F.lit(1), cut - 1), "\n").alias("head"), F.substring("t", cut + 2, F.length("t")).alias("message"))

    def values(name: str) -> Column:
        held = F.filter("head", lambda x: x.startswith(name + " "))
        return F.transform(held, lambda x: F.substring(x, F.lit(len(name) + 2), F.length(x)))

    one = {name: F.get(values(name), F.lit(0)) for name in ("tree", "author", "timestamp")}
    return text.select("hash", one["tree"].alias("tree"), values("parent").alias("parents"), one["author"].alias("author"), one["timestamp"].cast("long").alias("timestamp"), "message")


def parse_reflog(lines: DataFrame) -> DataFrame:
    """(old, new, timestamp, reason, entities) of lines ``old new time reason[TAB path:key:change,...]`` in column value.

    A change's path ends at its first colon, its kind begins after the last.
    """
    main, tail = F.split("value", "\t", 2)[0], F.get(F.split("value", "\t", 2), F.lit(1))
    part = F.split(main, " ", 4)

    def change(x: Column) -> Column:
        return F.struct(
            F.regexp_extract(x, r"^([^:]*):", 1).alias("path"), F.regexp_extract(x, r"^[^:]*:(.*):[^:]*$", 1).alias("key"), F.substring_index(x, ":", -1).alias("change")
        )

    none = F.array().cast("array<struct<path:string,key:string,change:string>>")
    entities = F.when(tail.isNotNull() & (tail != ""), F.transform(F.split(tail, ","), change)).otherwise(none)
    return lines.filter("value != ''").select(
        part[0].alias("old"), part[1].alias("new"), part[2].cast("long").alias("timestamp"), part[3].alias("reason"), entities.alias("entities")
    )


def parse_rules(lines: DataFrame) -> DataFrame:
    """(pattern, names) of lines ``pattern name...``; comments and empty lines are left out."""
    part = F.split(F.trim(F.regexp_replace("value", "(^|\\s)#.*$", "")), "\\s+")
    return lines.select(part.alias("p")).filter(F.col("p")[0] != "").select(F.col("p")[0].alias("pattern"), F.slice("p", 2, 1 << 20).alias("names"))


def parse_attributes(lines: DataFrame) -> DataFrame:
    """(pattern, values map) of lines ``pattern k=v k -k``; a bare key is true, -key false, binary sets diff and merge false."""
    words = parse_rules(lines)
    entry = F.transform(
        F.flatten(F.transform("names", lambda w: F.when(w == "binary", F.array(F.lit("-diff"), F.lit("-merge"))).otherwise(F.array(w)))),
        lambda w: F.when(w.startswith("-"), F.struct(F.substring(w, F.lit(2), F.length(w)).alias("key"), F.lit("false").alias("value")))
        .when(w.contains("="), F.struct(F.substring_index(w, "=", 1).alias("key"), F.regexp_extract(w, "=(.*)$", 1).alias("value")))
        .otherwise(F.struct(w.alias("key"), F.lit("true").alias("value"))),
    )
    last = F.aggregate(entry, F.expr("map()").cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
    return words.select("pattern", last.alias("values"))
