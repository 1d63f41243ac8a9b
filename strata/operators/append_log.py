"""Append logs whose entries name the hash of the entry before.

An entry is (log, hash, prev, body): ``body`` is the text of its JSON members, ``hash``
the SHA-256 of the blob of ``{"parent":prev,body}``, without parent for the first.
A log is walked by pointers that double, so any number of logs of any length takes
logarithmic rounds, and each entry is checked by itself.  Only the hashes of new
entries need one after the other: a task streams the sorted new entries of its logs
and carries the last hash, so it holds a batch, however long the log is.  A log is a
chain, so the new entries of one log are one task's work by definition.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import graph
from strata.operators.tables import settled


def entry_hash(prev: Column, body: Column) -> Column:
    data = F.concat(F.lit("{"), F.when(prev.isNotNull(), F.concat(F.lit('"parent":"'), prev, F.lit('",'))).otherwise(""), body, F.lit("}"))
    return F.sha2(F.concat(F.lit("blob "), F.octet_length(data).cast("string"), F.lit("\0"), data), 256)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place, hash and prev of new entries that arrive sorted by log; the last of a log is carried on."""
    log, prev, place, begun = None, None, 0, False
    for batch in batches:
        hashes, prevs, places = [], [], []
        columns = (batch.column(name).to_pylist() for name in ("log", "body", "_head", "_place"))
        for own, body, head, start in zip(*columns, strict=True):
            if not begun or own != log:
                log, prev, place, begun = own, head, start, True
            data = (f'{{"parent":"{prev}",{body}}}' if prev else f"{{{body}}}").encode()
            prevs.append(prev)
            places.append(place)
            prev, place = sha256(b"blob %d\0" % len(data) + data).hexdigest(), place + 1
            hashes.append(prev)
        yield pa.RecordBatch.from_arrays(
            [batch.column("log"), pa.array(places, pa.int64()), pa.array(hashes, pa.string()), pa.array(prevs, pa.string()), batch.column("body")],
            ["log", "place", "hash", "prev", "body"],
        )


def appended(new: DataFrame, *order: str, heads: DataFrame | None = None) -> DataFrame:
    """log, place, hash, prev, body of new entries (log, body and what ``order`` names) put behind their log's head.

    heads: log, head, place (of the head, from 0), one row a log; a log without a head begins at place 0.
    Entries without a body have an empty one; ties of ``order`` go by body; a null log is a log of its own.
    """
    rows = new.select("log", *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.coalesce("body", F.lit("")).alias("body"))
    if heads is None:
        rows = rows.select("*", F.lit(None).cast("string").alias("_head"), F.lit(0).cast("long").alias("_place"))
    else:
        last = heads.select(F.col("log").alias("_log"), F.col("head").alias("_head"), (F.col("place") + 1).cast("long").alias("_place"))
        rows = rows.join(last, F.col("log").eqNullSafe(F.col("_log")), "left").drop("_log").fillna(0, ["_place"])
    # dealt by a value that no join before gives: Spark leaves out a repartition by the keys of one, and may later read that join's rows where they lie
    ordered = rows.repartition(F.xxhash64("log")).sortWithinPartitions("log", *(f"_o{i}" for i in range(len(order))), "body")
    kinds = [new.schema["log"], *(T.StructField(n, k()) for n, k in (("place", T.LongType), ("hash", T.StringType), ("prev", T.StringType), ("body", T.StringType)))]
    return ordered.select("log", "body", "_head", "_place").mapInArrow(_linked, T.StructType(kinds))


def walked(entries: DataFrame, heads: DataFrame, limit: int | None = None) -> DataFrame:
    """log, step, hash, prev, body from each head backwards (step 0 is the head), up to a cursor and ``limit`` entries.

    heads: log, head and, if read on, cursor: the last entry that was seen.  A walk ends where an entry is missing, and
    a cursor that is gone stops nothing, so a reader whose place was pruned gets all that is there.
    """
    held = entries.select("log", "hash", "prev", "body").dropDuplicates(["log", "hash"])
    held = settled(held.withColumn("node", F.monotonically_increasing_id()))  # pointers are numbers, a tenth of the hashes
    links = held.select("log", F.col("prev").alias("hash"), F.col("node").alias("child")).join(held.select("log", "hash", F.col("node").alias("parent")), ["log", "hash"])

    def numbered(name: str) -> DataFrame:
        return heads.select("log", F.col(name).alias("hash")).join(held.select("log", "hash", "node"), ["log", "hash"]).select("node")

    chain = graph.chain(links.select("child", "parent", F.lit(0).alias("ord")), numbered("head"), limit)
    if "cursor" in heads.columns:
        chain = graph.until(chain, numbered("cursor"))
    return chain.select("node", F.col("depth").alias("step")).join(held, "node").select("log", "step", "hash", "prev", "body")


def newest(entries: DataFrame) -> DataFrame:
    """log, head, place: the entries that no other entry of their log names, with ``place`` where entries have one."""
    named = entries.filter("prev IS NOT NULL").select("log", F.col("prev").alias("hash")).distinct()
    place = F.col("place") if "place" in entries.columns else F.lit(None).cast("long").alias("place")
    return entries.join(named, ["log", "hash"], "left_anti").select("log", F.col("hash").alias("head"), place).distinct()


def checked(entries: DataFrame) -> DataFrame:
    """log, hash, whole (the hash is that of the content), linked (first, or the entry before is there), forks (entries that follow it)."""
    held = entries.select("log", "hash", "prev", "body").dropDuplicates(["log", "hash", "prev", "body"])
    there = held.select("log", F.col("hash").alias("prev"), F.lit(True).alias("_there")).distinct()
    after = held.filter("prev IS NOT NULL").groupBy("log", F.col("prev").alias("hash")).agg(F.count(F.lit(1)).alias("_after"))
    found = held.join(there, ["log", "prev"], "left").join(after, ["log", "hash"], "left")
    return found.select(
        "log", "hash", F.coalesce(F.col("hash") == entry_hash(F.col("prev"), F.coalesce("body", F.lit(""))), F.lit(False)).alias("whole"),
        (F.col("prev").isNull() | F.col("_there").isNotNull()).alias("linked"), F.coalesce("_after", F.lit(0)).cast("long").alias("forks"),
    )


def pruned(entries: DataFrame, heads: DataFrame, keep: int) -> DataFrame:
    """log, place, hash, prev, body: the newest ``keep`` entries of each log, linked anew from an entry without parent.

    Logs with no more than ``keep`` entries stay as they are.
    """
    walk = walked(entries, heads.select("log", "head"), keep + 1)
    length = walk.groupBy("log").agg((F.max("step") + 1).alias("_n"))
    walk = walk.join(length, "log")
    short = walk.filter(F.col("_n") <= keep).select("log", (F.col("_n") - 1 - F.col("step")).alias("place"), "hash", "prev", "body")
    long = walk.filter((F.col("_n") > keep) & (F.col("step") < keep)).withColumn("_age", -F.col("step"))
    return short.unionByName(appended(long, "_age"))


def merged(entries: DataFrame, heads: DataFrame, others: DataFrame) -> DataFrame:
    """The new entries that put behind each head what the other head of the log (others: log, head) has and it has not.

    heads: log, head, place.  Both branches stay as they are up to where they part.
    """
    own = walked(entries, heads.select("log", "head")).select("log", "hash")
    apart = walked(entries, others.select("log", "head")).join(own, ["log", "hash"], "left_anti").withColumn("_age", -F.col("step"))
    return appended(apart, "_age", heads=heads)
