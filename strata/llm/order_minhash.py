"""Order MinHash fingerprints, in DataFrame functions alone.

A text's k-mers are its runs of ``K`` words.  Equal k-mers are told apart by
occurrence number, so the k-mers are a set that keeps multiplicity.  Each of
``HASHES`` hash functions selects the ``2`` k-mers that are least under it; they
are put back into the order they have in the text and hashed as a tuple.  Two
texts agree in a tuple if the same k-mers are least and stand in the same order,
so the share of agreeing tuples falls with edit distance, not only with the
overlap of sets.

The hash functions are rotations of one hash: the i-th is h - i * 2 ** 34 /
HASHES, modulo 2 ** 34.  What is least under it are the k-mers that come next on
the circle of hash values, so that one sorted array serves all of them.

The likeness of two fingerprints is 2J / (1 + J), the part of their k-mers that
two texts share, where J ** L estimates the share p of agreeing tuples and L is
the mean tuple size: J = p ** (1 / L).

Documents follow each other by doc_id.  Their order is found on (doc_id, mark)
alone; a text then moves once, and half of it once more to the document before.

Defined results: null and empty texts, and texts of white space, have the empty
fingerprint, which is like itself (1) and unlike all else (0); a table of one
document has it for its own successor; rows with one doc_id follow each other
by a hash of the text, and rows that repeat in full have one successor, the row
after them all; a null doc_id comes last; an empty table gives an empty result;
other columns are ignored.  A text without white space is one k-mer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import Workspace, row_mark

K = 2
HASH_BITS = 6
HASHES = 1 << HASH_BITS
#: A string of 2 GB has fewer words than 2 ** 30.
POSITION_BITS = 30
#: Rows of a range of doc_ids, and ranges at most.
RANGE_ROWS = 20_000
MOST_RANGES = 20_000
LAST = (1 << 63) - 1
_HIGH = -(1 << POSITION_BITS)  # all bits but the position's
_LOW = (1 << POSITION_BITS) - 1


def _with_tuples(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: for each hash function, is a pair << 16 | tuple hash; no entry for a text without k-mers."""
    words, kmers, least = f"{out}_w", f"{out}_k", f"{out}_l"
    w, s, b = F.col(words), F.col(kmers), F.col(least)
    df = df.withColumn(words, F.array_remove(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), ""))

    def kmer(x: Column, i: Column) -> Column:
        run = F.xxhash64(x, *(F.get(w, i + j) for j in range(1, K)))
        return run.bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("long"))

    count = F.greatest(F.size(w) - (K - 1), F.least(F.size(w), F.lit(1)))
    df = df.withColumn(kmers, F.sort_array(F.transform(F.slice(w, F.lit(1), count), kmer))).drop(words)

    # runs of equal k-mers; within a run the occurrences count up from 0
    places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))

    def head(x: Column) -> Column:
        return F.shiftright(x, POSITION_BITS)

    starts = f"{out}_s"
    df = df.withColumn(starts, F.filter(places, lambda i: (i == 0) | (head(F.get(s, i)) != head(F.get(s, i - 1)))))
    st = F.col(starts)
    numbered = F.flatten(
        F.transform(st, lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get(st, j + 1), F.size(s)) - a - 1))
    )

    def occurrence(x: Column, number: Column) -> Column:
        return F.xxhash64(head(x), number).bitwiseAND(F.lit(_HIGH)).bitwiseOR(x.bitwiseAND(F.lit(_LOW)))

    df = df.withColumn(least, F.sort_array(F.zip_with(s, numbered, occurrence))).drop(starts)

    def arc(x: Column) -> Column:
        """Between which two rotations the hash lies; the array is sorted as signed numbers, from the middle arc on."""
        return F.shiftright(x, 64 - HASH_BITS) + HASHES // 2

    def tuple_of(i: Column) -> Column:
        first, second = F.get(b, i), F.get(b, (i + 1) % F.size(b))
        in_order = first.bitwiseAND(F.lit(_LOW)) < second.bitwiseAND(F.lit(_LOW))
        both = F.when(in_order, F.xxhash64(head(first), head(second))).otherwise(F.xxhash64(head(second), head(first)))
        pair = both.bitwiseAND(F.lit(0xFFFF)) + F.lit(1 << 16)
        return F.when(F.size(b) > 1, pair).otherwise(F.xxhash64(head(first)).bitwiseAND(F.lit(0xFFFF))).cast("int")

    # the first k-mer of each arc that holds one is next for the rotations since the arc before it that does
    places_b = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
    nexts = f"{out}_n"
    df = df.withColumn(nexts, F.filter(places_b, lambda i: (i == 0) | (arc(F.get(b, i)) != arc(F.get(b, i - 1)))))
    n = F.col(nexts)

    def served(i: Column, j: Column) -> Column:
        before = F.when(j == 0, F.lit(-1)).otherwise(arc(F.get(b, F.get(n, j - 1))))
        return F.array_repeat(tuple_of(i), (arc(F.get(b, i)) - before).cast("int"))

    beyond = F.array_repeat(tuple_of(F.lit(0)), (HASHES - 1 - arc(F.element_at(b, -1))).cast("int"))
    none = F.array().cast("array<int>")
    tuples = F.when(F.size(b) > 0, F.concat(F.flatten(F.transform(n, served)), beyond)).otherwise(none)
    return df.withColumn(out, tuples).drop(kmers, least, nexts)


def _string(tuples: Column) -> Column:
    return F.array_join(F.transform(tuples, lambda t: F.lpad(F.hex(t), 5, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    agreeing = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: F.coalesce(same, F.lit(False))))
    share = agreeing / F.greatest(F.size(a), F.size(b))
    pairs = F.size(F.filter(F.concat(a, b), lambda t: t.bitwiseAND(F.lit(1 << 16)) != 0))
    mean = 1 + pairs / (F.size(a) + F.size(b))
    jaccard = F.pow(share, 1 / mean)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(2 * jaccard / (1 + jaccard))


def _successors(docs: DataFrame, work: Workspace) -> DataFrame:
    """(id, mark, half, copies, next_id, next_mark): half the code points, rows, and the row after it, for each (id, mark)."""
    ids = work.write(docs.groupBy("id", "mark").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "ids")
    ranges = max(1, min(MOST_RANGES, ids.count() // RANGE_ROWS))
    dealt = work.write(ids.repartitionByRange(ranges, "id", "mark").withColumn("range", F.spark_partition_id()), "ranges")
    # one row for each range: where the next one begins
    bounds = dealt.groupBy("range").agg(F.min(F.struct("id", "mark")).alias("first"))
    upward = Window.orderBy("range")
    least = F.first("first").over(upward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bounds = bounds.select("range", F.coalesce(F.lead("first").over(upward), least).alias("beyond"))
    after = F.lead(F.struct("id", "mark")).over(Window.partitionBy("range").orderBy("id", "mark"))
    found = dealt.withColumn("after", after).join(bounds, "range").withColumn("next", F.coalesce("after", "beyond"))
    half = F.floor(F.col("n") / 2).cast("int").alias("half")
    return work.write(found.select("id", "mark", half, "copies", F.col("next.id").alias("next_id"), F.col("next.mark").alias("next_mark")), "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    work = Workspace(docs.sparkSession, "order-minhash")
    docs = docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")
    ).select("id", row_mark(F.col("text")).alias("mark"), "text", F.length("text").alias("n"))
    following = _successors(docs.drop("text"), work)
    # both joins read the same four columns, so that the texts are dealt out once for the two of them
    own = _with_tuples(docs.drop("n"), "text", "own")
    # to the document before: its replacement text, and the fingerprint
    to = following.select(F.col("id").alias("to_id"), F.col("mark").alias("to_mark"), "half", F.col("next_id").alias("id"), F.col("next_mark").alias("mark"))
    sent = own.join(to, ["id", "mark"]).select(
        F.col("to_id").alias("id"), F.col("to_mark").alias("mark"), F.left("text", F.col("half")).alias("new"), F.col("own").alias("following"), "half"
    )
    if not following.filter("copies > 1").isEmpty():  # rows that repeat send the same
        sent = sent.dropDuplicates(["id", "mark"])
    df = own.join(sent, ["id", "mark"]).withColumn("n", F.length("text"))
    df = df.withColumn("edited", F.concat(F.left("text", F.col("n") - F.col("half")), F.col("new"))).drop("text", "new")
    df = _with_tuples(df, "edited", "changed")
    return df.select(
        F.nullif("id", F.lit(LAST)).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        _string(F.col("own")).alias("fingerprint"),
        _string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
