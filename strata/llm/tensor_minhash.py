"""Near-duplicates by MinHash with tensored banding.

Two small collections of ``HALVES`` half-keys, each of ``ROWS`` minhashes, are
combined pairwise into HALVES ** 2 table keys: the tables of 2 * ROWS rows that
HALVES ** 2 * 2 * ROWS minhashes would give, for 2 * HALVES * ROWS of them.  A
pair of Jaccard similarity s shares a key with probability
(1 - (1 - s ** ROWS) ** HALVES) ** 2: 0.9998 at 0.8 and 0.99999 at 0.85.

Documents with equal shingle sets are one class.  Within the classes that share
a key, links are confirmed on full shingle sets (64-bit hashes), never on
sketches.  Half-keys alone come first: two documents share a table key only if
they share both of its halves, so a half-key that one class alone holds makes no
table key, and a class without a shared half in either collection makes none at
all.  The table keys of the rest are what is dealt out.

A round picks one member of
each group and compares with it the members that are not yet in its component.
After ``STAR_ROUNDS`` rounds, whatever pairs of different components are still
together under a key are all compared, so no link that shares a key is lost.  A
pair that shares many keys is made under the first of them alone.
Pairs that cannot reach the similarity are never made: shingles that no other
candidate holds are in no intersection, and of the others, counted in ``PARTS``
parts by hash, no more can be common in a part than the smaller count.  Members
of a large group of edited copies that differ too much from each other go by
that.
Components come from the links by iterated stars.

Defined results: null and empty texts, and texts of white space, have an empty
set, no link and themselves as component; fewer than ``words`` words make one
shingle; rows that repeat are one class; a null doc_id counts after all others;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.codes import folded_codes, mixed, steps, token_hashes, word_classes
from strata.llm.common import Workspace, bit_table, flat_utf8, row_mark, rows_marked
from strata.llm.components import components

WORDS = 4
PERCENT = 80
HALVES = 13
ROWS = 3
STAR_ROUNDS = 1
PARTS = 16
#: Table keys that one task makes.
KEYS_OF_TASK = 1_000_000
#: Bits of the filter that spares documents without any candidate; 1 MB at most is broadcast.
FILTER_BITS = 1 << 23

_RANDOM = np.random.default_rng(20)
_TIMES = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, one text after the other, and their offsets."""
    hashes, at = token_hashes(data, offsets, word_classes(), folded_codes())
    counts = np.diff(at)
    runs = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        runs += hashes[j : j + len(runs)] * _TIMES[j]
    runs = mixed(runs)
    sets, sizes = [], []
    for first, n in zip(at[:-1].tolist(), counts.tolist(), strict=True):
        if n >= words:
            own = np.unique(runs[first : first + n - words + 1])
        elif n:
            short = (hashes[first : first + n] * _TIMES[words : words + n]).sum(dtype=np.uint64)
            own = mixed(np.array([short + np.uint64(n)]))
        else:
            own = runs[:0]
        sets.append(own)
        sizes.append(len(own))
    return np.concatenate(sets) if sets else runs[:0], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def set_digests(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes that depend on a set alone; b'' for the empty one."""
    halves = []
    for salt in (np.uint64(1), np.uint64(3)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets * np.uint64(5) + salt), dtype=np.uint64)])
        halves.append(sums[at[1:]] - sums[at[:-1]])
    pairs = np.stack(halves, axis=1).tobytes()
    return [pairs[16 * i : 16 * i + 16] if n else b"" for i, n in enumerate(np.diff(at).tolist())]


def half_keys(sets: np.ndarray, at: np.ndarray, halves: int, rows: int) -> np.ndarray:
    """2 * halves half-keys of 64 bits for each text whose set is not empty."""
    starts = at[:-1][np.diff(at) > 0]
    random = np.random.default_rng(61)
    keys = np.empty((len(starts), 2 * halves), np.int64)
    for i in range(2 * halves):
        key = np.full(len(starts), i + 1, np.uint64)
        for j in range(rows):
            flip, times = random.integers(0, 1 << 63, 2, dtype=np.uint64)
            least = np.minimum.reduceat((sets ^ flip) * (times * np.uint64(2) + np.uint64(1)), starts) if len(starts) else key
            key = mixed(key * _TIMES[j] + least)
        keys[:, i] = key.view(np.int64)
    return keys


def _sketches(docs: DataFrame, words: int, halves: int, rows: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in steps(batch.column(1)):
                sets, at = shingle_sets(data, offsets, words)
                sizes = np.diff(at)
                keys = half_keys(sets, at, halves, rows)
                ends = np.concatenate([[0], np.cumsum((sizes > 0) * halves)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(2).slice(first, last - first),
                        pa.array(sizes),
                        pa.array(set_digests(sets, at), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[:, :halves].ravel())),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[:, halves:].ravel())),
                    ],
                    ["doc_id", "mark", "n_shingles", "digest", "a", "b"],
                )

    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), row_mark(text).alias("mark")).mapInArrow(
        sketch, "doc_id long, mark long, n_shingles long, digest binary, a array<long>, b array<long>"
    )


def _table_keys(nodes: DataFrame, work: Workspace, halves: int) -> DataFrame:
    """(node, key) of every table key that may be shared: of halves that two nodes hold."""
    spark = nodes.sparkSession
    a = F.transform("a", lambda x: F.struct(F.lit(0).alias("side"), x.alias("half")))
    b = F.transform("b", lambda x: F.struct(F.lit(1).alias("side"), x.alias("half")))
    own = nodes.select("node", F.explode(F.concat(a, b)).alias("h")).select("node", "h.side", "h.half")
    repeated = own.groupBy("half").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("half")
    found = own.join(repeated, "half").groupBy("node").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("half"))).alias("a"), F.collect_list(F.when(F.col("side") == 1, F.col("half"))).alias("b")
    )
    found = work.write(found.filter((F.size("a") > 0) & (F.size("b") > 0)), "halves")
    keys = found.agg(F.sum((F.size("a") * F.size("b")).cast("long"))).first()[0] or 0
    tensor = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    # each node makes up to halves ** 2 keys, so few files of nodes are dealt anew before
    return found.repartition(max(1, keys // KEYS_OF_TASK)).select("node", F.explode(tensor).alias("key")) if keys else (
        spark.createDataFrame([], "node long, key long")
    )


def _filter_bit(digest: np.ndarray) -> np.ndarray:
    return (digest & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(digest, members) of every set that may be wanted; what the filter lets through besides is joined away."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = np.array([int.from_bytes(x[:8], "little") for x in batch.column(0).to_pylist()], np.uint64)
            bit = _filter_bit(low)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.int64(1), bit & 63))], ["word", "mask"])

    table = bit_table(wanted.select("digest").mapInArrow(bits, "word long, mask long"), FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                sets, at = shingle_sets(data, offsets, words)
                digests = set_digests(sets, at)
                low = np.array([int.from_bytes(x[:8], "little") for x in digests], np.uint64)
                bit = _filter_bit(low)
                may = ((shared.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) & (np.diff(at) > 0)
                found = np.flatnonzero(may).tolist()
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([digests[i] for i in found], pa.binary()),
                            pa.array([sets[at[i] : at[i + 1]].tobytes() for i in found], pa.binary()),
                        ],
                        ["digest", "members"],
                    )

    return docs.select(docs["text"].cast("string").alias("text")).mapInArrow(sets_of, "digest binary, members binary")


def _bounds(sets: DataFrame) -> DataFrame:
    """(node, n, parts): set size, and by part the shingles that some other candidate holds too."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(1).to_pylist()], np.int64)
            data, _ = flat_utf8(batch.column(1))
            node = np.repeat(batch.column(0).to_numpy(), sizes)
            shingle = np.frombuffer(data.tobytes(), np.int64)
            for i in range(0, len(node), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 500_000]), pa.array(shingle[i : i + 500_000])], ["node", "shingle"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.bincount(np.frombuffer(x, np.int64) & (PARTS - 1), minlength=PARTS).tolist() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(pa.int32()))], ["node", "n", "held"])

    held = sets.select("node", "members").mapInArrow(unfold, "node long, shingle long").groupBy("shingle")
    alone = held.agg(F.min("node").alias("node"), F.max("node").alias("most")).filter("node = most")
    part = F.col("shingle").bitwiseAND(F.lit(PARTS - 1))
    own = alone.groupBy("node").agg(F.array(*(F.count_if(part == p).cast("int") for p in range(PARTS))).alias("own"))
    total = sets.select("node", "n", "members").mapInArrow(count, "node long, n long, held array<int>")
    shared = F.when(F.col("own").isNull(), F.col("held")).otherwise(F.zip_with("held", "own", lambda x, y: x - y))
    return total.join(own, "node", "left").select("node", "n", shared.alias("parts"))


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _may_link(n: Column, parts: Column, other_n: Column, other_parts: Column, percent: int) -> Column:
    common = _sum(F.zip_with(parts, other_parts, lambda x, y: F.least(x, y)))
    return common * 100 >= (n + other_n - common) * percent


def _first_shared(a: Column, b: Column, other_a: Column, other_b: Column) -> Column:
    """The first key that two rows of half-keys have in common; null without any."""

    def first(x: Column, y: Column) -> Column:
        return F.get(x, (F.array_position(F.zip_with(x, y, lambda p, q: p == q), True) - 1).cast("int"))

    return F.xxhash64(first(a, other_a), first(b, other_b))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                passed.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["u", "v"]).filter(pa.array(passed, pa.bool_()))

    left = sets.select(F.col("node").alias("u"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("members").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(similar, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    halves: int = HALVES,
    rows: int = ROWS,
    star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    component = F.coalesce("component_id", "doc_id")
    return _grouped(docs, Workspace(docs.sparkSession, "tensor-minhash"), words, percent, halves, rows, star_rounds).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _grouped(
    docs: DataFrame, work: Workspace, words: int, percent: int, halves: int = HALVES, rows: int = ROWS, star_rounds: int = STAR_ROUNDS
) -> DataFrame:
    """doc_id, mark, n_shingles, label and component_id of each row; an empty set has no label and no component."""
    sketches = work.write(_sketches(docs, words, halves, rows), "sketches")
    classes = sketches.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")
    )
    # written once: the numbers of the nodes last
    nodes = work.write(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    keyed = _table_keys(nodes, work, halves)
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    members = work.write(keyed.join(shared, "key"), "members")

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("digest", "node", "n")
    wanted = work.write(wanted, "wanted")
    sets = _full_sets(docs, wanted, words).dropDuplicates(["digest"]).join(wanted, "digest").select("node", "n", "members")
    sets = work.write(sets, "sets")
    # what is left has no link, whatever the partner: too few of its shingles are held elsewhere
    sizes = work.write(_bounds(sets).filter(_sum(F.col("parts")) * 100 >= F.col("n") * percent), "sizes")
    members = work.write(members.join(sizes, "node"), "linkable")

    labels, links, tested = None, None, None
    for i in range(star_rounds + 1):
        at = members
        if labels is None:
            at = at.withColumn("label", F.col("node"))
        else:
            at = at.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        # first the member that shares most: others are likely linked to it
        order = F.struct((-_sum(F.col("parts"))).alias("order"), "node", "label", "n", "parts")
        groups = at.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(order).alias("c")).filter("low < high")
        possible = _may_link(F.col("n"), F.col("parts"), F.col("other_n"), F.col("other_parts"), percent)
        if i < star_rounds:
            centre = groups.select("key", *(F.col(f"c.{x}").alias(f"other_{x}") for x in ("node", "label", "n", "parts")))
            pairs = (
                at.join(centre, "key").filter((F.col("label") != F.col("other_label")) & possible)
                .select(F.least("node", "other_node").alias("u"), F.greatest("node", "other_node").alias("v"))
                .groupBy("u", "v").agg(F.count(F.lit(1)).alias("keys"))
            )
        else:
            at = at.join(work.write(groups.select("key"), "mixed"), "key").join(nodes.select("node", "a", "b"), "node")
            at = work.write(at, "together")
            other = at.select("key", *(F.col(x).alias(f"other_{x}") for x in ("node", "label", "n", "parts", "a", "b")))
            once = _first_shared(F.col("a"), F.col("b"), F.col("other_a"), F.col("other_b")) == F.col("key")
            pairs = (
                at.join(other, "key").filter((F.col("node") < F.col("other_node")) & (F.col("label") != F.col("other_label")) & possible & once)
                .select(F.col("node").alias("u"), F.col("other_node").alias("v"))
            )
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        if i == 0 < star_rounds:  # one partner each, the one with most keys in common: most others are linked through it
            ends = pairs.select(F.explode(F.array("u", "v")).alias("end"), F.struct("keys", "u", "v").alias("p"))
            pairs = ends.groupBy("end").agg(F.max("p").alias("p")).select("p.u", "p.v").distinct()
        pairs = work.write(pairs.select("u", "v"), f"pairs{i}")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.union(pairs)
        new = work.write(_confirm(pairs, sets, percent), f"links{i}")
        links = new if links is None else links.union(new)
        if new.isEmpty():
            continue
        labels = work.write(components(links, "tensor-components"), f"labels{i}")

    for name in ("halves", "members", "wanted", "sets", "sizes", "linkable", "mixed", "together"):
        work.drop(name)
    found = nodes.select("digest", F.col("node").alias("label"), F.col("first_id").alias("component_id"))
    if labels is not None:
        found = nodes.select("digest", "node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = found.groupBy("label").agg(F.min("first_id").alias("component_id"))
        found = found.join(least, "label").select("digest", "label", "component_id")
    return sketches.select("doc_id", "mark", "n_shingles", "digest").join(found, "digest", "left").drop("digest")


def keep_one_of_near(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: of the least doc_id, then the least mark.

    Rows without a word stay; rows that repeat in full stay once.
    """
    work = Workspace(docs.sparkSession, "near-kept")
    rows = work.write(_grouped(docs, work, words, percent), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("first")
    one = rows.filter("label IS NOT NULL").groupBy("label").agg(first).select("first.doc_id", "first.mark", "label")
    # as often as the row stands in the table, so that rows that repeat are seen
    one = rows.select("doc_id", "mark", "label").join(
        one.select(*(F.col(c).alias(f"one_{c}") for c in one.columns)),
        F.expr("label = one_label AND doc_id <=> one_doc_id AND mark = one_mark"), "left_semi",
    )
    kept = one.select("doc_id", "mark").union(rows.filter("label IS NULL").select("doc_id", "mark"))
    return rows_marked(docs, work.write(kept, "kept"))
