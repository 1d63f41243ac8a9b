"""Exact Jaccard join of shingle sets, by index lists that are skipped in blocks and answers derived from answers.

Documents with equal sets are one class, the unit of all that follows.  A set's
shingles are put in a global order, rare ones first (by hashed counts over all
documents, then by hash).  Sets that link share a shingle among their first
n - ceil(percent * n / 100) + 1, so the index has a list of (set, size, position) for
each of these (and for n // MORE more, so that sets without that many shared entries drop out).  An entry at position i has r = n - i shingles left, and a link needs
percent * (n + m) / (100 + percent) in common: that bounds the size m of the partner.
Lists are kept in blocks by size, and an entry looks at the blocks alone that its
position leaves open.

Relations between sets spare the rest.  Each list names the set that stands earliest
in its own order as its reference; a set takes the reference with which it shares
most lists, if it is at least half like it, and only the difference to it goes on.
With M shingles of the reference P missing and A added, let V = 100 M + percent A.
Then for two sets of one reference

    100 * intersection >= percent * union  <=>  (100 + percent) * |D & E| >= V + W - (100 - percent) * |P|

where D and E are their differences (missing and added alike), V and W their costs: the
answer of one is derived from that of the other by the few shingles in which they
differ.  V <= (100 - percent) * |P| says that a set is linked with the reference.  Two
linked ones are in one component already; every other pair needs a common shingle of
its differences, and is found by lists of a prefix of these in bands of cost, each member
with the first of its list before any other.  Of a template with any number of edited
copies, only copies with common edits are compared.  Sets of different references meet
in the lists, group by group: references first, then each with the first of the other
group.  All others meet only if they are in different components.  Each link is confirmed on full sets (64-bit hashes).

Defined results: null and empty texts, and texts of white space, have an empty set, no
link and themselves as component; fewer than ``words`` words make one shingle; rows
that repeat are one class; a null doc_id counts after all others; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
import zstandard

from strata.llm.codes import steps
from strata.llm.common import Workspace, bit_table, flat_utf8
from strata.llm.components import components
from strata.llm.tensor_minhash import set_digests, shingle_sets

WORDS = 4
PERCENT = 85
#: Shingles of a counter on average, and counters at most (one byte each is broadcast).
SHINGLES_OF_COUNTER = 8
MOST_COUNTERS = 1 << 26
COUNTERS_OF_BLOCK = 65_536
#: Linked sets of n share 1 + n // MORE entries at least, because the index has n // MORE more of each set than one would need.
MORE = 40
#: Size blocks for each factor of 100 / percent, and the factor of a band of costs.
BLOCKS_OF_RANGE = 4
BAND = 1.25
#: Bits of the filter for the sets that are compared: 16 a set, 32 MB at most.
MOST_BITS = 1 << 28
ROWS = 500_000


def _hashed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and digest of each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in steps(batch.column(1)):
                sets, at = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(np.diff(at)), pa.array(set_digests(sets, at), pa.binary())],
                    ["doc_id", "n_shingles", "digest"],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        sketch, "doc_id long, n_shingles long, digest binary"
    )


def _levels(docs: DataFrame, words: int, size: int) -> np.ndarray:
    """How often shingles of each counter occur in all documents, on a logarithmic scale of one byte."""

    block = min(size, COUNTERS_OF_BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int32)
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                sets, _ = shingle_sets(data, offsets, words)
                np.add.at(counts, (sets & np.uint64(size - 1)).astype(np.int64), 1)
        squeeze = zstandard.ZstdCompressor(level=1)
        for i in range(0, size, block):
            held = squeeze.compress(counts[i : i + block].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([i // block]), pa.array([held], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zstandard.decompress(held), np.int32)
                sums[at] = sums.get(at, 0) + counts.astype(np.int64)
        levels = [np.minimum(255, 6 * np.log2(1.0 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(levels, pa.binary())], ["block", "levels"])

    counted = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(count, "block long, counts binary")
    out = np.zeros(size, np.uint8)
    for r in counted.repartition("block").mapInArrow(add, "block long, levels binary").collect():
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(r.levels, np.uint8)
    return out


def _prefixes(docs: DataFrame, words: int, percent: int, shared: Broadcast) -> DataFrame:
    """(digest, prefix): the first shingles of every set in the global order, each set once a batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for _, _, data, offsets in steps(batch.column(0)):
                sets, at = shingle_sets(data, offsets, words)
                level = levels[(sets & np.uint64(len(levels) - 1)).astype(np.int64)]
                for i, digest in enumerate(set_digests(sets, at)):
                    if digest and digest not in found:
                        own, n = sets[at[i] : at[i + 1]], int(at[i + 1] - at[i])
                        order = np.argsort(level[at[i] : at[i + 1]], kind="stable")  # the set is in order of its hashes
                        found[digest] = own[order[: n + percent * n // -100 + 1 + n // MORE]].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "prefix"])

    return docs.select(docs["text"].cast("string").alias("text")).mapInArrow(cut, "digest binary, prefix binary")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> tuple[DataFrame, Broadcast]:
    """(node, n, members) of the sets of ``wanted`` (node, digest, n), a table; and the filter that finds them."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, math.ceil(math.log2(1 + 16 * wanted.count()))))

    def bit_of(digests: list[bytes]) -> np.ndarray:
        low = np.array([int.from_bytes(x[:8], "little") for x in digests], np.uint64)
        return (low & np.uint64(size - 1)).astype(np.int64)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = bit_of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.int64(1), bit & 63))], ["word", "mask"])

    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select("digest").mapInArrow(bits, "word long, mask long"), size))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for _, _, data, offsets in steps(batch.column(0)):
                sets, at = shingle_sets(data, offsets, words)
                digests = set_digests(sets, at)
                bit = bit_of(digests)
                may = ((shared.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                found = [i for i in np.flatnonzero(may).tolist() if digests[i] and not (digests[i] in seen or seen.add(digests[i]))]
                if found:
                    members = [sets[at[i] : at[i + 1]].tobytes() for i in found]
                    yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in found], pa.binary()), pa.array(members, pa.binary())], ["digest", "members"])

    found = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(sets_of, "digest binary, members binary")
    return found.join(wanted, "digest").dropDuplicates(["node"]).select("node", "n", "members"), shared


def _unfold(df: DataFrame, carried: list[str], held: str) -> DataFrame:
    """The long columns ``carried``, token and pos: one row for each entry of a column of 8-byte shingles."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(len(carried)).to_pylist()], np.int64)
            data, _ = flat_utf8(batch.column(len(carried)))
            of = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            token = np.frombuffer(data.tobytes(), np.int64)
            own = [batch.column(i).to_numpy() for i in range(len(carried))]
            for i in range(0, len(of), ROWS):
                part = slice(i, i + ROWS)
                columns = [*(pa.array(x[of[part]]) for x in own), pa.array(token[part]), pa.array(pos[part].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*carried, "token", "pos"])

    return df.select(*carried, held).mapInArrow(unfold, ", ".join(f"{c} long" for c in carried) + ", token long, pos int")


def _compared(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """u, v, their sizes, how many shingles they have in common and, if asked for, those of one alone."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, apart = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.frombuffer(x.as_py() + y.as_py(), np.uint64).copy()
                n = len(x.as_py()) // 8
                both.sort(kind="stable")
                same = both[1:] == both[:-1]
                sizes.append((n, len(both) - n, int(same.sum())))
                if differences:
                    alone = ~(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
                    apart.append(both[alone].tobytes())
            n, m, common = np.array(sizes, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n), pa.array(m), pa.array(common), pa.array(apart if differences else [None] * len(sizes), pa.binary())],
                ["u", "v", "n_u", "n_v", "common", "apart"],
            )

    left = sets.select(F.col("node").alias("u"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("members").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(
        compare, "u long, v long, n_u long, n_v long, common long, apart binary"
    )


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return _compared(pairs, sets).filter(F.col("common") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("common")) * percent).select("u", "v")


def _least(x: Column, by: int) -> Column:
    """x / by, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(x / by)).cast("long")


def _unlike(u: DataFrame, v: DataFrame, key: list[str], by: list[str], meet: Column) -> DataFrame:
    """Rows of ``u`` and ``v`` of one key and different values of ``by`` (called by_u and by_v), met value by value: rows that agree are never paired."""
    values_u, values_v = u.select(*key, *(f"{x}_u" for x in by)).distinct(), v.select(*key, *(f"{x}_v" for x in by)).distinct()
    meets = values_u.join(values_v, key).filter(meet)
    return meets.join(u, [*key, *(f"{x}_u" for x in by)]).join(v, [*key, *(f"{x}_v" for x in by)])


def _pairs(found: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    return found.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).filter("u != v").distinct()


def _difference_lists(near: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists by difference of the sets that have one reference: those that look, and those that are looked at.

    ``near`` has node, pivot, size (of the reference), apart, d (how many these are),
    cost and linked.  One of a pair at least is not linked with the reference: it looks.
    """
    all_, by = (100 - percent) * F.col("size"), 100 + percent
    near = near.withColumn("band", F.floor(F.log(BAND, F.col("cost").cast("double"))).cast("int"))
    open_ = near.filter("NOT linked").select("pivot").distinct()
    near = near.join(open_, "pivot", "left_semi")
    tokens = _unfold(near, ["node", "pivot"], "apart")
    often = tokens.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("often"))
    # rare differences first; those that one set alone has keep their places but need no list
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "token")) - 1
    tokens = tokens.join(often, ["pivot", "token"]).select("node", "token", "often", place.alias("pos")).filter("often > 1").drop("often")

    bands = near.groupBy("pivot", "band").agg(F.min("cost").alias("least"), F.min(F.when(~F.col("linked"), F.col("cost"))).alias("least_open"))
    bands = bands.withColumnRenamed("band", "other")
    own = near.drop("apart").join(bands, "pivot")
    probe = own.filter("NOT linked").withColumn("keep", F.col("d") - _least(F.col("cost") + F.col("least") - all_, by) + 1)
    index = own.filter("least_open IS NOT NULL").withColumn("keep", F.col("d") - _least(F.col("cost") + F.col("least_open") - all_, by) + 1)
    probe = probe.join(tokens, "node").filter("pos < keep").select(
        "pivot", F.col("band").alias("of_open"), F.col("other").alias("of_any"), "token", F.col("node").alias("u"), (F.col("d") - F.col("pos")).alias("rest_u"),
        F.col("cost").alias("cost_u"), "size",
    )
    index = index.join(tokens, "node").filter("pos < keep").select(
        "pivot", F.col("other").alias("of_open"), F.col("band").alias("of_any"), "token", F.col("node").alias("v"), (F.col("d") - F.col("pos")).alias("rest_v"),
        F.col("cost").alias("cost_v"), "linked",
    )
    return probe, index


LIST = ["pivot", "of_open", "of_any", "token"]


def _derived_heads(probe: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of each member of a list with the first of the other side of the list."""
    first_u, first_v = probe.groupBy(*LIST).agg(F.min("u").alias("u")), index.groupBy(*LIST).agg(F.min("v").alias("v"))
    return _pairs(probe.select(*LIST, "u").join(first_v, LIST).union(first_u.join(index.select(*LIST, "v"), LIST).select(*LIST, "u", "v")))


def _derived(probe: DataFrame, index: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components whose differences may have enough in common."""
    labels = labels.select("node", "label")
    u = probe.join(labels.toDF("u", "label_u"), "u", "left").withColumn("label_u", F.coalesce("label_u", "u"))
    v = index.join(labels.toDF("v", "label_v"), "v", "left").withColumn("label_v", F.coalesce("label_v", "v"))
    enough = F.least("rest_u", "rest_v") * (100 + percent) >= F.col("cost_u") + F.col("cost_v") - (100 - percent) * F.col("size")
    found = _unlike(u, v, LIST, ["label"], F.col("label_u") != F.col("label_v"))
    return _pairs(found.filter(enough & (F.col("linked") | (F.col("u") < F.col("v")))))


def _block(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) * (BLOCKS_OF_RANGE / math.log(100 / min(percent, 99)))).cast("int")


def _possible(members: DataFrame, percent: int) -> DataFrame:
    """The entries of sets that share enough of them with sets of fitting sizes, whichever these are."""
    need = 1 + F.floor(F.col("n") * percent / (100 * MORE))  # for a partner of the least size
    enough = members.groupBy("node", "n").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= need).select("node")
    members = members.join(enough, "node", "left_semi")
    # up to n // MORE entries before this one may be shared
    left = F.col("n") - F.col("pos") + F.floor(F.col("n") / MORE)
    top = F.least(F.floor(100 * F.col("n") / percent), F.floor((100 + percent) * left / percent) - F.col("n")).cast("long")
    at = members.select("token", "node", "n", _block(F.col("n"), percent).alias("block"), top.alias("top"))
    small = at.filter("top >= n").withColumn("block", F.explode(F.sequence("block", _block(F.col("top"), percent))))
    both = at.withColumn("role", F.lit(0)).unionByName(small.withColumn("role", F.lit(1)))
    ends = [f(F.when(F.col("role") == r, F.col("node"))).alias(x) for r, f, x in ((0, F.min, "a"), (0, F.max, "b"), (1, F.min, "c"), (1, F.max, "d"))]
    meets = both.groupBy("token", "block").agg(*ends).filter("a IS NOT NULL AND c IS NOT NULL AND NOT (a = b AND c = d AND a = c)").select("token", "block")
    able = both.join(meets, ["token", "block"]).select("node", "n", "token").distinct().groupBy("node", "n").agg(F.count(F.lit(1)).alias("k"))
    return members.join(able.filter(F.col("k") >= need).select("node"), "node", "left_semi")


def _across(at: DataFrame, percent: int, phase: str) -> DataFrame:
    """Pairs (u, v) of sets of different references and components that a list brings together.

    ``at`` has token, node, n, pos, pivot and label.  Groups of one reference and component
    meet in a list: in the phase heads by their references, in the phase first each
    member with the first of the other group, in the phase all each with each.
    """
    left = F.col("n") - F.col("pos")
    # of a set at least as large, and of one at most as large
    top = F.least(F.floor(100 * F.col("n") / percent), F.floor((100 + percent) * left / percent) - F.col("n")).cast("long")
    at = at.withColumns({"top": top, "block": _block(F.col("n"), percent)})
    index = at.filter("top >= n").withColumn("block", F.explode(F.sequence("block", _block(F.col("top"), percent))))
    apart = (F.col("pivot_u") != F.col("pivot_v")) & (F.col("label_u") != F.col("label_v"))
    key, names = ["token", "block"], ("pivot", "label", "node", "n", "top")
    u, v = (df.select(*key, *(F.col(x).alias(f"{x}_{s}") for x in names)) for df, s in ((index, "u"), (at, "v")))
    by_u, by_v = ([*key, f"pivot_{s}", f"label_{s}"] for s in "uv")
    fits = "n_u <= n_v AND n_v <= top_u AND n_u <= top_v"
    if phase == "all":
        return _pairs(_unlike(u, v, key, ["pivot", "label"], apart).filter(fits), "node_u", "node_v")
    small = u.groupBy(*by_u).agg(F.min("n_u").alias("n_u"), F.max("top_u").alias("top_u"))
    large = v.groupBy(*by_v).agg(F.min("n_v").alias("least_v"), F.max("n_v").alias("n_v"), F.max("top_v").alias("top_v"))
    meets = small.join(large, key).filter(apart & F.expr("n_u <= n_v AND least_v <= top_u AND n_u <= top_v")).select(*by_u, *by_v[2:])
    if phase == "heads":
        return _pairs(meets, "pivot_u", "pivot_v")
    first_u = u.groupBy(*by_u).agg(F.min(F.struct("node_u", "n_u", "top_u")).alias("f")).select(*by_u, "f.*")
    first_v = v.groupBy(*by_v).agg(F.min(F.struct("node_v", "n_v", "top_v")).alias("f")).select(*by_v, "f.*")
    found = meets.join(u, by_u).join(first_v, by_v).unionByName(meets.join(first_u, by_u).join(v, by_v))
    return _pairs(found.filter(fits), "node_u", "node_v")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the least doc_id that links reach."""
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard-join")
    hashed = work.write(_hashed(docs, words), "hashed")
    total = hashed.agg(F.sum("n_shingles")).first()[0] or 0
    levels = _levels(docs, words, 1 << min(MOST_COUNTERS.bit_length() - 1, max(12, (total // SHINGLES_OF_COUNTER).bit_length())))
    classes = hashed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"))
    shared = spark.sparkContext.broadcast(levels)
    prefixes = _prefixes(docs, words, percent, shared).dropDuplicates(["digest"])
    # written once: the numbers of the nodes last
    nodes = work.write(classes.join(prefixes, "digest").withColumn("node", F.monotonically_increasing_id()), "nodes")
    shared.destroy()
    del levels

    lists = _unfold(nodes, ["node", "n"], "prefix")
    repeated = lists.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("token")
    members = _possible(work.write(lists.join(repeated, "token"), "shared"), percent)
    members = work.write(members, "possible")
    # the earliest place in its own order first: the set with the fewest shingles of its own; 10 bits, 53 for the node
    rank = F.shiftleft(F.floor(F.col("pos") * 1023 / F.col("n")).cast("long"), 53).bitwiseOR(F.col("node"))
    pivots = members.groupBy("token").agg(F.min(rank).bitwiseAND(F.lit((1 << 53) - 1)).alias("pivot"))
    members = work.write(members.join(pivots, "token"), "members")

    wanted = work.write(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "digest", "n"), "wanted")
    sets, shared = _full_sets(docs, wanted, words)
    sets = work.write(sets, "sets")
    shared.destroy()

    by_list = members.filter("node != pivot").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("lists"))
    most = by_list.groupBy("node").agg(F.max(F.struct("lists", (-F.col("pivot")).alias("p"))).alias("m"))
    followers = most.select(F.col("node").alias("u"), (-F.col("m.p")).alias("v"))
    missing, added = F.col("n_v") - F.col("common"), F.col("n_u") - F.col("common")
    near = _compared(followers, sets, differences=True).filter(F.col("common") * 2 >= F.col("n_u") + F.col("n_v") - F.col("common")).select(
        F.col("u").alias("node"), F.col("v").alias("pivot"), F.col("n_v").alias("size"), "apart", (missing + added).alias("d"),
        (100 * missing + percent * added).alias("cost"),
    )
    near = work.write(near.withColumn("linked", F.col("cost") <= (100 - percent) * F.col("size")), "near")
    links = near.filter("linked").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    # what is linked with a reference is in its component; whole components where it matters
    labels, whole = near.filter("linked").select("node", F.col("pivot").alias("label")), near.filter("linked").isEmpty()

    def confirmed(pairs: DataFrame, name: str, relabel: bool) -> None:
        """Add the links among new pairs."""
        nonlocal links, labels, whole
        new = work.write(_links(pairs, sets, percent), f"links-{name}")
        if not new.isEmpty():
            links, whole = links.union(new), relabel
            if relabel:
                labels = work.write(components(links, "jaccard-components"), f"labels-{name}")

    probe, index = (work.write(x, name) for x, name in zip(_difference_lists(near, percent), ("looking", "looked-at"), strict=True))
    first = work.write(_derived_heads(probe, index), "first")
    confirmed(first, "first", relabel=True)
    derived = _derived(probe, index, labels, percent)
    confirmed(work.write(derived.join(first, ["u", "v"], "left_anti"), "derived"), "derived", relabel=False)

    at = members.select("token", "node", "n", "pos").join(near.select("node", "pivot"), "node", "left").withColumn("pivot", F.coalesce("pivot", "node"))
    tested = near.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"))
    for name in ("heads", "first", "all"):
        labelled = at.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
        labelled = work.write(labelled.join(mixed, "token"), f"mixed-{name}")
        pairs = work.write(_across(labelled, percent, name).join(tested, ["u", "v"], "left_anti"), f"across-{name}")
        tested = tested.union(pairs)
        confirmed(pairs, f"across-{name}", relabel=True)
    if not whole:
        labels = work.write(components(links, "jaccard-components"), "labels")

    found = nodes.select("digest", "node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = found.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = found.join(least, "label").select("digest", "component_id")
    for name in ("shared", "possible", "members", "wanted", "sets", "looking", "looked-at", "mixed-heads", "mixed-first", "mixed-all"):
        work.drop(name)
    return hashed.join(found, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
