"""Repeated substrings across documents by column-wise BWT construction.

Removed is each byte that a string of ``LENGTH`` bytes covers which also starts
in a document of smaller doc_id.

A collection's suffixes are sorted without comparing them: each round prepends
one symbol to every string that has one left, finds from the Burrows-Wheeler
transform so far where the longer suffixes belong, and passes over the
transform, the common prefix lengths and the suffix numbers once, in order, to
insert them.  (The passes run over arrays of a bounded collection, in place of
files outside memory.)  Suffixes that share LENGTH bytes then stand together,
and the smallest doc_id among them decides.

So that any number of documents can be treated, strings that can share a window
of LENGTH bytes are brought together first.  In each window the gram of
``GRAM`` bytes of least hash is its anchor; equal windows have equal anchors.
Runs of windows with one anchor are cut out as strings of fewer than
LENGTH + WINDOW bytes, once, into a table of occurrences.  Only those whose
anchor occurs in two documents are kept.  Of equal strings the one in the
smallest document, the owner, stands for all: whatever a later document has of
it goes whole, so only owners are sorted, and an anchor that a third of all
documents hold is as many strings as it has different surroundings.  Every shard
builds its collections from anchors that have several strings (a single string
is in order as it is).  Where an anchor has more than ``CROWDED`` strings, they
are cut again by the anchors of another order of hashes, which equal windows
share as well, up to ``LEVELS`` times.  Of equal documents only the first takes
part; the others go whole, as the first has every window of theirs.

The filters are bit tables of 16 bits a key, up to ``MOST_BITS``.  A filter that
is too full lets strings through that match nothing; it never loses any.  Beyond
that size a join takes the place of the filter for anchors.

Defined results: null and empty texts have no bytes; a null doc_id counts as
greater than all others; documents with one doc_id do not remove from each
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.codes import byte_codes, mixed, powers, steps
from strata.llm.common import Workspace, bit_table, flat_utf8, utf8_values

LENGTH = 50
GRAM = 24
WINDOW = LENGTH - GRAM + 1
#: Strings of an anchor above which they are cut again, and how often at most.
CROWDED = 16_384
LEVELS = 6
#: Strings that one construction takes at most (more only if one anchor has more), and strings of a shard.
COLLECTION = 4_096
SHARD_ROWS = 100_000
#: Anchors whose documents one group counts, as long as 2 ** 16 groups do.
KEYS_OF_PART = 500_000
#: Bits of a filter at most: 32 MB.
MOST_BITS = 1 << 28
LAST = (1 << 63) - 1


def sort_collection(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection of strings of 1 to 127 bytes, in order.

    Returns string number, length and common prefix with the suffix before, for
    each suffix; the empty suffixes, by string number, come first.
    """
    m = len(ends)
    # for each suffix the common prefix with the one before (high byte) and the symbol before it (low byte);
    # UTF-8 has no byte 255, and 0 marks a string that is used up
    rows = (data[ends - 1] + np.uint8(1)).astype(np.uint16)
    tail = np.zeros(0, np.int64)  # where each suffix stands without its first symbol; the empty ones have none
    first = np.zeros(257, np.int64)  # where the suffixes of each first symbol begin among those in `tail`
    fresh, number, length = np.arange(m), np.arange(m), 0
    while len(fresh):
        symbol = rows[fresh].astype(np.uint8)
        turned = np.argsort(symbol, kind="stable")
        at, symbol, number = fresh[turned], symbol[turned], number[turned]
        a = len(at)
        edge = np.concatenate([[0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1, [a]])
        low, high, k = np.empty(a, np.int64), np.empty(a, np.int64), np.empty(a, np.int64)
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            low[i:j], high[i:j] = first[symbol[i]], first[int(symbol[i]) + 1]
            k[i:j] = low[i] + np.searchsorted(tail[low[i] : high[i]], at[i:j])
        # the nearest of the same symbol before and after, among the old and the fresh
        before, after = np.full(a, -1), np.full(a, len(rows))
        some = k > low
        before[some] = tail[k[some] - 1]
        some = k < high
        after[some] = tail[k[some]]
        same = symbol[1:] == symbol[:-1]
        before[1:][same] = np.maximum(before[1:][same], at[:-1][same])
        after[:-1][same] = np.minimum(after[:-1][same], at[1:][same])
        follows, precedes = before >= 0, after < len(rows)
        shared = np.zeros(a, np.uint16)
        shared[follows] = (_range_least(rows, before[follows] + 1, at[follows] + 1) >> np.uint16(8)) + np.uint16(1)
        shared_after = (_range_least(rows, at[precedes] + 1, after[precedes] + 1) >> np.uint16(8)) + np.uint16(1)

        k += np.arange(a)
        place = m + k
        old = np.ones(len(rows) + a, bool)
        old[place] = False
        length += 1
        left = sizes[number] - length
        next_symbol = np.where(left > 0, data[np.maximum(ends[number] - 1 - length, 0)] + np.uint8(1), 0).astype(np.uint16)
        moved = np.flatnonzero(old)
        tail = _inserted(moved.take(tail, mode="clip"), old[m:], k, moved[at])  # all in range; clipping skips the test of it
        rows = _inserted(rows, old, place, next_symbol | (shared << np.uint16(8)))
        follower = place[precedes] + 1
        rows[follower] = (rows[follower] & np.uint16(255)) | (shared_after << np.uint16(8))
        first[1:] += np.cumsum(np.bincount(symbol, minlength=256))
        some = next_symbol != 0
        fresh, number = place[some], number[some]

    # from the empty suffixes on, each string's suffixes one symbol longer at a time
    longer = np.full(len(rows), -1, np.int32)
    longer[tail] = np.arange(m, len(rows), dtype=np.int32)
    numbers, lengths = np.empty(len(rows), np.int32), np.empty(len(rows), np.int32)
    at, number, length = np.arange(m), np.arange(m, dtype=np.int32), 0
    while len(at):
        numbers[at], lengths[at] = number, length
        at = longer[at]
        at, number, length = at[at >= 0], number[at >= 0], length + 1
    return numbers, lengths, (rows >> np.uint16(8)).astype(np.uint8)


def _inserted(x: np.ndarray, old: np.ndarray, place: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(old), x.dtype)
    out[old] = x
    out[place] = new
    return out


def _range_least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(values[begin:end]) for each pair, begin < end."""
    if not len(begin):
        return values[:0]
    turned = np.argsort(-begin, kind="stable")  # falling begins keep what lies between two ranges empty
    pairs = np.empty(2 * len(begin), np.int64)
    pairs[0::2], pairs[1::2] = begin[turned], end[turned]
    ending = pairs[1::2] == len(values)
    if ending.any():  # reduceat takes no end beyond the last index
        values = np.append(values, values.dtype.type(np.iinfo(values.dtype).max))
    out = np.empty(len(begin), values.dtype)
    out[turned] = np.minimum.reduceat(values, pairs)[0::2]
    return out


def least_owner(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each window of each string, in order: the least owner among the strings that hold it."""
    number, size, lcp = sort_collection(data, ends, sizes)
    starts = np.flatnonzero(lcp < length)
    least = np.repeat(np.minimum.reduceat(owner[number], starts), np.diff(np.append(starts, len(lcp))))
    windows = sizes - length + 1
    first = np.concatenate([[0], np.cumsum(windows)])
    out = np.empty(first[-1], np.int64)
    real = size >= length
    out[first[number[real]] + sizes[number[real]] - size[real]] = least[real]
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, start, windows) of each run of windows, at most WINDOW of them, with one anchor; start in ``data``.

    Each level orders the grams by hashes of its own.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.view(np.uint64), none, none, none
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_codes()[data] * power[:n], out=sums[1:])
    least = mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1] + np.uint64(level))
    span = 1
    while 2 * span <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WINDOW:
        least = np.minimum(least[: span - WINDOW], least[WINDOW - span :])
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = of[: len(least)] == of[LENGTH - 1 :]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (of[1 : len(least)] != of[: len(least) - 1]) | ~inside[:-1]
    begin = np.flatnonzero(change | ~inside)
    size = np.diff(np.append(begin, len(least)))
    real = inside[begin]
    begin, size = begin[real], size[real]
    parts = -(-size // WINDOW)  # a run over repeating text can be long; it is cut
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(begin, parts) + nth * WINDOW
        size = np.minimum(WINDOW, np.repeat(size, parts) - nth * WINDOW)
    return least[begin], of[begin], begin, size


def _bits(key: np.ndarray, size: int) -> list[np.ndarray]:
    h = mixed(key ^ np.uint64(0x5BD1E995))
    return [(h & np.uint64(size - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)]


def _held(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    one, two = (((table[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) for b in _bits(key, 64 * len(table)))
    return one & two


def _filter_size(keys: int) -> int:
    return min(MOST_BITS, 1 << max(12, (16 * keys).bit_length()))


def _bit_table(keys: DataFrame, n: int) -> np.ndarray:
    """A filter of ``n`` keys with two bits set for each."""
    size = _filter_size(n)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.concatenate(_bits(batch.column(0).to_numpy().view(np.uint64), size))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.int64(1), bit & 63))], ["word", "mask"])

    return bit_table(keys.select("key").mapInArrow(words, "word long, mask long"), size)


def _repeated_anchors(texts: DataFrame, bits: int, parts: int, copies) -> DataFrame:
    """The first ``bits`` bits (key) of the anchors that occur in two documents.

    Keys travel sorted, as one block for each batch and each of the 2 ** parts ranges
    of keys, and a block holds a key twice at most.
    """
    shift, low = np.uint64(64 - bits), bits - parts
    kind = np.uint32 if low <= 32 else np.uint64

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for first, _, data, offsets in steps(_first_copies(batch, copies)[2]):
                anchor, text, _, _ = anchors(data, offsets)
                keys.append(anchor >> shift)
                texts_of.append(text + first)
            key, text = np.concatenate(keys), np.concatenate(texts_of)
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")  # texts stay ascending within a key
            key, text = key[order], text[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            last = np.append(starts[1:], len(key)) - 1
            key = np.repeat(key[starts], 1 + (text[last] != text[starts]))
            part = (key >> np.uint64(low)).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            value = (key & np.uint64((1 << low) - 1)).astype(kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[begin]), pa.array([x.tobytes() for x in np.split(value, begin[1:])], pa.binary())], ["part", "block"]
            )

    def repeated(table: pa.Table) -> pa.Table:
        value = np.frombuffer(b"".join(table.column("block").to_pylist()), kind)
        value = np.sort(value)
        value = np.unique(value[1:][value[1:] == value[:-1]]).astype(np.int64)
        return pa.table({"key": value | (table.column("part")[0].as_py() << low)})

    return texts.mapInArrow(blocks, "part long, block binary").groupBy("part").applyInArrow(repeated, "key long")


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, whole (64 bits of the digest), digest and n_bytes of each text."""
    for batch in batches:
        bodies = utf8_values(pc.fill_null(batch.column("text"), ""))
        digests = [hashlib.sha256(x).digest() for x in bodies]
        columns = [batch.column("doc_id"), _whole(digests), pa.array(digests, pa.binary()), pa.array([len(x) for x in bodies], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "whole", "digest", "n_bytes"])


def _whole(digests: list[bytes]) -> pa.Array:
    return pa.array([int.from_bytes(x[:8], "little", signed=True) for x in digests], pa.int64())


def _row_key(doc_id: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return mixed(whole.astype(np.int64).view(np.uint64) ^ mixed(doc_id.astype(np.int64).view(np.uint64)))


def _row_filter(rows: DataFrame, n: int) -> np.ndarray:
    """A filter of the ``n`` rows (doc_id, whole)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _row_key(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return _bit_table(rows.select("doc_id", "whole").mapInArrow(keys, "key long"), n)


def _first_copies(batch: pa.RecordBatch, first) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """doc_id, whole and text of the rows that may be the first of their text; a few others slip through."""
    texts = pc.fill_null(batch.column("text"), "")
    whole = _whole([hashlib.sha256(x).digest() for x in utf8_values(texts)]).to_numpy()
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    kept = _held(first.value, _row_key(ids, whole))
    return ids[kept], whole[kept], texts.filter(pa.array(kept))


#: An occurrence: where a string stands.  ``part`` is 0, or the anchor of the string that was cut again, whose
#: owner is then ``doc_id`` and whose number ``whole``.
OCCURRENCE = "anchor long, doc_id long, whole long, part long, start int, windows int, string binary"


def _runs(columns: list[np.ndarray], data: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    size = windows + LENGTH - 1
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    strings = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[take])])
    kinds = [pa.int64()] * 4 + [pa.int32()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(windows, pa.int32()), strings], [x.split()[0] for x in OCCURRENCE.split(", ")])


def _strings(texts: DataFrame, bits: int, copies, repeated) -> DataFrame:
    """The occurrences of the runs whose anchor is repeated, by the filter."""
    shift = np.uint64(64 - bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, whole, kept = _first_copies(batch, copies)
            for first, _, data, offsets in steps(kept):
                anchor, text, start, windows = anchors(data, offsets)
                key = anchor >> shift
                wanted = _held(repeated.value, key)
                key, text, start, windows = key[wanted], text[wanted], start[wanted], windows[wanted]
                own = first + text
                yield _runs([key.view(np.int64), ids[own], whole[own], np.zeros(len(own), np.int64), start - offsets[text]], data, start, windows)

    return texts.mapInArrow(cut, OCCURRENCE)


def _cut_again(owners: DataFrame, level: int) -> DataFrame:
    """The occurrences, within the strings of crowded anchors, of runs by the anchors of the next level."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, sid, owner = (batch.column(i).to_numpy() for i in range(3))
            data, offsets = flat_utf8(batch.column(3))
            anchor, text, start, windows = anchors(data, offsets, level)
            key = mixed(anchor ^ mixed(of[text].view(np.uint64)))
            yield _runs([key.view(np.int64), owner[text], sid[text], of[text], start - offsets[text]], data, start, windows)

    return owners.select("anchor", "sid", "owner", "string").mapInArrow(cut, OCCURRENCE)


def _sorted_shard(table: pa.Table) -> pa.Table:
    """(anchor, sid, owner, runs): of each string the windows that a string of a smaller document has too."""
    coded = table.column("string").combine_chunks().dictionary_encode()
    number = coded.indices.to_numpy()
    data, at = flat_utf8(coded.dictionary)
    n = len(at) - 1
    anchor, sid, owner = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, LAST)
    anchor[number], sid[number] = table.column("anchor").to_numpy(), table.column("sid").to_numpy()
    np.minimum.at(owner, number, table.column("owner").to_numpy())

    # collections of whole anchors
    order = np.argsort(anchor, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])).tolist()
    cuts, last = [0], 0
    for b in [*new[1:], n]:
        if b - cuts[-1] > COLLECTION and last > cuts[-1]:
            cuts.append(last)
        last = b
    cuts.append(n)
    anchors_of, sids, owners, starts, sizes, counts = [], [], [], [], [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        size = at[own + 1] - at[own]
        windows = size - LENGTH + 1
        least = least_owner(data, at[own + 1], size, owner[own], LENGTH)
        row = np.repeat(np.arange(len(own)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        again = least < owner[own][row]
        edge = row[1:] != row[:-1]
        begin, end = again.copy(), again.copy()
        begin[1:] &= ~again[:-1] | edge
        end[:-1] &= ~again[1:] | edge
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
        runs_of = np.bincount(row[begin], minlength=len(own))
        some = runs_of > 0
        anchors_of.append(anchor[own][some])
        sids.append(sid[own][some])
        owners.append(owner[own][some])
        starts.append(nth[begin])
        sizes.append(end - begin + 1)
        counts.append(runs_of[some])
    runs = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int32()) for x in (starts, sizes)], ["at", "n"])
    ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return pa.table(
        {
            "anchor": np.concatenate(anchors_of), "sid": np.concatenate(sids), "owner": np.concatenate(owners),
            "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs),
        }
    )


def _of_several(occurrences: DataFrame, several: DataFrame, n: int) -> DataFrame:
    """(anchor, sid, owner, string) of the owners among the occurrences, by a filter; a few others slip through."""

    def key_of(anchor: np.ndarray, sid: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        return mixed(anchor.view(np.uint64) ^ mixed(sid.view(np.uint64) ^ mixed(doc_id.view(np.uint64))))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(key_of(*(c.to_numpy() for c in batch.columns)).view(np.int64))], ["key"])

    table = _bit_table(several.select("anchor", "sid", "owner").mapInArrow(keys, "key long"), n)
    wanted = occurrences.sparkSession.sparkContext.broadcast(table)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = key_of(*(batch.column(i).to_numpy() for i in range(3)))
            _, first = np.unique(key, return_index=True)  # a document can hold a string many times
            yield batch.take(pa.array(np.sort(first[_held(wanted.value, key[first])])))

    return occurrences.select("anchor", "sid", F.col("doc_id").alias("owner"), "string").mapInArrow(
        owned, "anchor long, sid long, owner long, string binary"
    )


def _repeats(found: DataFrame, work: Workspace, level: int = 0) -> DataFrame:
    """(doc_id, whole, part, start, windows): the runs of windows that a smaller document holds too."""
    occurrences = work.write(found.withColumn("sid", F.xxhash64("string")), f"strings{level}")
    strings = occurrences.groupBy("anchor", "sid").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most"))
    strings = work.write(strings, f"owners{level}")
    held = strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = work.write(held, f"held{level}")
    n, most = held.agg(F.sum("n"), F.max("n")).first()
    again = [strings.filter("owner < most").select("anchor", "sid", "owner", F.lit(None).cast("array<struct<at:int,n:int>>").alias("runs"))]
    if n:
        owners = _of_several(occurrences, strings.join(held, "anchor", "left_semi"), n)
        if most > CROWDED and level < LEVELS:
            crowded = held.filter(F.col("n") > CROWDED).select("anchor")
            cut = _repeats(_cut_again(owners.join(crowded, "anchor", "left_semi"), level + 1), work, level + 1)
            run = F.struct(F.col("start").alias("at"), F.col("windows").alias("n"))
            again.append(
                cut.groupBy(F.col("part").alias("anchor"), F.col("whole").alias("sid"), F.col("doc_id").alias("owner")).agg(F.collect_list(run).alias("runs"))
            )
            owners = owners.join(crowded, "anchor", "left_anti")
        shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, n // SHARD_ROWS)))
        again.append(
            owners.withColumn("shard", shard).groupBy("shard")
            .applyInArrow(_sorted_shard, "anchor long, sid long, owner long, runs array<struct<at:int,n:int>>")
        )
    # a table of its own, so that the join can be split where one string has many occurrences
    known = work.write(reduce(DataFrame.unionByName, again), f"known{level}")
    whole_run = F.array(F.struct(F.lit(0).alias("at"), F.col("windows").alias("n")))
    runs = F.when(F.col("runs").isNull(), whole_run).otherwise(F.col("runs"))
    gone = (
        occurrences.drop("string").join(known, ["anchor", "sid"])
        .filter(F.when(F.col("runs").isNull(), F.col("doc_id") > F.col("owner")).otherwise(F.col("doc_id") == F.col("owner")))
        .select("doc_id", "whole", "part", "start", F.explode(runs).alias("r"))
    )
    gone = work.write(gone.select("doc_id", "whole", "part", (F.col("start") + F.col("r.at")).alias("start"), F.col("r.n").alias("windows")), f"gone{level}")
    for name in ("strings", "owners", "held", "known"):
        work.drop(f"{name}{level}")
    return gone


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(utf8_values(pc.fill_null(batch.column("text"), "")), batch.column("runs").to_pylist(), strict=True):
            kept, removed, spans, at = [], 0, 0, 0
            for r in sorted(runs or (), key=lambda r: r["start"]):
                begin, end = r["start"], r["start"] + r["windows"] + LENGTH - 1
                if begin > at or not spans:
                    kept.append(text[at:begin])
                    spans += 1
                    at = begin
                if end > at:
                    removed += end - at
                    at = end
            kept.append(text[at:])
            out.append((len(text), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc_id"), docs["text"].cast("string").alias("text"))


def repeated_spans(docs: DataFrame, work: Workspace, first: DataFrame) -> DataFrame:
    """(doc_id, whole, runs): the windows of each first copy that a smaller doc_id has too."""
    context = docs.sparkSession.sparkContext
    texts = _texts(docs)
    documents, size = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    copies = context.broadcast(_row_filter(first, documents))
    bits = min(63, max(32, (size // 13).bit_length() + 7))  # about one anchor in 14 bytes; under 1 in 100 meets another
    parts = min(16, (size // 13 // KEYS_OF_PART).bit_length())
    anchored = work.write(_repeated_anchors(texts, bits, parts, copies), "anchors")
    n = anchored.count()
    found = _strings(texts, bits, copies, context.broadcast(_bit_table(anchored, n)))
    if _filter_size(n) == MOST_BITS:
        found = found.join(anchored.withColumnRenamed("key", "anchor"), "anchor", "left_semi")
    spans = _repeats(found, work).groupBy("doc_id", "whole").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    # what slipped through the filter of first copies goes whole all the same
    return work.write(spans.join(first.select("doc_id", "whole"), ["doc_id", "whole"], "left_semi"), "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    work = Workspace(docs.sparkSession, "column-bwt")
    rows = work.write(_texts(docs).mapInArrow(_identities, "doc_id long, whole long, digest binary, n_bytes long"), "rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("whole").alias("whole"), F.first("n_bytes").alias("n_bytes"))
    first = work.write(first, "first")
    spans = repeated_spans(docs, work, first)

    # a row of another doc_id than the first one's goes whole: all its bytes stand there
    copies = rows.join(first.select("digest", F.col("doc_id").alias("first_id")), "digest")
    whole = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= LENGTH)
    untouched = copies.join(spans.select("doc_id", "whole"), ["doc_id", "whole"], "left_anti")
    settled = copies.filter("doc_id > first_id").unionByName(untouched.filter("doc_id = first_id").select(*copies.columns)).select(
        F.nullif(F.col("doc_id"), F.lit(LAST)).alias("doc_id"), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        whole.cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
    )

    # the texts of the others alone are dealt out
    some = docs.sparkSession.sparkContext.broadcast(_row_filter(spans, spans.count()))

    def with_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole([hashlib.sha256(x).digest() for x in utf8_values(pc.fill_null(batch.column("text"), ""))])
            held = _held(some.value, _row_key(batch.column("doc_id").to_numpy(), whole.to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns, whole], ["doc_id", "text", "whole"]).filter(pa.array(held))

    texts = _texts(docs).mapInArrow(with_whole, "doc_id long, text string, whole long")
    cut = texts.join(spans, ["doc_id", "whole"]).select(F.nullif(F.col("doc_id"), F.lit(LAST)).alias("doc_id"), "text", "runs").mapInArrow(
        _cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return cut.unionByName(settled)
