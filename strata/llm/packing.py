"""Cost-balanced packing of token sequences.

A sequence costs ``linear * tokens + quadratic * sum(piece ** 2)``: the attention
of packed pieces stays within each piece.  Every document is tokenised once;
whole runs of ``capacity`` tokens are sequences of their own, and what is left of
each document is packed.  The rest pieces are dealt to shards of about
``shard_sequences`` sequences; a shard opens as many sequences as its tokens
need and assigns its pieces in descending order to the sequence of lowest cost
that has the capacity left.  Where none has, the piece is cut and fills the
sequence of lowest cost that has room, so at most the last sequence of a shard
is padded.

Defined results: null text is empty and has the closing id alone; rows that
repeat, or share or lack a doc_id, are packed each for itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Workspace
from strata.llm.pretokens import PartIds

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Sequences:
    """Open sequences by the room they have left, each room with the cheapest first."""

    def __init__(self, count: int, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.rooms: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.best: list[tuple[float, int, int] | None] = [None] * (2 * self.size)
        self.rooms[capacity] = [(0.0, i) for i in range(count)]
        self._refresh(capacity)

    def _refresh(self, room: int) -> None:
        heap = self.rooms[room]
        at = room + self.size
        self.best[at] = (*heap[0], room) if heap else None
        while at > 1:
            at //= 2
            a, b = self.best[2 * at], self.best[2 * at + 1]
            self.best[at] = b if a is None else a if b is None else min(a, b)

    def cheapest(self, least: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest with at least that much room."""
        found, at = self.best[least + self.size], least + self.size
        while at > 1:
            if at % 2 == 0 and (b := self.best[at + 1]) is not None and (found is None or b < found):
                found = b
            at //= 2
        return found

    def move(self, room: int, to: int, cost: float) -> None:
        _, sequence = heappop(self.rooms[room])
        self._refresh(room)
        if to:
            heappush(self.rooms[to], (cost, sequence))
            self._refresh(to)


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, start within it, length, sequence, offset) for pieces of at most ``capacity`` tokens."""
    count = -(-sum(lengths) // capacity)
    open_ = Sequences(count, capacity)
    placed = []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        done = 0
        while done < lengths[piece]:
            rest = lengths[piece] - done
            cost, sequence, room = open_.cheapest(rest) or open_.cheapest(1)
            take = min(rest, room)
            placed.append((piece, done, take, sequence, capacity - room))
            open_.move(room, room - take, cost + linear * take + quadratic * take * take)
            done += take
    return placed


def _pieces(docs: DataFrame, vocabulary: str, capacity: int, closing: int) -> DataFrame:
    """One row for each full run and each rest; a rest carries its ids, two bytes each if they fit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PartIds(vocabulary)
        end = closing.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = known.ids(text or "") + end
                tokens = len(ids) // 4
                for start in range(0, tokens, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    rest = None if len(own) == 4 * capacity else narrow(own)
                    out.append((doc_id, start, len(own) // 4, crc32(own), tokens, rest))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rest binary"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        cut, schema
    )


def narrow(ids: bytes) -> bytes:
    """A width byte, then the ids in two bytes each if all fit, else in four."""
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if len(wide) and wide.max() < 1 << 16 else b"\4" + ids


def widen(rest: bytes) -> bytes:
    return np.frombuffer(rest, "<u2", offset=1).astype("<u4").tobytes() if rest[0] == 2 else rest[1:]


def pack(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    closing: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
    shard_sequences: int = 2000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    work = Workspace(docs.sparkSession, "packing")
    # written once: row numbers and so shards stay the same whatever is run again
    pieces = work.write(_pieces(docs, vocabulary, capacity, closing).withColumn("row", F.monotonically_increasing_id()), "pieces")
    rests = pieces.filter("rest IS NOT NULL")
    tokens = rests.agg(F.sum("length")).first()[0] or 0
    shards = max(1, round(tokens / (capacity * shard_sequences)))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        at = assign(rows["length"].tolist(), capacity, linear, quadratic)
        out = []
        for piece, done, length, sequence, offset in at:
            ids = widen(rows["rest"][piece])[4 * done : 4 * (done + length)]
            out.append(
                (rows["doc_id"][piece], rows["start"][piece] + done, length, crc32(ids), rows["doc_tokens"][piece], (key[0] << 33) + 2 * sequence, offset)
            )
        found = pd.DataFrame(out, columns=[x.split()[0] for x in PIECE.split(", ")])
        found["doc_id"] = found["doc_id"].astype("Int64")
        return found

    packed = (
        rests.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInPandas(place, PIECE)
    )
    full = pieces.filter("rest IS NULL").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(packed)
