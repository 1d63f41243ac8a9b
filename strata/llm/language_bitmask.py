"""Language identification with bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: each slot holds a mask with
one bit per language, so that the AND of an n-gram's slots names every language
that contains it.  A document's votes are per-language popcounts over its
4-byte grams (A-Z folded, every byte that is no letter a space); each is
corrected for the filter's false positives, which its fill gives, and the
greatest share wins.

The filters are learned from about ``FIT_DOCS`` documents of each language at most
(each is drawn with that probability, by a hash of its text).  A
language contains a gram that it shows at least ``LEAST`` times and at least
``RELATIVE`` times as often as the language that shows it most.  What goes to
the driver and is broadcast is at most ``SLOTS`` masks.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with score 0;
ties go to the language first by code point; if no gram is known, the language
with most documents is given with score 0; without any learned language all is
``und``; rows that repeat each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
import regex

from strata.llm.codes import mixed, steps
from strata.llm.common import Workspace

SLOTS = 1 << 20
HASHES = 3
FIT_DOCS = 3_000
LEAST = 3
RELATIVE = 0.25
LETTER = regex.compile(r"\p{L}")
_BLANK = 0x20202020


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letters_only() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def grams(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte grams of all texts, each padded with three spaces, and the text of each."""
    sizes = np.diff(offsets)
    padded = np.full(len(data) + 3 * (len(sizes) + 1), 32, np.uint8)
    of = np.repeat(np.arange(len(sizes)), sizes)
    padded[np.arange(len(data)) + 3 * (of + 1)] = table[data]
    wide = padded.astype(np.uint32)
    gram = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    text = np.repeat(np.arange(len(sizes) + 1), np.append(sizes + 3, 0))[: len(gram)]
    real = gram != _BLANK
    return gram[real], text[real]


def slots_of(gram: np.ndarray) -> np.ndarray:
    """The slots of each gram, one row per hash."""
    h = mixed(gram.astype(np.uint64) + np.uint64(1))
    return np.stack([(h >> np.uint64(21 * i)) & np.uint64(SLOTS - 1) for i in range(HASHES)]).astype(np.int64)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, str]:
    """The languages by code point, their bit-sliced filters, and the language with most documents."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")
    )
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: x.encode())
    if not languages:
        return [], np.zeros((1, SLOTS), np.uint64), ""
    # drawn by a hash of the text: the same rows however the table is cut into files
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, FIT_DOCS / n))))
    drawn = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 32)) < F.element_at(share, F.col("lang")) * float(1 << 32)
    sample = known.filter(drawn)
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters_only()
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for first, last, data, offsets in steps(batch.column(1)):
                gram, of = grams(data, offsets, table)
                key, n = np.unique((lang[first:last][of] << 32) | gram.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = Workspace(docs.sparkSession, "language").write(counts, "counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.element_at(F.create_map(*(F.lit(x) for kv in totals.items() for x in kv)), F.col("lang"))
    most = counts.withColumn("rate", rate).groupBy("gram").agg(
        F.max("rate").alias("most"), F.collect_list(F.struct("lang", "n", "rate")).alias("in")
    )
    contained = most.select("gram", "most", F.explode("in").alias("x")).filter(
        f"x.n >= {LEAST} AND x.rate >= {RELATIVE} * most"
    ).select("gram", F.col("x.lang").alias("lang"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = slots_of(batch.column(0).to_numpy())
            lang = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.ravel()), pa.array(np.tile(lang >> 6, HASHES)), pa.array(np.tile(np.int64(1) << (lang & 63), HASHES))],
                ["slot", "plane", "mask"],
            )

    masks = contained.mapInArrow(slots, "slot long, plane long, mask long").groupBy("slot", "plane").agg(F.bit_or("mask").alias("mask"))
    table = np.zeros((1 + (len(languages) - 1) // 64, SLOTS), np.uint64)
    rows = masks.toPandas()
    table[rows["plane"].to_numpy(np.int64), rows["slot"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return languages, table, max(languages, key=lambda x: sizes[x])


def predict(docs: DataFrame, languages: list[str], table: np.ndarray, commonest: str) -> DataFrame:
    """docs with held_out, lang_pred and score; reads doc_id (for held_out) and text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, masks = letters_only(), shared.value
        fill = np.array([((masks[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean() for i in range(len(languages))])
        false = fill**HASHES
        for batch in batches:
            texts = batch.column(1)
            shares = np.zeros((len(languages), batch.num_rows))
            for first, last, data, offsets in steps(texts):
                gram, of = grams(data, offsets, fold)
                n = np.maximum(1, np.bincount(of, minlength=last - first))
                at = slots_of(gram)
                for plane, mask in enumerate(masks):
                    held = mask[at[0]]
                    for other in at[1:]:
                        held &= mask[other]
                    for i in range(64 * plane, min(len(languages), 64 * (plane + 1))):
                        bit = ((held >> np.uint64(i & 63)) & np.uint64(1)).astype(np.float64)
                        hits = np.bincount(of, bit, minlength=last - first) / n
                        shares[i, first:last] = np.maximum(0, (hits - false[i]) / (1 - false[i]))
            total = shares.sum(axis=0)
            names, scores = [], []
            for j, text in enumerate(texts.to_pylist()):
                if not languages or text is None or not LETTER.search(text):
                    names.append("und")
                    scores.append(0.0)
                elif total[j] == 0:
                    names.append(commonest)
                    scores.append(0.0)
                else:
                    best = int(shares[:, j].argmax())
                    names.append(languages[best])
                    scores.append(float(shares[best, j] / total[j]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), held_out(docs["doc_id"]).alias("held_out")
    ).mapInArrow(decide, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict for all."""
    return predict(docs, *learn(docs.filter(~held_out(docs["doc_id"]))))
