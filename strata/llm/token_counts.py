"""Token counts from distinct pre-tokens.

Each document is reduced to its pre-token frequencies.  A pre-token's pieces are
counted once: the common ones (a head learned from a bounded sample, at most
``HEAD_SIZE`` strings of at most ``HEAD_CHARS`` characters, so at most a few MB)
before the pass and handed to every task, all others once each after a shuffle
by the pre-token, from where their counts are joined to the per-document
frequencies and summed.  No document's ids are ever built.  A text is cut at its
spaces, and each part into pre-tokens once; where white space or special strings
keep it from being cut so, the whole text is cut into pre-tokens, and each
special string is one token.

Defined results: null and empty texts have no tokens; rows that repeat or share
or lack a doc_id each get their own count; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
import os

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Workspace
from strata.llm.pretokens import library, pretokens, space_parts, special_strings, splitter

VOCABULARY = "byte_bpe_50k.json"
SAMPLE_DOCS = 6_000
HEAD_SIZE = 150_000
HEAD_CHARS = 48
PARTS_KEPT = 300_000


def _head(docs: DataFrame, vocabulary: str) -> dict[str, int]:
    """Pre-tokens that at least two documents of the sample hold, with their piece counts."""
    rows = docs.count()
    sample = docs.select(docs["text"].cast("string").alias("text")).sample(min(1.0, SAMPLE_DOCS / max(1, rows)), seed=9)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = splitter().findall
        for batch in batches:
            seen = Counter(w for t in batch.column(0).to_pylist() for w in set(cut(t or "")) if len(w) <= HEAD_CHARS)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n"])

    common = (
        sample.mapInArrow(held, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1")
        .orderBy(F.desc("n"), "piece").limit(HEAD_SIZE).select("piece")
    )
    return {r.piece: r.pieces for r in common.mapInArrow(_counter(vocabulary), "piece string, pieces int").collect()}


def _counter(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core and no more
        encode = library(vocabulary).encode_batch_fast
        for batch in batches:
            pieces = [len(x.ids) for x in encode(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.int32())], ["piece", "pieces"])

    return count


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens above ``limit``)."""
    spark = docs.sparkSession
    work = Workspace(spark, "token-counts")
    head = spark.sparkContext.broadcast(_head(docs, vocabulary))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, specials, common = splitter().findall, special_strings(vocabulary), head.value
        parts: dict[str, tuple[int, tuple[str, ...]]] = {}  # a part's common pieces, summed, and its other pre-tokens
        for batch in batches:
            sums, rare_of, times_of = [], [], []
            for text in batch.column("text").to_pylist():
                own = space_parts(text or "", specials)
                if own is None:
                    words, known = pretokens(text, vocabulary)
                    rare = Counter()
                    for w, times in Counter(words).items():
                        if w in common:
                            known += times * common[w]
                        else:
                            rare[w] += times
                    sums.append(known)
                    rare_of.append(list(rare) or None)
                    times_of.append(list(rare.values()) or None)
                    continue
                known, rare = 0, Counter()
                held = Counter(own[1:])
                held_first = own[0]
                for part, times in [*held.items(), (None, 1)]:
                    found = parts.get(part) if part is not None else None
                    if found is None:
                        words = cut(" " + part if part is not None else held_first)
                        found = (sum(common.get(w, 0) for w in words), tuple(w for w in words if w not in common))
                        if part is not None and len(parts) < PARTS_KEPT:
                            parts[part] = found
                    known += times * found[0]
                    for w in found[1]:
                        rare[w] += times
                sums.append(known)
                rare_of.append(list(rare) or None)
                times_of.append(list(rare.values()) or None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pc.cast(pc.binary_length(pc.fill_null(batch.column("text"), "")), pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(rare_of, pa.list_(pa.string())),
                    pa.array(times_of, pa.list_(pa.int32())),
                ],
                ["doc_id", "n_bytes", "known", "rare", "times"],
            )

    schema = "doc_id long, n_bytes long, known long, rare array<string>, times array<int>"
    reduced = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        frequencies, schema
    )
    # written once, so that the texts are read once and row numbers last
    reduced = work.write(reduced.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rare = reduced.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select(
        "row", F.col("p.rare").alias("piece"), F.col("p.times").alias("times")
    )
    counted = rare.select("piece").distinct().mapInArrow(_counter(vocabulary), "piece string, pieces int")
    more = rare.join(counted, "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = (F.col("known") + F.coalesce("more", F.lit(0))).cast("long")
    return reduced.join(more, "row", "left").select(
        "doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit")
    )
