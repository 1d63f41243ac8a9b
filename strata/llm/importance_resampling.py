"""Quality by importance resampling.

Two generative models over hashed token n-grams, one of target text (labelled
good) and one of the raw text (all documents), give each document a log
importance weight: the sum over its n-grams of log p_target - log p_raw.  Adding
Gumbel noise to the weights and keeping the k greatest draws k documents without
replacement in proportion to their weights.  By default k is the raw table's
size times the good share among the labels, two standard errors added, so that
chance in the labels costs no good document.

The target model is fitted on at most ``FIT_ROWS`` labelled documents; the raw
model counts every document.  Both are smoothed with ``SMOOTH`` per bucket.

Defined results: null and empty texts weigh 0; rows that repeat or share a
doc_id have the same weight and noise; rows whose noisy weight ties with the
k-th stay; without good labels all weights are 0 and every document stays; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.codes import byte_codes, mixed, steps, token_hashes, word_or_mark_classes
from strata.llm.common import Workspace

BUCKETS = 1 << 16
FIT_ROWS = 20_000
SMOOTH = 1.0
SEED = 17


def _grams(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every token and every pair of adjacent tokens."""
    hashes, at = token_hashes(data, offsets, kinds, codes)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = of[1:] == of[:-1]
    pairs = mixed(hashes[:-1] * np.uint64(31) + hashes[1:])[same]
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([hashes & mask, pairs & mask]).astype(np.int64), np.concatenate([of, of[1:][same]])


def _models(docs: DataFrame, good: set[int]) -> np.ndarray:
    """The log ratio of the two models for each bucket."""
    target = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, codes = word_or_mark_classes(), byte_codes()
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            chosen = np.array([x in target.value for x in batch.column(0).to_pylist()], bool)
            for first, last, data, offsets in steps(batch.column(1)):
                gram, of = _grams(data, offsets, kinds, codes)
                counts[0] += np.bincount(gram, minlength=BUCKETS)
                counts[1] += np.bincount(gram[chosen[first:last][of]], minlength=BUCKETS)
        held = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[0][held]), pa.array(counts[1][held])], ["bucket", "raw", "target"])

    rows = (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
        .mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .collect()
    )
    counts = np.full((2, BUCKETS), SMOOTH)
    for r in rows:
        counts[0, r.bucket] += r.raw
        counts[1, r.bucket] += r.target
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    return logs[1] - logs[0]


def gumbel(seed: int, *columns: Column) -> Column:
    """Standard Gumbel noise that depends on the seed and the columns alone."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def kth_greatest(values: DataFrame, k: int, hold: int = 20_000) -> float | None:
    """The k-th greatest of one double column, by histograms over ever smaller ranges."""
    name = values.columns[0]
    low, high, n = values.agg(F.min(name), F.max(name), F.count(name)).first()
    if not 0 < k <= n:
        return None
    while n > hold and low < high:
        width = (high - low) / 1000
        bins = values.filter(F.col(name).between(low, high)).groupBy(F.floor((F.col(name) - low) / width).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")
        )
        for r in sorted(bins.collect(), key=lambda r: -r.bin):
            if k <= r.n:
                low, high, n = r.low, r.high, r.n
                break
            k -= r.n
    if low == high:
        return low
    inside = sorted((r[0] for r in values.filter(F.col(name).between(low, high)).collect()), reverse=True)
    return inside[k - 1]


def _weigher(ratio, column: int, keep_all: bool):
    """Append log_weight to each batch (or return doc_id and log_weight alone)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, codes = word_or_mark_classes(), byte_codes()
        for batch in batches:
            weights = np.zeros(batch.num_rows)
            for first, last, data, offsets in steps(batch.column(column)):
                gram, of = _grams(data, offsets, kinds, codes)
                weights[first:last] = np.bincount(of, ratio.value[gram], minlength=last - first)
            columns = batch.columns if keep_all else [batch.column(0)]
            names = batch.schema.names if keep_all else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weights)], [*names, "log_weight"])

    return weigh


def _fit(docs: DataFrame, labels: DataFrame, seed: int):
    """The broadcast log ratios, and the share to keep (None if no label is good)."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    fit = marks.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(FIT_ROWS).select("doc_id", "quality").collect()
    good = {int(r.doc_id) for r in fit if r.quality == 1}
    n, positive = marks.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    share = positive / max(1, n)
    share = min(1.0, share + 2 * math.sqrt(share * (1 - share) / max(1, n)))
    ratio = docs.sparkSession.sparkContext.broadcast(_models(docs, good) if good else np.zeros(BUCKETS))
    return ratio, share if good else None


def _resample(docs: DataFrame, labels: DataFrame, keep: int | None, seed: int):
    """(weights with noise, the broadcast log ratios, the least noisy weight that stays or None for all)."""
    ratio, share = _fit(docs, labels, seed)
    weighed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        _weigher(ratio, 1, keep_all=False), "doc_id long, log_weight double"
    )
    weighed = Workspace(docs.sparkSession, "resample").write(
        weighed.withColumn("noisy_weight", F.col("log_weight") + gumbel(seed, F.col("doc_id"))), "weights"
    )
    if keep is None and share is not None:
        keep = math.ceil(weighed.count() * share)
    if keep is not None and keep <= 0:
        return weighed, ratio, math.inf
    return weighed, ratio, kth_greatest(weighed.select("noisy_weight"), keep) if keep is not None else None


def resample(docs: DataFrame, labels: DataFrame, keep: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, log_weight, noisy_weight, kept."""
    weighed, _, least = _resample(docs, labels, keep, seed)
    return weighed.withColumn("kept", F.lit(True) if least is None else F.col("noisy_weight") >= F.lit(least))


def keep_resampled(docs: DataFrame, labels: DataFrame, keep: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents of ``docs`` that resampling draws, with all their columns.

    The texts are weighed once more where they are read, so none is shuffled.
    """
    _, ratio, least = _resample(docs, labels, keep, seed)
    if least is None:
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]  # the columns' own names may clash with ours
    plain = docs.toDF(*names)
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    plain = plain.withColumn(text, F.col(text).cast("string"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    weighed = plain.mapInArrow(_weigher(ratio, names.index(text), keep_all=True), f"{fields}, log_weight double")
    stays = F.col("log_weight") + gumbel(seed, F.col(doc_id).cast("long")) >= F.lit(least)
    return weighed.filter(stays).select(*names).toDF(*docs.columns)
