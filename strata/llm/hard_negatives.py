"""Hard negatives by inner product, from k-means inverted lists with radii.

Every vector stands in the list of its nearest centroid; a list is kept in blocks of
``BLOCK`` rows at most, each with the greatest distance of its rows from the centroid.
By Cauchy-Schwarz the score of an anchor a with any row of a block lies within
<a, c> - |a| r and <a, c> + |a| r, so a block whose range misses a search's window of
scores is skipped, and a search is over for a block whose upper bound is strictly
below the k-th score that is known (strictly, because ties go by the smaller id).

Anchors are searched for in waves of ``WAVE``, each against all blocks where they
lie: the wave is sent to the blocks, no vector is shuffled again.  A wave has two
rounds.  The first visits the ``FIRST`` lists of highest bound of each search, which
gives it a k-th score; the second visits whatever the bounds leave, and its tasks
raise that score by what they find themselves.  Positives come first, as their scores
are the windows of the searches for negatives, one for each anchor and positive.

The centroids are fitted to a sample of ``FIT_ROWS`` rows a cluster (drawn by a hash of
the id); every row is indexed, and the result does not depend on them.  A list that
the sample says is large is dealt out by ``ROWS_OF_TASK`` rows.

Defined results: rows without an id, a label or a vector, or with a component that is
null, take no part; of rows that share an id the least label, then vector counts, once;
shorter vectors are as if filled up with zeros; an anchor without another row of its
label, or without rows in its window, gives no row; an empty table gives an empty
result; other columns are ignored.  Scores that 63 bits cannot hold are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import Workspace

POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT = 30
HIGH_PERCENT = 90
#: Clusters at most, sampled rows of a cluster, rounds of k-means.
CLUSTERS = 1_024
FIT_ROWS = 48
FIT_ROUNDS = 6
BLOCK = 1_024
ROWS_OF_TASK = 65_536
#: Anchors of a wave (16,384 vectors of 64 components are 8 MB), and lists of the first round.
WAVE = 16_384
FIRST = 4
#: Searches of one product, and rows found after which a task keeps the best alone.
SEARCHES = 512
HELD = 200_000

FOUND = "search long, anchor_id long, positive_id long, positive_score long, score long, vec_id long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list array as rows of ``dim`` whole numbers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def fit(sample: np.ndarray, clusters: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids of a bounded sample by Lloyd's rounds; an empty cluster keeps its centroid."""
    sample = sample.astype(np.float64)
    centroids = sample[np.random.default_rng(12).permutation(len(sample))[:clusters]]
    for _ in range(rounds):
        near = nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centroids)
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(axis=1) - 2.0 * (rows @ centroids.T)).argmin(axis=1)


def _blocks(vectors: DataFrame, centroids: np.ndarray, salts: np.ndarray) -> DataFrame:
    """The inverted lists: cluster, radius, norm, ids, labels and components of up to ``BLOCK`` rows."""
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, salts))
    dim = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, salts = shared.value
        for batch in batches:
            rows = matrix(batch.column(2), dim)
            near = nearest(rows.astype(np.float64), centroids)
            ids = batch.column(0).to_numpy()
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % salts[near]
            kept = [r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near), pa.array(salt), pa.array(kept, pa.binary())], ["vec_id", "label", "cluster", "salt", "row"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, _ = shared.value
        ids, labels, clusters, rows = (np.zeros(0, np.int64),) * 3 + ([],)

        def block(n: int) -> pa.RecordBatch:
            held = np.frombuffer(b"".join(rows[:n]), np.int64).reshape(n, dim)
            apart = np.sqrt(((held - centroids[clusters[0]]) ** 2).sum(axis=1).max())
            norm = np.sqrt((held.astype(np.float64) ** 2).sum(axis=1).max())
            small = held.astype(np.int16)
            kind = small if np.array_equal(small, held) else held
            values = [int(clusters[0]), float(apart), float(norm), ids[:n].tobytes(), labels[:n].tobytes(), kind.dtype.str, kind.tobytes()]
            return pa.RecordBatch.from_pylist([dict(zip(BLOCKS.names, values, strict=True))], schema=BLOCKS)

        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            labels = np.concatenate([labels, batch.column(1).to_numpy()])
            clusters = np.concatenate([clusters, batch.column(2).to_numpy()])
            rows = rows + batch.column(3).to_pylist()
            while len(ids) and (len(ids) > BLOCK or clusters[-1] != clusters[0]):
                n = min(BLOCK, int(np.searchsorted(clusters, clusters[0], side="right")))
                yield block(n)
                ids, labels, clusters, rows = ids[n:], labels[n:], clusters[n:], rows[n:]
        if len(ids):
            yield block(len(ids))

    assigned = vectors.select("vec_id", "label", "v").mapInArrow(assign, "vec_id long, label long, cluster long, salt long, row binary")
    dealt = assigned.repartition("cluster", "salt").sortWithinPartitions("cluster", "salt").select("vec_id", "label", "cluster", "row")
    return dealt.mapInArrow(gather, "cluster long, radius double, norm double, ids binary, labels binary, kind string, components binary")


BLOCKS = pa.schema(
    [
        ("cluster", pa.int64()), ("radius", pa.float64()), ("norm", pa.float64()), ("ids", pa.binary()),
        ("labels", pa.binary()), ("kind", pa.string()), ("components", pa.binary()),
    ]
)


@dataclass
class Searches:
    """Searches of one wave: for each the anchor's place, its window of scores, and the k-th score known."""

    ids: np.ndarray  # of the wave's anchors
    labels: np.ndarray
    rows: np.ndarray
    anchor: np.ndarray  # of each search, a place among the anchors
    low: np.ndarray
    high: np.ndarray
    same: bool  # rows of the anchor's label, or of others
    k: int
    kth: np.ndarray
    first: np.ndarray  # the lists of the first round
    positive: np.ndarray
    positive_score: np.ndarray

    def visit_first(self, centroids: np.ndarray, radii: np.ndarray) -> None:
        """The FIRST lists of highest upper bound that the window does not exclude; -1 where there are fewer."""
        self.first = np.full((len(self.anchor), min(FIRST, len(radii))), -1)
        for i in range(0, len(self.anchor), SEARCHES):
            part = slice(i, i + SEARCHES)
            low, high = bounds(self.rows[self.anchor[part]], centroids, radii)
            upper = np.where((low <= self.high[part, None]) & (high >= self.low[part, None]), high, -np.inf)
            best = np.argpartition(-upper, self.first.shape[1] - 1, axis=1)[:, : self.first.shape[1]]
            self.first[part] = np.where(np.isneginf(np.take_along_axis(upper, best, axis=1)), -1, best)


def bounds(rows: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that rows within the radii can have, with room for rounding."""
    rows = rows.astype(np.float64)
    middle = rows @ centroids.T
    norms = np.sqrt((rows * rows).sum(axis=1))[:, None]
    reach = norms * radii
    reach = reach + 1e-9 * (1 + reach + norms * np.sqrt((centroids * centroids).sum(axis=1)))
    return middle - reach, middle + reach


def best_of(search: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k first rows of each search, by score, then id, and of those that are a k-th."""
    order = np.lexsort((ids, -score, search))
    starts = np.concatenate([[True], search[order][1:] != search[order][:-1]])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[rank < k], order[rank == k - 1]


def _search(blocks: DataFrame, wave: Searches, centroids: np.ndarray, first: bool) -> DataFrame:
    """The k best rows of each search among what the blocks of a task hold."""
    shared = blocks.sparkSession.sparkContext.broadcast((wave, centroids))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave, centroids = shared.value
        exact, longest = wave.rows.astype(np.float64), np.sqrt((wave.rows.astype(np.float64) ** 2).sum(axis=1).max())
        least = np.maximum(wave.low, wave.kth)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def best() -> None:
            search, score, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            kept, kth = best_of(search, score, ids, wave.k)
            least[search[kth]] = np.maximum(least[search[kth]], score[kth])
            held[:] = [(search[kept], score[kept], ids[kept])]

        for batch in batches:
            for b in batch.to_pylist():
                cluster = b["cluster"]
                searches = (wave.first == cluster).any(axis=1)
                if not first:
                    low, high = (x[:, 0][wave.anchor] for x in bounds(wave.rows, centroids[cluster : cluster + 1], np.array([b["radius"]])))
                    searches = ~searches & (high >= least) & (low <= wave.high)
                searches = np.flatnonzero(searches)
                if not len(searches):
                    continue
                ids, labels = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64)
                rows = np.frombuffer(b["components"], b["kind"]).reshape(len(ids), -1)
                if longest * b["norm"] > 2.0**62:
                    raise OverflowError("the vectors' scores do not fit into 63 bits")
                plain = longest * b["norm"] < 2.0**52  # whole numbers that doubles hold
                own, rows = (exact, rows.astype(np.float64)) if plain else (wave.rows, rows.astype(np.int64))
                for i in range(0, len(searches), SEARCHES):
                    part = searches[i : i + SEARCHES]
                    anchors, place = np.unique(wave.anchor[part], return_inverse=True)
                    score = (own[anchors] @ rows.T)[place]
                    fits = (score >= least[part, None]) & (score <= wave.high[part, None])
                    of_label = wave.labels[wave.anchor[part], None] == labels
                    fits &= of_label if wave.same else ~of_label
                    fits &= wave.ids[wave.anchor[part], None] != ids
                    s, r = np.nonzero(fits)
                    if len(s):
                        held.append((part[s], score[s, r].astype(np.int64), ids[r]))
                if sum(len(x[0]) for x in held) > HELD:
                    best()
        if held:
            best()
            search, score, ids = held[0]
            columns = [search, wave.ids[wave.anchor[search]], wave.positive[search], wave.positive_score[search], score, ids]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["search", "anchor_id", "positive_id", "positive_score", "score", "vec_id"])

    return blocks.mapInArrow(look, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _two_rounds(blocks: DataFrame, wave: Searches, centroids: np.ndarray, radii: np.ndarray, work: Workspace, name: str) -> DataFrame:
    """The k best rows of every search, with their rank."""
    wave.visit_first(centroids, radii)
    begun = work.write(_best(_search(blocks, wave, centroids, first=True), wave.k), name)
    for r in begun.filter(F.col("rank") == wave.k).select("search", "score").collect():  # one row a search
        wave.kth[r.search] = r.score
    return _best(_search(blocks, wave, centroids, first=False).union(begun.drop("rank")), wave.k)


def mine(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW_PERCENT,
    high: int = HIGH_PERCENT,
    clusters: int = CLUSTERS,
    wave: int = WAVE,
) -> DataFrame:
    """For each anchor and positive the first negatives whose score is within ``low`` to ``high`` percent of the positive's.

    ``vectors`` has vec_id, label and v, a list of whole numbers; ``anchor`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "hard-negatives")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    rows = work.write(rows.withColumn("is_anchor", anchor), "vectors")
    n, anchors, dim = rows.agg(F.count(F.lit(1)), F.count_if("is_anchor"), F.max(F.size("v"))).first()
    if not anchors:
        return spark.createDataFrame([], MINED)

    clusters = max(1, min(clusters, round(math.sqrt(n) / 2)))
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < min(1 << 30, math.ceil((1 << 30) * clusters * FIT_ROWS / n))
    sample = rows.filter(drawn).select("vec_id", "v").toArrow().sort_by("vec_id")
    dim = max(1, dim)
    centroids = fit(matrix(sample["v"], dim), clusters) if len(sample) else np.zeros((1, dim))
    share = np.bincount(nearest(matrix(sample["v"], dim).astype(np.float64), centroids), minlength=len(centroids)) / max(1, len(sample))
    blocks = work.write(_blocks(rows, centroids, 1 + (share * n / ROWS_OF_TASK).astype(np.int64)), "blocks")
    radii = np.zeros(len(centroids))
    for r in blocks.groupBy("cluster").agg(F.max("radius").alias("radius")).collect():  # one row a cluster
        radii[r.cluster] = r.radius

    waves = math.ceil(anchors / wave)
    for i in range(waves):
        own = rows.filter(F.col("is_anchor") & (F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == i)).select("vec_id", "label", "v").toArrow()
        if not len(own):
            continue
        ids, labels, held = own["vec_id"].to_numpy(), own["label"].to_numpy(), matrix(own["v"], dim)
        none = np.iinfo(np.int64).min

        def searches(anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, positive: np.ndarray, score: np.ndarray) -> Searches:
            return Searches(ids, labels, held, anchor, low, high, same, k, np.full(len(anchor), none), np.zeros(0), positive, score)  # noqa: B023

        every, zeros = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        near = searches(every, np.full(len(ids), none), np.full(len(ids), np.iinfo(np.int64).max), True, positives, zeros, zeros)
        best = _two_rounds(blocks, near, centroids, radii, work, f"positives{i}").select("search", "score", "vec_id").toArrow()
        score = best["score"].to_numpy()
        least, most = np.array([-(-low * s // 100) for s in score.tolist()], np.int64), np.array([high * s // 100 for s in score.tolist()], np.int64)
        open_ = least <= most
        far = searches(best["search"].to_numpy()[open_], least[open_], most[open_], False, negatives, best["vec_id"].to_numpy()[open_], score[open_])
        if not open_.any():
            continue
        found = _two_rounds(blocks, far, centroids, radii, work, f"negatives{i}")
        work.write(
            found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")),
            f"mined/wave{i}",
        )
    work.write(spark.createDataFrame([], MINED), "mined/none")
    return spark.read.schema(MINED).parquet(f"{work.path}/mined/*")


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and floor(256 * x) of each component; every seventh id has the label after its own.

    Rows with a component that is null or not finite are left out.
    """
    vec_id, label, x = embeddings["vec_id"].cast("long"), embeddings["label"].cast("long"), embeddings["embedding"].cast("array<double>")
    plain = embeddings.select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), x.alias("x"))
    plain = plain.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    return plain.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))


def every_hundredth(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the anchors whose id is divisible by 100."""
    return mine(whole_numbers(embeddings), F.col("vec_id") % 100 == 0)
