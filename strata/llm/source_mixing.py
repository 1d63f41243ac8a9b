"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong
to.  A flow then routes words from the patterns to the sources' quotas: a
pattern can give its words once at no cost, a second time at cost 1, a third at
cost 2, so repetition is used only where a quota cannot be met without it, and
evenly over the patterns a source can draw from.  What a pattern gives in all is
turned into documents: every document as often as it goes evenly, and for the
rest those first in a seeded order, the last of them in part, so the words taken
equal the words routed.

The driver holds one row per source and one per pattern, never a document.

Defined results: a null text has no words, a null source is a source of its own
that comes last; rows that repeat are documents of their own (identical rows
share the words that fall to them in any order); a source without words has
target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.codes import word_classes
from strata.llm.common import WORD, Workspace, flat_utf8

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 11
#: Hex digits of the seeded rank that name a slice of a pattern's order.  Sums are
#: taken within slices and over slices, so no task orders a whole source.
SLICE_DIGITS = 3
#: Patterns up to which the plan is broadcast.
SMALL_PLAN = 10_000


def words(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns (doc_id first, text second) with the text replaced by its number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = word_classes()
        for batch in batches:
            data, offsets = flat_utf8(pc.fill_null(batch.column(1), ""))
            word = kinds[data].astype(bool)
            start = word.copy()
            start[1:] &= ~word[:-1]
            edge = offsets[:-1][offsets[:-1] < offsets[1:]]
            start[edge] = word[edge]
            sums = np.concatenate([[0], np.cumsum(start)])
            sizes = pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *batch.columns[2:]], ["doc_id", "size", *batch.schema.names[2:]])

    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *columns)
    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[2:])
    return picked.mapInArrow(count, "doc_id long, size long" + (f", {rest}" if rest else ""))


def quotas(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> dict[str | None, float]:
    """Each source's target: its weight's share of all words, at most ``epochs`` times its size.

    Sources come by code point, null last; the weights repeat over them.  What
    is cut off goes to the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    most = {name: epochs * size for name, size in order}
    rest, free, target = sum(size for _, size in order), list(weight), {}
    while free:
        total = sum(weight[x] for x in free)
        over = [x for x in free if weight[x] * rest >= most[x] * total]
        if not over:
            return target | {x: weight[x] * rest / total for x in free}
        for x in over:
            target[x] = float(most[x])
        rest -= sum(most[x] for x in over)
        free = [x for x in free if x not in target]
    return target


def route(patterns: dict[tuple, int], quota: dict[str | None, float], epochs: int = EPOCHS) -> dict[tuple, dict[str | None, int]]:
    """Words each pattern gives each of its sources, as a flow of least repetition cost.

    Successive cheapest paths: the repetitions are opened one after the other,
    and with each the flow is augmented along shortest paths until no more fits.
    As every path's cost is that of the repetition it starts with, paths of
    equal cost can be taken in any order, and the flow is of least cost for its
    value.
    """
    need = {s: int(q) for s, q in quota.items()}
    flow: dict[tuple, dict[str | None, int]] = {p: dict.fromkeys(p, 0) for p in patterns}
    drawn: dict[str | None, list[tuple]] = {s: [] for s in quota}
    for p in patterns:
        for s in p:
            drawn[s].append(p)
    for _ in range(epochs):
        left = dict(patterns)
        for p in patterns:  # the direct paths first
            for s in p:
                give = min(left[p], need[s])
                flow[p][s] += give
                left[p] -= give
                need[s] -= give
        for p in patterns:
            while left[p]:
                path = _augmenting(p, flow, drawn, need)
                if path is None:
                    break
                give = min([left[p], need[path[-1][1]], *(flow[q][s] for q, s in path[1::2])])
                for i, (q, s) in enumerate(path):
                    flow[q][s] += -give if i % 2 else give
                left[p] -= give
                need[path[-1][1]] -= give
    return flow


def _augmenting(start: tuple, flow: dict, drawn: dict, need: dict) -> list[tuple[tuple, str | None]] | None:
    """Edges, gained and given up in turn, from a pattern to a source that needs words."""
    came: dict = {}
    seen, queue = {start}, deque([start])
    while queue:
        p = queue.popleft()
        for s in p:
            if s in came:
                continue
            came[s] = p
            if need[s]:
                path = [(p, s)]
                while path[0][0] != start:
                    q = path[0][0]
                    back = came[("p", q)]
                    path = [(came[back], back), (q, back), *path]
                return path
            for q in drawn[s]:
                if q not in seen and flow[q][s]:
                    seen.add(q)
                    came[("p", q)] = s
                    queue.append(q)
    return None


def _rank(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))))


def _mixed(docs: DataFrame, members: Column, weights: Sequence[int], epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every document's share (doc_id, pattern, rank, size, part), and the plan of each pattern."""
    spark = docs.sparkSession
    sized = Workspace(spark, "mixing").write(words(docs, members.alias("pattern")), "sizes")
    held = {tuple(r.pattern): r.size for r in sized.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    own: dict[str | None, int] = {}
    for pattern, size in held.items():
        for s in pattern:
            own[s] = own.get(s, 0) + size
    # a document of several sources counts for each; the targets share the words that there are
    target = quotas(list(own.items()), weights, epochs)
    counted = sum(own.values())
    if counted != sum(held.values()):
        target = {s: q * sum(held.values()) / counted for s, q in target.items()}
    given = route(held, target, epochs)

    rows = []
    for pattern, size in held.items():
        even, rest = divmod(sum(given[pattern].values()), size) if size else (0, 0)
        only = len(pattern) == 1
        rows.append((list(pattern), even, rest, own[pattern[0]] if only else None, target[pattern[0]] if only else None))
    plan = spark.createDataFrame(rows, "pattern array<string>, even long, rest long, source_size long, target double")

    ranked = sized.withColumn("rank", _rank(F.col("doc_id"), seed))
    ranked = ranked.withColumn("slice", F.conv(F.substring("rank", 1, SLICE_DIGITS), 16, 10).cast("int"))
    slices = ranked.groupBy("pattern", "slice").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("pattern", "slice", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("slices_before"))
    inside = Window.partitionBy("pattern", "slice").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("slices_before") + F.coalesce("rows_before", F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    shares = (
        ranked.withColumn("rows_before", F.sum("size").over(inside))
        .join(slices, ["pattern", "slice"])
        .join(plan, "pattern")
        .select("doc_id", "pattern", "rank", "size", "source_size", "target", "even", part.alias("part"))
    )
    return shares, plan


def _free_name(docs: DataFrame) -> str:
    """A name that no column has, in any case."""
    return "p" * (1 + max(map(len, docs.columns)))


def _pattern(docs: DataFrame, members: Column | None) -> Column:
    return F.sort_array(F.array_distinct(F.array(docs["source"].cast("string")) if members is None else members))


def mix(
    docs: DataFrame,
    members: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``members`` is an array column of the sources that a document belongs to; by
    default ``source`` alone.  source_size and target are those of the
    document's only source, and null for one with several.
    """
    shares, _ = _mixed(docs, _pattern(docs, members), weights, epochs, seed)
    taken = F.col("size") * F.col("even") + F.col("part")
    return shares.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame,
    members: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as the mix takes it whole.

    A document taken in part counts as taken if the part is half of it or more;
    documents without a word are not taken.  Which rows are taken once more
    follows from one rank per pattern, so the texts are not shuffled.
    """
    pattern = _pattern(docs, members)
    shares, plan = _mixed(docs, pattern, weights, epochs, seed)
    last = shares.filter("part > 0 AND 2 * part >= size").groupBy("pattern").agg(F.max("rank").alias("last"))
    plan = plan.join(last, "pattern", "left").select("pattern", "even", "last")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*(docs[c] for c in docs.columns), pattern.alias(_free_name(docs))).toDF(*names, "pattern")
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    times = F.col("even") + F.coalesce((_rank(doc_id, seed) <= F.col("last")).cast("long"), F.lit(0))
    times = F.when(text.cast("string").rlike(WORD), times).otherwise(F.lit(0))
    copies = F.when(times > 0, F.sequence(F.lit(1), times.cast("int")))
    plan = Workspace(docs.sparkSession, "mixing-plan").write(plan, "plan")
    if plan.count() <= SMALL_PLAN:  # as a rule a few rows, and one pattern can have a third of all documents
        plan = F.broadcast(plan)
    return (
        plain.join(plan, "pattern")
        .withColumn("copy", F.explode(copies)).select(*names).toDF(*docs.columns)
    )
