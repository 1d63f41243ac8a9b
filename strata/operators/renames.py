"""Rename detection: a similarity join and a greedy one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.lines import similarity_udf
from strata.operators.tables import settled

LEAST = 0.8


def renamed(removed: DataFrame, added: DataFrame, least: float = LEAST) -> DataFrame:
    """(kind, old, new, score): ``assign`` over all candidates, with equal lines settled before the join.

    Equal lines score 1 and come first in the greedy order, which pairs the i-th
    old of a body with its i-th new.
    """
    def ranked(df: DataFrame, id_: str) -> DataFrame:
        key = df.select("kind", F.col("id").alias(id_), F.sha2(F.to_json(F.struct(_lines().alias("l"))), 256).alias("key"))
        return key.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "key").orderBy(id_)))

    equal = settled(ranked(removed, "old").join(ranked(added, "new"), ["kind", "key", "nth"]).select("kind", "old", "new", F.lit(1.0).alias("score")))
    left = [df.join(equal.select("kind", F.col(x).alias("id")), ["kind", "id"], "left_anti") for df, x in ((removed, "old"), (added, "new"))]
    return equal.unionByName(assign(candidates(*left, least)))


def _lines() -> Column:
    """The lines of ``body`` as ``split_lines`` has them."""
    lines = F.split(F.coalesce("body", F.lit("")), "\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def candidates(removed: DataFrame, added: DataFrame, least: float = LEAST) -> DataFrame:
    """(kind, old, new, score) of pairs of one kind that are similar enough.

    Both sides have kind, id and body.  Lines are numbered by occurrence, so that
    a body is a set.  Two bodies that are similar enough share at least
    least / (2 - least) of the lines of either, so they share one of the rarest of
    each: only those are joined.  The lines in common bound the similarity from
    above, and only pairs that pass meet the kernel.
    """
    def sized(df: DataFrame, id_: str) -> DataFrame:
        nth = F.expr("transform(line_hashes, (x, i) -> xxhash64(x, i - array_position(line_hashes, x)))")
        d = df.select("kind", F.col("id").alias(id_), F.col("body").alias(f"body_{id_}"), F.sort_array(F.transform(_lines(), lambda x: F.xxhash64(x))).alias("line_hashes"))
        return d.select("kind", id_, f"body_{id_}", nth.alias(f"lines_{id_}"))

    old, new = sized(removed, "old"), sized(added, "new")
    exploded = {x: df.select("kind", x, F.size(f"lines_{x}").alias("n"), F.explode(f"lines_{x}").alias("line")) for x, df in (("old", old), ("new", new))}
    seen = exploded["old"].select("kind", "line").unionByName(exploded["new"].select("kind", "line")).groupBy("kind", "line").agg(F.count(F.lit(1)).alias("seen"))

    def rarest(x: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("kind", x).orderBy("seen", "line"))
        # a hair below the bound, so that rounding cannot raise it
        needed = F.greatest(F.lit(1), F.ceil(F.col("n") * (least / (2 - least)) - 1e-9))
        return exploded[x].join(seen, ["kind", "line"]).withColumn("place", place).filter(F.col("place") <= F.col("n") - needed + 1).select("kind", x, "line")

    pairs = rarest("old").join(rarest("new"), ["kind", "line"]).select("kind", "old", "new").distinct()
    empty = [df.filter(F.size(f"lines_{x}") == 0).select("kind", x) for x, df in (("old", old), ("new", new))]
    pairs = pairs.unionByName(empty[0].join(empty[1], "kind"))
    pairs = pairs.join(old, ["kind", "old"]).join(new, ["kind", "new"])
    common = F.size(F.array_intersect("lines_old", "lines_new"))
    pairs = pairs.filter(2 * common >= least * (F.size("lines_old") + F.size("lines_new")))
    score = F.when(F.col("body_old") == F.col("body_new"), F.lit(1.0)).otherwise(similarity_udf("body_old", "body_new"))
    return pairs.select("kind", "old", "new", score.alias("score")).filter(F.col("score") >= least)


def assign(scored: DataFrame) -> DataFrame:
    """Each old with at most one new: greedy by score, then old, then new, within each kind.

    Pairs that are the best of both their ends are those that the greedy order
    would take; each round keeps them and drops all other pairs of their ends.
    """
    left, kept = settled(scored), None
    order = F.struct((-F.col("score")).alias("s"), F.col("old").alias("o"), F.col("new").alias("n"))
    while kept is None or not left.isEmpty():
        best = left.select("kind", "old", "new", "score", order.alias("place"))
        for x in ("old", "new"):
            best = best.join(left.groupBy("kind", x).agg(F.min(order).alias("place")), ["kind", x, "place"], "left_semi")
        best = settled(best.select("kind", "old", "new", "score"))
        kept = best if kept is None else kept.unionByName(best)
        for x in ("old", "new"):
            left = left.join(best.select("kind", x), ["kind", x], "left_anti")
        left = settled(left)
    return kept
