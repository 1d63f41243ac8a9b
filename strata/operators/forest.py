"""Forests by doubled pointers: places below the root and roll-ups of subtrees in logarithmic rounds.

A forest is a table (id, parent).  A parent that is null or not among the ids makes a
root.  Rows without an id take no part; of an id with several parents the smallest
counts.  A cycle is an error.  Before round i each node knows its ancestor 2 ** i steps
up and the totals of what lies less than 2 ** i steps below it; what lies twice as deep
are the totals of the nodes that are exactly 2 ** i below, so each round adds one
grouped sum, which is combined before the shuffle however many children a node has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.tables import settled

_OWN = ("id", "parent", "root", "depth", "height", "size")


def rolled_up(nodes: DataFrame, sums: Sequence[str] = (), greatest: Sequence[str] = ()) -> DataFrame:
    """id, parent, root, depth, height and size of each node's subtree, and the sum or maximum of its measures.

    The measures are columns of nodes, named none of the six; nulls add nothing.  Rounds: the logarithm of the depth.
    """
    taken = set(_OWN) & {*sums, *greatest}
    if taken:
        raise ValueError(f"measures are named as results: {sorted(taken)}")
    rows = nodes.filter("id IS NOT NULL").groupBy("id").agg(
        F.min("parent").alias("parent"), *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in greatest)
    )
    rows = rows.na.fill(0, list(sums)) if sums else rows
    known = rows.select(F.col("id").alias("_held"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    start = rows.join(known, rows["parent"] == known["_held"], "left")
    work = settled(
        start.select(
            "id", "parent", F.col("_held").alias("up"), F.coalesce("_held", "id").alias("root"), F.when(F.col("_held").isNull(), zero).otherwise(one).alias("depth"),
            zero.alias("height"), one.alias("size"), *sums, *greatest,
        )
    )
    step, count = 1, work.count()
    while not work.filter("up IS NOT NULL").isEmpty():
        if step > count:
            raise ValueError("the forest has a cycle")
        below = work.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(
            (F.max("height") + step).alias("_height"), F.sum("size").alias("_size"), *(F.sum(c).alias(f"_{c}") for c in sums), *(F.max(c).alias(f"_{c}") for c in greatest)
        )
        above = work.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        work = settled(
            work.join(below, "id", "left").join(above, "up", "left").select(
                "id", "parent", F.col("_up").alias("up"), F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", zero)).alias("depth"),
                F.greatest("height", "_height").alias("height"), (F.col("size") + F.coalesce("_size", zero)).alias("size"),
                *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums), *(F.greatest(c, f"_{c}").alias(c) for c in greatest),
            )
        )
        step *= 2
    return work.drop("up")
