"""Order-sensitive operators: ordinals, anchors, neighbours, runs, hunks.

Every window is partitioned by the file, stream or conversation it runs over;
none orders a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinals(df: DataFrame, keys: list[str], order: str, name: str = "ordinal") -> DataFrame:
    """How many rows of the same keys come before each row."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def anchors(df: DataFrame, within: str, order: str, key: str, is_anchor: Column, name: str = "anchor") -> DataFrame:
    """The key of the nearest row before that is an anchor; null at the start."""
    before = Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_anchor, F.col(key)), ignorenulls=True).over(before))


def neighbours(df: DataFrame, within: str, order: str, key: str, counts: Column) -> DataFrame:
    """prev_key and next_key: the nearest rows before and after that count."""
    own = F.when(counts, F.col(key))
    before = Window.partitionBy(within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(within).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("prev_key", F.last(own, ignorenulls=True).over(before)).withColumn(
        "next_key", F.first(own, ignorenulls=True).over(after)
    )


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def islands(df: DataFrame, within: str, order: str, breaks: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows: a row for which ``breaks`` holds, or the first, begins a new one."""
    w = Window.partitionBy(within).orderBy(order)
    return df.withColumn(name, F.sum(F.coalesce(breaks, F.lit(True)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def hunks(changed: DataFrame, within: str, line: str, context: int = 3) -> DataFrame:
    """Changed lines merged into hunks: within, hunk, first, last, n; hunks whose contexts touch are one."""
    w = Window.partitionBy(within).orderBy(line)
    far = F.col(line) - F.lag(line).over(w) > 2 * context
    numbered = islands(changed.withColumn("_far", far), within, line, F.col("_far"), "hunk")
    return numbered.groupBy(within, "hunk").agg(F.min(line).alias("first"), F.max(line).alias("last"), F.count(F.lit(1)).alias("n"))
