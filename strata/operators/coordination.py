"""Batch views of coordination logs: current state, cursors, retention, liveness, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(log: DataFrame, key: str, order: str, open_: Column) -> DataFrame:
    """The newest row of each key, if it is open: claims held, tasks not closed."""
    newest = log.withColumn("_open", open_).groupBy(key).agg(F.max_by(F.struct(*log.columns, "_open"), order).alias("r"))
    return newest.select("r.*").filter("_open").drop("_open")


def since(log: DataFrame, cursors: DataFrame, consumer: str, order: str) -> DataFrame:
    """Each consumer's events after its cursor; a consumer without cursor reads from the start."""
    return log.join(cursors, consumer, "left").filter(F.col("cursor").isNull() | (F.col(order) > F.col("cursor"))).drop("cursor")


def keep_newest(log: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Retention: the newest n rows of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return log.withColumn("_nth", nth).filter(F.col("_nth") <= n).drop("_nth")


def live(log: DataFrame, agent: str, time: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Agents with their last sign of life and whether it is within the time to live."""
    last = log.groupBy(agent).agg(F.max(time).alias("last_seen"))
    return last.withColumn("alive", F.col("last_seen") >= now - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))


def digest(log: DataFrame, time: str, every: str, *keys: str) -> DataFrame:
    """Counts per tumbling window and key."""
    return log.groupBy(F.window(time, every)["start"].alias("begin"), *keys).agg(F.count(F.lit(1)).alias("n"))
