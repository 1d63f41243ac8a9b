"""Two-way and three-way matching of keyed snapshots.

A snapshot has a key and a content hash per row.  Every comparison of versions
(diff, status, merge, revert, cherry-pick, stash, module and member merges) is
one of these joins, so each shuffles once per side, on the key, and sides that
are already partitioned by the key are not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match2(before: DataFrame, after: DataFrame, key: str = "key", hash_: str = "hash") -> DataFrame:
    """key, before_hash, after_hash, change (added, removed, modified; unchanged keys are left out)."""
    b = before.select(F.col(key), F.col(hash_).alias("before_hash"), F.lit(True).alias("in_before"))
    a = after.select(F.col(key), F.col(hash_).alias("after_hash"), F.lit(True).alias("in_after"))
    change = (
        F.when(F.col("in_before").isNull(), "added")
        .when(F.col("in_after").isNull(), "removed")
        .when(~F.col("before_hash").eqNullSafe(F.col("after_hash")), "modified")
    )
    return b.join(a, key, "full_outer").select(key, "before_hash", "after_hash", change.alias("change")).filter("change IS NOT NULL")


def disposition(base: Column, ours: Column, theirs: Column) -> Column:
    """The merge class of a key from presence and equality of its three hashes (null: absent).

    A key that both sides deleted is Unchanged.
    """
    same_ours, same_theirs, same_sides = base.eqNullSafe(ours), base.eqNullSafe(theirs), ours.eqNullSafe(theirs)
    added = (
        F.when(theirs.isNull(), "AddedOurs").when(ours.isNull(), "AddedTheirs").when(same_sides, "BothSame").otherwise("Conflict")
    )
    return (
        F.when(base.isNull(), added)
        .when(ours.isNull() & theirs.isNull(), "Unchanged")
        .when(ours.isNull(), F.when(same_theirs, "DeletedOurs").otherwise("DeleteVsModify"))
        .when(theirs.isNull(), F.when(same_ours, "DeletedTheirs").otherwise("DeleteVsModify"))
        .when(same_ours & same_theirs, "Unchanged")
        .when(same_theirs, "OursOnly")
        .when(same_ours, "TheirsOnly")
        .when(same_sides, "BothSame")
        .otherwise("Conflict")
    )


def match3(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str = "key", hash_: str = "hash") -> DataFrame:
    """key, base_hash, ours_hash, theirs_hash, disposition for every key of any side."""
    sides = [
        df.select(F.col(key), F.col(hash_).alias(f"{name}_hash"))
        for name, df in (("base", base), ("ours", ours), ("theirs", theirs))
    ]
    joined = sides[0].join(sides[1], key, "full_outer").join(sides[2], key, "full_outer")
    return joined.withColumn("disposition", disposition(F.col("base_hash"), F.col("ours_hash"), F.col("theirs_hash")))


def resolve(matched: DataFrame) -> DataFrame:
    """What a merge keeps of each matched key: key, hash, side, conflict; deleted keys are left out.

    An edited key beats an untouched one, a conflict keeps ours (theirs where
    ours is gone) and is marked.
    """
    d = F.col("disposition")
    side = (
        F.when(d.isin("OursOnly", "AddedOurs", "BothSame"), "ours")
        .when(d.isin("TheirsOnly", "AddedTheirs"), "theirs")
        .when(d == "Unchanged", F.when(F.col("ours_hash").isNull(), "gone").otherwise("base"))
        .when(d.isin("Conflict", "DeleteVsModify"), F.when(F.col("ours_hash").isNotNull(), "ours").otherwise("theirs"))
        .otherwise("gone")
    )
    picked = matched.withColumn("side", side).filter("side != 'gone'")
    hash_ = F.when(F.col("side") == "theirs", F.col("theirs_hash")).when(F.col("side") == "ours", F.col("ours_hash"))
    return picked.select(
        "key", F.coalesce(hash_, F.col("base_hash")).alias("hash"), "side", d.isin("Conflict", "DeleteVsModify").alias("conflict")
    )


def pair_by_rank(old: DataFrame, new: DataFrame, by: str, order: str) -> DataFrame:
    """Within equal ``by``, the i-th of old by ``order`` with the i-th of new: by, old, new.

    The exact part of rename detection: equal content, pairs one to one.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    o = old.select(by, F.col(order).alias("old"), rank.alias("nth"))
    n = new.select(by, F.col(order).alias("new"), rank.alias("nth"))
    return o.join(n, [by, "nth"]).select(by, "old", "new")


def merge_sets(base: Column, ours: Column, theirs: Column) -> Column:
    """Three sets merged: all of either side, without what one side took out of the base; sorted."""
    gone = F.array_union(F.array_except(base, ours), F.array_except(base, theirs))
    return F.array_sort(F.array_except(F.array_union(ours, theirs), gone))


def unique_match(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) where the keys are unique on both sides."""
    def unique(df: DataFrame, id_: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min(id_).alias(id_)).filter("n = 1").drop("n")

    return unique(left, left_id).join(unique(right, right_id), on).select(left_id, right_id)
