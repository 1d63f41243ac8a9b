"""Who is hit by changes, over any number of references and modules, to a fixpoint.

Semi-naive: a round joins the newly hit entities alone with the references to them, takes
one row for each user before the shuffle, and drops what was hit before, so cycles end and
every reference is followed once.  A row carries its path; rounds: the longest shortest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.tables import settled


def impacted(uses: DataFrame, changed: DataFrame) -> DataFrame:
    """node, distance, source, path (from the source to the node): what changes hit, themselves included (distance 0).

    uses: user, used; changed: node.  The path is a shortest one; of several each step goes by the smallest node.
    Rows with nulls take no part, repeated ones count once.
    """
    links = settled(uses.select("user", "used").dropna().distinct())
    frontier = settled(changed.select("node").dropna().distinct().select("node", F.lit(0).alias("distance"), F.col("node").alias("source"), F.array("node").alias("path")))
    seen, step = frontier, 0
    while not frontier.isEmpty():
        step += 1
        hit = frontier.join(links, frontier["node"] == links["used"]).groupBy("user").agg(F.min(F.struct("used", "source", "path")).alias("by"))
        new = hit.join(seen.select(F.col("node").alias("user")), "user", "left_anti")
        frontier = settled(new.select(F.col("user").alias("node"), F.lit(step).alias("distance"), "by.source", F.concat("by.path", F.array("user")).alias("path")))
        seen = seen.unionByName(frontier)
    return seen


def module_impact(references: DataFrame, requires: DataFrame, changes: DataFrame) -> DataFrame:
    """module, entity, distance, source_module, source_entity, path (array of module and entity) of entities that changes reach.

    references: module, entity, uses_module, uses_entity; one into another module counts if the module requires it.
    requires: module, needs.  changes: module, entity.  Changed entities themselves are left out.
    """
    pairs = requires.select(F.col("module").alias("_module"), F.col("needs").alias("_needs")).dropna().distinct()
    own = references.filter("module = uses_module")
    other = references.filter("module != uses_module")
    allowed = own.unionByName(other.join(pairs, (F.col("module") == F.col("_module")) & (F.col("uses_module") == F.col("_needs")), "left_semi"))
    allowed = allowed.dropna(subset=["module", "entity", "uses_module", "uses_entity"])
    node = F.struct("module", "entity").alias
    used = F.struct(F.col("uses_module").alias("module"), F.col("uses_entity").alias("entity")).alias("used")
    found = impacted(allowed.select(node("user"), used), changes.dropna(subset=["module", "entity"]).select(node("node"))).filter("distance > 0")
    return found.select("node.module", "node.entity", "distance", F.col("source.module").alias("source_module"), F.col("source.entity").alias("source_entity"), "path")


def modules_hit(impact: DataFrame) -> DataFrame:
    """source_module, module, entities, nearest: how many entities of each module the changes of another reach."""
    other = impact.filter("module != source_module")
    return other.groupBy("source_module", "module").agg(F.count(F.lit(1)).alias("entities"), F.min("distance").alias("nearest"))
