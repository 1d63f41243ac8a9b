"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Workspace

#: Edges of a file, so that rounds over few edges do not write many small files.
EDGES_OF_FILE = 250_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones) are tied to the least of itself and its neighbours.

    The least is a combinable aggregate and the join splits where a node has
    many neighbours, so no neighbourhood is ever gathered.
    """
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        tied = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return tied.filter("u != v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node with an edge; the label is the least node of its component.

    ``edges`` has the long columns u and v.  Every round is written to the
    shared folder, so lineage stays short and lost executors cost one round.
    """
    work = Workspace(edges.sparkSession, name)
    edges = work.write(edges.select("u", "v").filter("u != v").distinct(), "round0")
    files = 1 + edges.count() // EDGES_OF_FILE  # a round has no more edges than twice the one before
    before, i = None, 0
    while True:
        i += 1
        edges = work.write(_stars(_stars(edges, large=True), large=False).coalesce(2 * files), f"round{i}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if i > 1:
            work.drop(f"round{i - 1}")
        if now == before:
            break
        before, files = now, 1 + now[0] // EDGES_OF_FILE
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct()).coalesce(2 * files)
