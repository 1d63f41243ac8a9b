"""Commit graphs: closure, generations, merge base, first-parent chains, bisection.

A graph is an edge table (child, parent, ord); ord 0 is the first parent.
A closure goes breadth first: each round joins the frontier alone with the edges
and drops what was seen, so a node is visited once however many paths lead to
it.  Closures of many tips go by generation and need no such comparison.  Chains double their step instead, so a chain of n takes log n joins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.tables import settled


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, distance): everything the roots (column node) reach, themselves included, by fewest steps."""
    seen = settled(roots.select("node").distinct().withColumn("distance", F.lit(0)))
    frontier, step = seen, 0
    links = settled(edges.select("child", "parent"))  # an edge that stands twice is met twice and counted once, so none is moved
    while True:
        step += 1
        new = (
            frontier.join(links, frontier["node"] == links["child"]).select(F.col("parent").alias("node")).distinct()
            .join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(step))
        )
        frontier = settled(new)
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)  # each round's table once; only the frontier is written


def tips(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the branch tips, nodes that are no one's parent."""
    return nodes.select("node").distinct().join(edges.select(F.col("parent").alias("node")), "node", "left_anti")


def closures(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(tip, node, distance): what each root (column node) reaches, itself included, by fewest steps.

    Nodes are visited from the greatest generation down, when all ways to them are known, so nothing is compared with
    what was seen: a pair is moved once for each edge by which it is reached.  Raises ValueError on a cycle.
    """
    links = settled(edges.select("child", "parent").distinct())
    roots = roots.select("node").distinct()
    order = generations(links.select(F.explode(F.array("child", "parent")).alias("node")).unionByName(roots), links)
    links = settled(links.join(order.toDF("child", "generation"), "child").join(order.toDF("parent", "next"), "parent"), by="generation")
    first = roots.join(order, "node").select(F.col("node").alias("tip"), "node", F.lit(0).alias("distance"), F.col("generation").cast("int"))
    seen, waiting, new = first.select("tip", "node", "distance").limit(0), {}, settled(first, by="generation")
    while True:
        for r in new.select("generation").distinct().collect():
            waiting.setdefault(r.generation, []).append(new)
        if not waiting:
            return seen
        at = max(waiting)
        tables = [t.filter(F.col("generation") == at).select("tip", "node", "distance") for t in waiting.pop(at)]
        ways = tables[0]
        for t in tables[1:]:
            ways = ways.unionByName(t)
        reached = settled(ways.groupBy("tip", "node").agg(F.min("distance").alias("distance")))
        seen = seen.unionByName(reached)
        on = links.filter(F.col("generation") == at).select(F.col("child").alias("node"), "parent", F.col("next").cast("int").alias("generation"))
        further = reached.join(on, "node").select("tip", F.col("parent").alias("node"), (F.col("distance") + 1).alias("distance"), "generation")
        new = settled(further, by="generation")


def generations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, generation): 1 without parents, else one more than the greatest of the parents.

    Parents that are not among the nodes count 0.  Raises ValueError on a cycle.  Each
    round meets the edges of the generation before; only nodes that some of their parents
    wait for are carried on.
    """
    own = settled(nodes.select("node").distinct())
    links = edges.select("child", "parent").distinct()
    for end in ("parent", "child"):
        links = links.join(own.select(F.col("node").alias(end)), end, "left_semi")
    links = settled(links.withColumn("parents", F.count(F.lit(1)).over(Window.partitionBy("child"))))
    ready = settled(own.join(links.select(F.col("child").alias("node")), "node", "left_anti").withColumn("generation", F.lit(1).cast("long")))
    done, generation, partly = ready, 1, None
    while not ready.isEmpty():
        generation += 1
        met = links.join(ready.select(F.col("node").alias("parent")), "parent").select("child", "parents", F.lit(1).cast("long").alias("met"))
        met = settled((met if partly is None else met.unionByName(partly)).groupBy("child", "parents").agg(F.sum("met").alias("met")))
        ready = met.filter("met = parents").select(F.col("child").alias("node"), F.lit(generation).cast("long").alias("generation"))
        partly = met.filter("met < parents")
        done = done.unionByName(ready)
    if done.count() < own.count():
        raise ValueError("the graph has a cycle")
    return done


def merge_base(nodes: DataFrame, edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The common ancestor of greatest generation, ties to the smallest node: at most one row.

    Whatever a common ancestor reaches is common too, so generations are counted
    among the common ones alone.
    """
    shared = settled(closure(edges, a).select("node").join(closure(edges, b).select("node"), "node"))
    # the nodes are read past what is common, which may be little, instead of being dealt out and sorted to meet it
    common = settled(nodes.select("node").join(shared, "node", "left_semi").distinct())
    inside = edges.join(common.select(F.col("node").alias("child")), "child", "left_semi")
    return generations(common, inside).orderBy(F.desc("generation"), "node").limit(1)


def is_ancestor(reach: DataFrame, pairs: DataFrame) -> DataFrame:
    """tip, other, ancestor: whether each tip reaches the other; an own ancestor counts."""
    held = reach.select("tip", F.col("node").alias("other")).withColumn("ancestor", F.lit(True))
    return pairs.join(held, ["tip", "other"], "left").select("tip", "other", F.coalesce("ancestor", F.lit(False)).alias("ancestor"))


def ahead_behind(reach: DataFrame, pairs: DataFrame) -> DataFrame:
    """tip, other, ahead, behind: commits that only the one or only the other reaches."""
    both = _side_by_side(reach, pairs, F.col("node"))
    shared = F.size(F.array_intersect("of_tip", "of_other"))
    ahead, behind = (F.size(c) - shared for c in ("of_tip", "of_other"))
    return both.select("tip", "other", ahead.cast("long").alias("ahead"), behind.cast("long").alias("behind"))


def _side_by_side(reach: DataFrame, pairs: DataFrame, entry: Column) -> DataFrame:
    """tip, other, of_tip, of_other: for each pair the lists of entries of ``reach``, so a tip's rows are moved as one."""
    lists = settled(reach.groupBy("tip").agg(F.collect_list(entry).alias("of_tip")))
    found = pairs.select("tip", "other").join(lists, "tip", "left").join(lists.toDF("other", "of_other"), "other", "left")
    empty = F.array().cast(lists.schema["of_tip"].dataType)
    return found.select("tip", "other", *(F.coalesce(c, empty).alias(c) for c in ("of_tip", "of_other")))


def until(chains: DataFrame, stops: DataFrame) -> DataFrame:
    """The part of each first-parent chain before the first of the commits (column node) at which to stop."""
    first = chains.join(stops.select("node"), "node", "left_semi").groupBy("tip").agg(F.min("depth").alias("stop"))
    return chains.join(first, "tip", "left").filter("stop IS NULL OR depth < stop").drop("stop")


def skip_candidates(candidates: DataFrame, skipped: DataFrame) -> DataFrame:
    """The candidate (column node, distance) nearest to the middle that is not skipped: at most one row."""
    ranked = candidates.withColumn("i", F.row_number().over(Window.orderBy(F.desc("distance"), "node")) - 1)
    middle = F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / 2)
    return (
        ranked.withColumn("off", F.abs(F.col("i") - middle)).join(skipped.select("node"), "node", "left_anti")
        .orderBy("off", "i").limit(1).select("node")
    )


def first_parents(edges: DataFrame) -> DataFrame:
    return edges.filter("ord = 0").select("child", "parent")


def chain(edges: DataFrame, tips: DataFrame, limit: int | None = None) -> DataFrame:
    """(tip, node, depth): the first-parent chain of every tip (column node), newest first, of its first ``limit`` nodes."""
    found = tips.select(F.col("node").alias("tip"), "node", F.lit(0).cast("long").alias("depth"))
    for part, width in _stretches(edges, tips, limit):
        if "way" in part.columns:
            part = part.select("tip", F.posexplode("way").alias("i", "node")).select("tip", "node", (F.col("i") + width).cast("long").alias("depth"))
        found = found.unionByName(part)
    return found if limit is None else found.filter(F.col("depth") < limit)


def marked_chain(edges: DataFrame, tips: DataFrame, marks: DataFrame) -> DataFrame:
    """(tip, node, depth, mark): the nodes of ``chain`` that ``marks`` (node, mark) has."""
    marks = settled(marks.select("node", "mark"))

    def with_mark(rows: DataFrame) -> DataFrame:
        return rows.join(_few_or_merged(marks, 4), "node").select("tip", "node", "depth", "mark")

    found = with_mark(tips.select(F.col("node").alias("tip"), "node", F.lit(0).cast("long").alias("depth")))
    for part, width in _stretches(edges, tips, None, marks):
        if "way" in part.columns:
            placed = F.transform("way", lambda e, i: F.struct(e["node"].alias("node"), (i + width).cast("long").alias("depth"), e["mark"].alias("mark")))
            part = part.select("tip", F.explode(F.filter(placed, lambda e: e["mark"].isNotNull())).alias("e")).select("tip", "e.node", "e.depth", "e.mark")
        else:
            part = with_mark(part)
        found = found.unionByName(part)
    return found


def ancestors(edges: DataFrame, tips: DataFrame, steps: int) -> DataFrame:
    """(tip, node): the node that is ``steps`` above each tip (column node) by first parents; tips of shorter chains are left out."""
    found = None
    for part, width in _stretches(edges, tips, steps + 1):
        if "way" not in part.columns:
            part = part.filter(F.col("depth") == steps).select("tip", "node")
        elif width <= steps < 2 * width:
            part = part.select("tip", F.get("way", F.lit(steps - width)).alias("node")).filter("node IS NOT NULL")
        else:
            continue
        found = part if found is None else found.unionByName(part)
    own = tips.select(F.col("node").alias("tip"), "node")
    return found if found is not None and steps else own if not steps else own.limit(0)


#: As many values are sent to all tasks; more are sorted and merged, for compressed files tell nothing of their size in memory.
FEW = 1 << 19


def _few_or_merged(rows: DataFrame, width: int = 1) -> DataFrame:
    return F.broadcast(rows) if rows.count() * width <= FEW else rows.hint("merge")


def _stretches(edges: DataFrame, tips: DataFrame, limit: int | None, marks: DataFrame | None = None) -> Iterator[tuple[DataFrame, int]]:
    """What is above the tips, as tables (tip, way) with the nodes of chains from depth ``width`` to 2 * width - 1, or (tip, node, depth).

    With ``marks`` (node, mark; one row for a node) a way has structs of the node and its mark instead of nodes.

    Where many tips share what is above them, the ways of 2 ** i nodes are made once for each node that is as far above
    another, and a tip moves as one row a round.  Where few do, or a commit has several first parents, the chains
    themselves meet the table of 2 ** i steps.
    """
    up = settled(first_parents(edges))
    at = settled(tips.select(F.col("node").alias("tip"), F.col("node").alias("child")).join(_few_or_merged(up, 2), "child").select("tip", F.col("parent").alias("node")))
    width = 1
    if up.count() <= at.count() and up.groupBy("child").count().filter("count > 1").isEmpty():
        ways = up.select(F.col("parent").alias("node")).distinct().join(_few_or_merged(up, 2), F.col("node") == F.col("child"), "left")
        if marks is not None:
            ways = ways.join(_few_or_merged(marks, 4), "node", "left")
        ways = settled(ways.select("node", F.array("node" if marks is None else F.struct("node", "mark")).alias("way"), F.col("parent").alias("next")))
        while (limit is None or width < limit) and 0 < ways.count() <= at.count():
            part = settled(at.join(_few_or_merged(ways, width), "node").select("tip", "way", "next"))
            yield part.select("tip", "way"), width
            at = part.filter("next IS NOT NULL").select("tip", F.col("next").alias("node"))
            if limit is None or 2 * width < limit:
                ends = settled(ways.filter("next IS NOT NULL").select(F.col("next").alias("node")).distinct())
                on = ways.select(F.col("node").alias("next"), F.col("way").alias("more"), F.col("next").alias("then"))
                ways = ways.join(_few_or_merged(ends), "node", "left_semi").join(_few_or_merged(on, width), "next", "left")
                ways = settled(ways.select("node", F.when(F.col("more").isNull(), F.col("way")).otherwise(F.concat("way", "more")).alias("way"), F.col("then").alias("next")))
            width *= 2
    if at.isEmpty() or not (limit is None or width < limit):
        return
    found, jump, step = settled(at.select("tip", "node", F.lit(width).cast("long").alias("depth"))), up, 1
    yield found, width
    while limit is None or width + step < limit:
        on = jump.select(F.col("child").alias("node"), F.col("parent").alias("far"))
        more = settled(found.join(_few_or_merged(on, 2), "node").select("tip", F.col("far").alias("node"), (F.col("depth") + step).alias("depth")))
        if more.isEmpty():
            return
        yield more, width
        found = found.unionByName(more)
        on = on.toDF("parent", "far")
        jump = settled(jump.join(_few_or_merged(on, 2), "parent").select("child", F.col("far").alias("parent")))
        step *= 2


def chain_until(edges: DataFrame, tips: DataFrame, stops: DataFrame) -> DataFrame:
    """``until`` of the chains of the tips: the ways are cut at the stops (column node) before they are followed."""
    stops = settled(stops.select("node").distinct())

    def without(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(_few_or_merged(stops.toDF(column)), column, "left_anti")

    return chain(without(without(edges.filter("ord = 0"), "child"), "parent"), without(tips.select("node"), "node"))


def nearest(edges: DataFrame, tips: DataFrame, marks: DataFrame) -> DataFrame:
    """(tip, node, depth, mark): the first node with a mark on the first-parent chain of each tip (column node), itself included.

    ``marks`` (node, mark; null for none) has all nodes; a chain ends before a node that it has not.  Only nodes without
    a mark point on, and their pointers are doubled until they end at a mark.
    """
    marks = settled(marks.select("node", "mark"))
    plain = marks.filter("mark IS NULL").select("node")
    state = plain.join(first_parents(edges).hint("merge"), F.col("node") == F.col("child"), "left")
    done, open_ = None, settled(state.select("node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth")))
    while not open_.isEmpty():
        # what is not among the nodes without a mark has one, or ends the chain
        on = (open_ if done is None else open_.withColumn("end", F.lit(False)).unionByName(done.withColumn("end", F.lit(True))))
        on = on.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("depth").alias("more"), *([F.lit(False).alias("end")] if done is None else ["end"]))
        met = open_.join(on.hint("merge"), "at", "left")
        moved = settled(met.select(
            "node", F.when(F.col("end").isNull(), F.col("at")).otherwise(F.col("far")).alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("end", F.lit(True)).alias("end"),
        ))
        ended = moved.filter("end").drop("end")
        done = ended if done is None else done.unionByName(ended)
        open_ = moved.filter("NOT end").drop("end")
    own = tips.select(F.col("node").alias("tip"), "node").join(marks.hint("merge"), "node")
    found = own.filter("mark IS NOT NULL").select("tip", "node", F.lit(0).cast("long").alias("depth"), "mark")
    if done is None:
        return found
    above = own.filter("mark IS NULL").select("tip", "node").join(done.hint("merge"), "node").select("tip", F.col("at").alias("node"), "depth")
    return found.unionByName(above.join(marks.filter("mark IS NOT NULL").hint("merge"), "node").select("tip", "node", "depth", "mark"))


def bisect_candidates(edges: DataFrame, bad: DataFrame, good: DataFrame) -> DataFrame:
    """(node, distance) from the bad commit: what it reaches and no good one does, without itself."""
    return closure(edges, bad).filter("distance > 0").join(closure(edges, good).select("node"), "node", "left_anti")


def push_sets(reach: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tip, other, node, distance) for pairs of tips: what the tip reaches and the other does not."""
    both = _side_by_side(reach, pairs, F.struct("node", "distance"))
    held = F.transform("of_other", lambda x: F.struct(x["node"].alias("node"), F.lit(-1).alias("distance")))  # sorts before the tip's
    both = both.select("tip", "other", F.array_sort(F.concat("of_tip", held)).alias("x"))
    alone = F.filter("x", lambda x, i: (x["distance"] >= 0) & ~F.coalesce(F.get("x", i - 1)["node"] == x["node"], F.lit(False)))
    return both.select("tip", "other", F.explode(alone).alias("x")).select("tip", "other", "x.node", "x.distance")


def merge_bases(reach: DataFrame, generation: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tip, other, node, generation) for pairs of tips, as ``merge_base`` has it; pairs without one are left out."""
    both = _side_by_side(reach.join(generation, "node"), pairs, F.struct((-F.col("generation")).alias("g"), "node"))
    both = both.select("tip", "other", F.array_sort(F.concat("of_tip", "of_other")).alias("x"))
    common = F.filter("x", lambda x, i: F.get("x", i + 1) == x)
    return both.select("tip", "other", F.get(common, F.lit(0)).alias("best")).filter("best IS NOT NULL").select("tip", "other", "best.node", (-F.col("best.g")).alias("generation"))
