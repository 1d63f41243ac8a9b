"""Hash-chained logs of the events, one a user, and totals of trees of spawns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import append_log as A
from strata.operators.forest import rolled_up
from strata.operators.tables import settled
from strata.plans.registry import query, table

BODY = """'"event":{"event":"' || event_type || '","agent_id":"' || user_id || '"},"timestamp":' || event_id"""


def _linked(rows: str) -> str:
    """Entries of ``rows`` (log, place, body; places from 0) with hash and prev."""
    data = """'{' || coalesce('"parent":"' || prev || '",', '') || body || '}'"""
    blob = "sha256('blob ' || octet_length(encode(data)) || chr(0) || data)"
    return f"""
RECURSIVE rows AS ({rows}),
d AS (SELECT log, place, body, CAST(NULL AS VARCHAR) AS prev, '{{' || body || '}}' AS data FROM rows WHERE place = 0
  UNION ALL SELECT r.log, r.place, r.body, {blob.replace("data", "d.data")}, '{{"parent":"' || {blob.replace("data", "d.data")} || '",' || r.body || '}}' FROM d JOIN rows r ON r.log = d.log AND r.place = d.place + 1),
linked AS (SELECT log, place, body, prev, {blob} AS hash FROM d)
"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as entries to come: log, seq, body and what the event was."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("seq"), F.expr(BODY).alias("body"), "event_type", "value")


NUMBERED = f"SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, {BODY} AS body"


@query(f"WITH {_linked(NUMBERED + ' FROM events')} SELECT log, place, hash, prev FROM linked")
def feed_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an entry that names the hash of the one before in its user's log."""
    return A.appended(_entries(spark, sf_dir), "seq").select("log", "place", "hash", "prev")


@query(f"""
WITH {_linked(NUMBERED + ' FROM events')} , n AS (SELECT *, max(place) OVER (PARTITION BY log) AS last FROM linked)
SELECT log, last - place AS step, hash FROM n WHERE place > last // 2
""")
def feed_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reader has not seen, from the head back to a cursor in the middle of the log."""
    linked = settled(A.appended(_entries(spark, sf_dir), "seq"))
    heads = A.newest(linked)
    middle = linked.join(heads.select("log", F.expr("place div 2").alias("place")), ["log", "place"]).select("log", F.col("hash").alias("cursor"))
    return A.walked(linked, heads.join(middle, "log")).select("log", "step", "hash")


@query("""
WITH e AS (SELECT *, lag(value < 5, 1, false) OVER (PARTITION BY user_id ORDER BY event_id) AS gap, lead(value >= 5, 1, false) OVER (PARTITION BY user_id ORDER BY event_id) AS followed FROM events)
SELECT user_id AS log, count(*) AS entries, count(*) FILTER (event_type = 'error') AS altered, count(*) FILTER (gap) AS cut_off, count(*) FILTER (NOT followed) AS heads FROM e WHERE value >= 5 GROUP BY user_id
""")
def feed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that lost entries (small values) and had others rewritten (errors): what does not hold any more."""
    events = _entries(spark, sf_dir)
    linked = A.appended(events, "seq")
    was = events.select("log", "body", "event_type", "value")
    kept = linked.join(was, ["log", "body"]).filter("value >= 5").withColumn("body", F.when(F.col("event_type") == "error", F.concat("body", F.lit("0"))).otherwise(F.col("body")))
    return A.checked(kept).groupBy("log").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("whole")).alias("altered"), F.count_if(~F.col("linked")).alias("cut_off"), F.count_if(F.col("forks") == 0).alias("heads")
    )


@query(f"""
WITH {_linked(NUMBERED.replace("AS place", "- greatest(count(*) OVER (PARTITION BY user_id) - 20, 0) AS place") + ' FROM events')} SELECT log, place, hash, prev FROM linked
""")
def feed_prune_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 entries of each log, linked anew."""
    linked = settled(A.appended(_entries(spark, sf_dir), "seq"))
    return A.pruned(linked, A.newest(linked), 20).select("log", "place", "hash", "prev")


@query(f"""
WITH {_linked(NUMBERED.replace("ORDER BY event_id", "ORDER BY event_type IN ('error', 'signup'), event_id") + ' FROM events')} SELECT log, place, hash, prev FROM linked
""")
def feed_merge_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs to which the events that found no room (errors, signups) are put in their own order afterwards."""
    events = _entries(spark, sf_dir)
    late = F.col("event_type").isin("error", "signup")
    first = A.appended(events.filter(~late), "seq")
    rest = A.appended(events.filter(late), "seq", heads=A.newest(first))
    return first.unionByName(rest).select("log", "place", "hash", "prev")


@query("""
WITH o AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS spent, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS failed FROM orders),
s AS (SELECT unnest(range(0, 40)) AS d), u AS (SELECT o.*, o.id >> s.d AS up, s.d FROM o JOIN s ON s.d = 0 OR (o.id >> (s.d - 1)) > 1)
SELECT up AS id, length(bin(up)) - 1 AS depth, CAST(max(d) AS BIGINT) AS height, count(*) AS size, CAST(sum(spent) AS BIGINT) AS spent, CAST(sum(failed) AS BIGINT) AS failed, max(spent) AS dearest
FROM u GROUP BY up
""")
def spawn_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spawn k was made by spawn k div 2: depth, height, size, cost and failures of what each one set off."""
    spent = F.round(F.col("o_totalprice") * 100).cast("long")
    nodes = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") > 1, F.expr("o_orderkey div 2")).alias("parent"),
        spent.alias("spent"), spent.alias("dearest"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("failed"),
    )
    return rolled_up(nodes, ["spent", "failed"], ["dearest"]).select("id", "depth", "height", "size", "spent", "failed", "dearest")
