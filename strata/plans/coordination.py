"""Coordination queries: claims, feed, presence, digests, dependents, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.operators import coordination as C
from strata.plans.registry import query, table


@query("""
WITH n AS (SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id)
SELECT user_id, event_id, event_type FROM n WHERE event_type <> 'view'
""")
def claims_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that stand: the newest event of each key, unless it released the claim."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return C.current(e, "user_id", "event_id", F.col("event_type") != "view")


@query("""
WITH c AS (SELECT user_id, CAST(max(event_id) * 9 // 10 AS BIGINT) AS cursor FROM events WHERE user_id % 3 <> 0 GROUP BY user_id)
SELECT e.user_id, e.event_id FROM events e LEFT JOIN c USING (user_id) WHERE c.cursor IS NULL OR e.event_id > c.cursor
""")
def feed_since_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    cursors = e.filter("user_id % 3 != 0").groupBy("user_id").agg(F.expr("max(event_id) * 9 div 10").alias("cursor"))
    return C.since(e, cursors, "user_id", "event_id")


@query("""SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100""")
def feed_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.keep_newest(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 100)


@query("""
WITH l AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id)
SELECT user_id, last_seen, last_seen >= (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS AS alive FROM l
""")
def presence_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    return C.live(e, "user_id", "ts", e.agg(F.max("ts")).scalar(), 86400)


@query("""
WITH l AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id),
c AS (SELECT user_id, count(*) AS claims FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT user_id, coalesce(claims, 0) AS released FROM l LEFT JOIN c USING (user_id) WHERE last_seen < (SELECT max(ts) FROM events) - INTERVAL 43200 SECONDS
""")
def stale_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents to evict, with the number of claims that fall free."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    gone = C.live(e, "user_id", "ts", e.agg(F.max("ts")).scalar(), 43200).filter("NOT alive")
    claims = e.filter("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("claims"))
    return gone.join(claims, "user_id", "left").select("user_id", F.coalesce("claims", F.lit(0)).cast("long").alias("released"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS begin, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def activity_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.digest(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type")


@query("""
SELECT p_brand, count(*) AS files, count(*) FILTER (p_size > 25) AS changed, count(*) FILTER (p_size <= 10) AS untracked,
  sha256(string_agg(CAST(p_partkey AS VARCHAR), E'\\n' ORDER BY CAST(p_partkey AS VARCHAR))) AS fingerprint FROM part GROUP BY p_brand
""")
def worktree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a fingerprint of each working tree's sorted paths."""
    paths = F.array_sort(F.collect_list(F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("p_size") > 25).alias("changed"), F.count_if(F.col("p_size") <= 10).alias("untracked"),
        F.sha2(F.array_join(paths, "\n"), 256).alias("fingerprint"),
    )


@query("""
WITH d AS (SELECT l_suppkey AS uses, l_partkey AS module FROM lineitem)
SELECT module, count(DISTINCT uses) AS dependents, min(uses) AS first_dependent FROM d GROUP BY module
""")
def workspace_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse dependencies: who requires each module."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("uses"), F.col("l_partkey").alias("module"))
    return d.groupBy("module").agg(F.countDistinct("uses").alias("dependents"), F.min("uses").alias("first_dependent"))


@query("""
WITH c AS (SELECT DISTINCT l_partkey AS symbol, l_orderkey AS caller FROM lineitem WHERE l_quantity > 45),
x AS (SELECT p_partkey AS symbol, p_name AS name FROM part WHERE p_size <= 10)
SELECT x.symbol, x.name, count(c.caller) AS callers FROM x LEFT JOIN c USING (symbol) GROUP BY 1, 2
""")
def xref_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("caller")).distinct()
    exports = table(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"))
    return exports.join(calls, "symbol", "left").groupBy("symbol", "name").agg(F.count("caller").alias("callers"))


@query("""
WITH x AS (SELECT p_partkey AS symbol FROM part WHERE p_size <= 3), r AS (SELECT DISTINCT l_partkey AS symbol, l_orderkey AS file FROM lineitem),
c AS (SELECT o_orderkey AS file, o_custkey AS agent FROM orders WHERE o_orderstatus = 'O')
SELECT agent, count(DISTINCT symbol) AS symbols, count(DISTINCT file) AS files FROM x JOIN r USING (symbol) JOIN c USING (file) GROUP BY agent
""")
def affected_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed exports, their call sites, and the agents that claim those files."""
    x = table(spark, sf_dir, "part").filter("p_size <= 3").select(F.col("p_partkey").alias("symbol"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("file")).distinct()
    c = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("agent"))
    return r.join(x, "symbol").join(c, "file").groupBy("agent").agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("file").alias("files"))


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'F'""")
def tasks_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open tasks of each assignee by priority, then newest first."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").filter("o_orderstatus != 'F'").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT l_orderkey AS plan, l_linenumber AS step, l_returnflag || l_linestatus AS status FROM lineitem""")
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with nested steps, unfolded to one row per step."""
    steps = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("step"), F.concat("l_returnflag", "l_linestatus").alias("status"))))
    plans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan")).agg(steps.alias("steps"))
    return plans.select("plan", F.explode("steps").alias("s")).select("plan", "s.step", "s.status")


@query("""SELECT o_custkey AS author, count(*) AS commits, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey) AS titles FROM orders GROUP BY o_custkey""")
def shortlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    newest = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"), "o_orderkey")))
    titles = F.array_join(F.transform(newest, lambda r: r["o_orderkey"].cast("string")), ",")
    return o.groupBy(F.col("o_custkey").alias("author")).agg(F.count(F.lit(1)).alias("commits"), titles.alias("titles"))


@query("""
WITH l AS (SELECT user_id, arg_max(event_type, ts) AS last, max(ts) AS seen_at, min(ts) AS since FROM events GROUP BY user_id)
SELECT user_id, since, seen_at FROM l WHERE last <> 'error'
""")
def agents_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents that are there: their last event is no departure; since when, and last seen."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("last"), F.max("ts").alias("seen_at"), F.min("ts").alias("since"))
    return e.filter("last != 'error'").select("user_id", "since", "seen_at")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS holder, o_custkey % 3 = 0 AS moved FROM orders
""")
def claims_transferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims handed over: only the present holder can hand one on."""
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("owner"))
    asked = claims.select("o_orderkey", F.when(F.col("owner") % 3 == 0, F.col("owner")).otherwise(F.col("owner") + 9).alias("from"), (F.col("owner") + 1).alias("to"))
    moved = F.col("owner") == F.col("from")
    return claims.join(asked, "o_orderkey").select("o_orderkey", F.when(moved, F.col("to")).otherwise(F.col("owner")).alias("holder"), moved.alias("moved"))


@query("""
SELECT event_id % 97 AS spawn, CASE WHEN bool_or(event_type = 'purchase') THEN 'finished' WHEN bool_or(event_type = 'view') THEN 'active' ELSE 'authorized' END AS status,
  arg_min(user_id, ts) FILTER (event_type IN ('view', 'purchase')) AS child, max(ts) FILTER (event_type IN ('view', 'purchase')) AS heartbeat_at FROM events GROUP BY 1
""")
def spawn_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child agents from their touches and ends: the first that touches one is the child, an end is final."""
    e = table(spark, sf_dir, "events")
    alive = F.col("event_type").isin("view", "purchase")
    status = F.when(F.bool_or(F.col("event_type") == "purchase"), "finished").when(F.bool_or(F.col("event_type") == "view"), "active").otherwise("authorized")
    return e.groupBy((F.col("event_id") % 97).alias("spawn")).agg(
        status.alias("status"), F.min_by("user_id", F.when(alive, F.col("ts"))).alias("child"), F.max(F.when(alive, F.col("ts"))).alias("heartbeat_at")
    )


@query("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY length(text) DESC, conv_id, turn) AS place FROM conversations
""")
def notes_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each role, the longest first."""
    w = Window.partitionBy("role").orderBy(F.desc(F.length("text")), "conv_id", "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT l_partkey AS file, count(*) AS claims, min(l_suppkey) AS first_holder FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey""")
def claims_for_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims on each file."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return li.groupBy(F.col("l_partkey").alias("file")).agg(F.count(F.lit(1)).alias("claims"), F.min("l_suppkey").alias("first_holder"))
