"""Composite queries: reviews, module and pointer status, clean paths, push reports, coordination context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import rules
from strata.operators.matching import match2
from strata.plans.registry import query, table


@query("""
WITH b AS (SELECT p_partkey AS key, p_brand, p_size AS v FROM part WHERE p_partkey % 8 <> 0),
a AS (SELECT p_partkey AS key, p_brand, CASE WHEN p_partkey % 4 = 1 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 9 <> 0)
SELECT coalesce(b.p_brand, a.p_brand) AS file, count(*) FILTER (b.key IS NULL) AS added, count(*) FILTER (a.key IS NULL) AS removed,
  count(*) FILTER (b.v <> a.v) AS modified FROM b FULL JOIN a USING (key) WHERE b.v IS DISTINCT FROM a.v GROUP BY 1
""")
def format_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities added, removed and modified in each file."""
    p = table(spark, sf_dir, "part").withColumn("key", F.struct(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id")))
    size = F.when(F.col("p_partkey") % 4 == 1, F.col("p_size") + 1).otherwise(F.col("p_size"))
    before = p.filter("p_partkey % 8 != 0").select("key", F.col("p_size").alias("hash"))
    after = p.filter("p_partkey % 9 != 0").select("key", size.alias("hash"))
    changed = match2(before, after)
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")]
    return changed.groupBy(F.col("key.file").alias("file")).agg(*counts)


@query("""
WITH c AS (SELECT s_suppkey AS name, s_nationkey AS track FROM supplier), l AS (SELECT s_suppkey AS name, s_suppkey * 7 % 5 AS pin FROM supplier WHERE s_suppkey % 4 <> 0),
h AS (SELECT s_suppkey AS name, s_suppkey % 5 AS head FROM supplier WHERE s_suppkey % 6 <> 0)
SELECT name, track, pin, head, coalesce(pin = head, FALSE) AS synced FROM c LEFT JOIN l USING (name) LEFT JOIN h USING (name)
""")
def module_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared modules with their locked pin, what is checked out, and whether the two agree."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("track"))
    lock = s.filter("name % 4 != 0").select("name", (F.col("name") * 7 % 5).alias("pin"))
    head = s.filter("name % 6 != 0").select("name", (F.col("name") % 5).alias("head"))
    synced = F.coalesce(F.col("pin") == F.col("head"), F.lit(False))
    return s.join(lock, "name", "left").join(head, "name", "left").select("name", "track", "pin", "head", synced.alias("synced"))


@query("""
WITH p AS (SELECT doc_id, sha256(text) AS oid FROM documents), s AS (SELECT DISTINCT sha256(text) AS oid FROM documents WHERE doc_id % 3 = 0)
SELECT p.doc_id, p.oid, s.oid IS NOT NULL AS has_content FROM p LEFT JOIN s USING (oid)
""")
def lfs_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large-file pointers and whether the object store holds their content."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("oid"))
    stored = p.filter("doc_id % 3 = 0").select("oid").distinct().withColumn("held", F.lit(True))
    return p.join(stored, "oid", "left").select("doc_id", "oid", F.coalesce("held", F.lit(False)).alias("has_content"))


@query("""
SELECT path FROM (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents)
WHERE doc_id % 5 <> 0 AND NOT regexp_matches(path, '(^|/)[^/]*7(/|$)')
""")
def clean_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the working tree that are neither tracked nor ignored."""
    work = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")).alias("path"))
    tracked = work.filter("doc_id % 5 = 0").select("path")
    return work.join(tracked, "path", "left_anti").filter(~rules.ignored(F.col("path"), [rules.PathRule("*7")])).select("path")


@query("""
WITH n AS (SELECT o_orderkey AS name, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END AS tag, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1000000 END AS branch FROM orders)
SELECT name, coalesce(tag, branch, name) AS target, CASE WHEN tag IS NOT NULL THEN 'tag' WHEN branch IS NOT NULL THEN 'branch' ELSE 'raw' END AS via FROM n
""")
def resolve_treeish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved as a tag, else a branch, else taken as they are."""
    o = table(spark, sf_dir, "orders")
    names = o.select(F.col("o_orderkey").alias("name"))
    tags = o.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("tag"))
    branches = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("name"), (F.col("o_custkey") + 1000000).alias("branch"))
    via = F.when(F.col("tag").isNotNull(), "tag").when(F.col("branch").isNotNull(), "branch").otherwise("raw")
    return names.join(tags, "name", "left").join(branches, "name", "left").select("name", F.coalesce("tag", "branch", "name").alias("target"), via.alias("via"))


@query("""
SELECT source, count(*) AS objects, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(strlen(text)) AS largest, count(*) FILTER (strlen(text) > 8000) AS blockers FROM documents GROUP BY source
""")
def push_limit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects to push per remote: number, bytes, the largest, and those above the limit."""
    d = table(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("size"))
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count_if(F.col("size") > 8000).alias("blockers")
    )


@query("""
WITH f AS (SELECT l_suppkey AS agent, l_partkey AS file FROM lineitem WHERE l_quantity > 48),
c AS (SELECT l_partkey AS file, l_suppkey AS holder FROM lineitem WHERE l_discount > 0.09)
SELECT f.agent, count(DISTINCT f.file) AS files, count(DISTINCT c.holder) AS holders FROM f LEFT JOIN c ON f.file = c.file AND c.holder <> f.agent GROUP BY f.agent
""")
def coord_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each agent the files it touches and the other agents that hold claims on them."""
    li = table(spark, sf_dir, "lineitem")
    f = li.filter("l_quantity > 48").select(F.col("l_suppkey").alias("agent"), F.col("l_partkey").alias("file"))
    c = li.filter("l_discount > 0.09").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("holder"))
    other = F.when(F.col("holder") != F.col("agent"), F.col("holder"))
    return f.join(c, "file", "left").groupBy("agent").agg(F.countDistinct("file").alias("files"), F.countDistinct(other).alias("holders"))


@query("""
WITH e AS (SELECT event_id, user_id, event_id % 97 AS id, event_id % 89 AS spawn_id FROM events), s AS (SELECT CAST(range AS BIGINT) AS spawn, CAST(range * 3 AS BIGINT) AS child FROM range(20))
SELECT s.spawn, count(DISTINCT e.event_id) AS events FROM s JOIN e ON e.id = s.spawn OR e.spawn_id = s.spawn OR e.user_id = s.child GROUP BY s.spawn
""")
def spawn_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a spawn: by their id, their spawn id or the child agent; three equi-joins for the three-way OR."""
    return _traced(_spawn_events(spark, sf_dir), spark.range(20).select(F.col("id").alias("spawn")))


@query()
def spawn_trace_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spawn_trace`` of every spawn that an event names, by its id or its spawn id."""
    e = _spawn_events(spark, sf_dir)
    return _traced(e, e.select(F.explode(F.array("id", "spawn_id")).alias("spawn")).filter("spawn IS NOT NULL").distinct())


def _spawn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", (k % 97).alias("id"), (k % 89).alias("spawn_id"))


def _traced(e: DataFrame, spawns: DataFrame) -> DataFrame:
    s = spawns.select("spawn", (F.col("spawn") * 3).alias("child"))
    found = None
    for left, right in (("spawn", "id"), ("spawn", "spawn_id"), ("child", "user_id")):
        part = s.join(e, s[left] == e[right]).select("spawn", "event_id")
        found = part if found is None else found.union(part)
    return found.distinct().groupBy("spawn").agg(F.count(F.lit(1)).alias("events"))


@query("""
WITH a AS (SELECT o_orderkey, string_split(CASE o_orderkey % 4 WHEN 0 THEN 'git push --force' WHEN 1 THEN 'rm -rf build' WHEN 2 THEN 'curl url' ELSE 'ls -la' END, ' ') AS argv FROM orders)
SELECT o_orderkey, argv[1] = 'curl' OR (argv[1] = 'git' AND list_contains(argv, 'push')) AS network,
  (argv[1] = 'rm' AND list_contains(argv, '-rf')) OR list_contains(argv, '--force') AS destructive, argv[1] IN ('rm') AS writes_fs FROM a
""")
def shell_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands classified by what they may do."""
    k = F.col("o_orderkey") % 4
    line = F.when(k == 0, "git push --force").when(k == 1, "rm -rf build").when(k == 2, "curl url").otherwise("ls -la")
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.split(line, " ").alias("argv"))
    program = F.get("argv", F.lit(0))
    network = (program == "curl") | ((program == "git") & F.array_contains("argv", "push"))
    destructive = ((program == "rm") & F.array_contains("argv", "-rf")) | F.array_contains("argv", "--force")
    return a.select("o_orderkey", network.alias("network"), destructive.alias("destructive"), (program == "rm").alias("writes_fs"))


@query("""
WITH h AS (SELECT doc_id, source, sha256(text) AS blob, text FROM documents), b AS (SELECT DISTINCT blob, text FROM h),
m AS (SELECT blob, len(regexp_extract_all(text, 'Licen[cs]e')) AS hits FROM b)
SELECT h.doc_id, h.blob, CAST(m.hits AS BIGINT) AS hits FROM h JOIN m USING (blob) WHERE m.hits > 0
""")
def history_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches over all versions; every distinct blob is searched once and its hits given to all versions."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("blob"), "text")
    hits = h.groupBy("blob").agg(F.first("text").alias("text")).select("blob", F.regexp_count("text", F.lit("Licen[cs]e")).cast("long").alias("hits"))
    return h.select("doc_id", "blob").join(hits.filter("hits > 0"), "blob").select("doc_id", "blob", "hits")


@query("""
SELECT c_custkey, array_to_string(list_sort(list_intersect(['pack', 'shallow', CASE WHEN c_custkey % 2 = 0 THEN 'filter' ELSE 'zstd' END], ['zstd', 'pack', 'delta'])), ',') AS common FROM customer
""")
def capability_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = F.array(F.lit("pack"), F.lit("shallow"), F.when(F.col("c_custkey") % 2 == 0, "filter").otherwise("zstd"))
    theirs = F.array(*map(F.lit, ("zstd", "pack", "delta")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(F.array_intersect(ours, theirs)), ",").alias("common"))
