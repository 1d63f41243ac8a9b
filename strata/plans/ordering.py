"""Scalar and order-sensitive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import scalars as S
from strata.functions import text as T
from strata.operators import ordered
from strata.plans.registry import query, table


@query(r"""
WITH c AS (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role, name, sig ORDER BY turn) - 1 AS o, name, sig
  FROM (SELECT conv_id, turn, role, split_part(text, ' ', 1) AS name,
          CASE WHEN text LIKE '%?%' THEN trim(regexp_replace(text[1:20], '\s+', ' ', 'g')) ELSE '-' END AS sig FROM conversations)),
k AS (
  SELECT *, CASE WHEN role = 'user' THEN concat('decl:', 'function_item', ':', role, ':', name, ':', CASE WHEN sig = '' THEN '-' ELSE sig END, ':', CAST(o AS VARCHAR)) END AS own FROM c)
SELECT conv_id, turn, coalesce(own, 'between:' ||
  coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || ':' ||
  coalesce(first_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')) AS identity
FROM k
""")
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity keys of a conversation's turns: user turns as declarations, the others as what lies between them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.substring_index("text", " ", 1).alias("name"), "text")
    c = c.withColumn("sig", F.when(F.col("text").contains("?"), F.left("text", F.lit(20))).otherwise(""))
    c = ordered.ordinals(c.withColumn("same", T.normalized(F.col("sig"))), ["conv_id", "role", "name", "same"], "turn")
    kind = F.when(F.col("role") == "user", "declaration").otherwise("interstitial")
    parts = (F.lit("function_item"), F.col("role"), F.col("name"), F.col("sig"), F.col("ordinal"))
    none = F.lit(None).cast("string")
    c = c.withColumn("kind", kind).withColumn("own", T.identity_key(kind, *parts, none, none))
    c = ordered.neighbours(c, "conv_id", "turn", "own", F.col("kind") != "interstitial")
    return c.select("conv_id", "turn", T.identity_key(F.col("kind"), *parts, F.col("prev_key"), F.col("next_key")).alias("identity"))


@query("""
SELECT doc_id, trim(regexp_replace(split_part(split_part(trim(text, E' \\t\\n\\r'), '{', 1), E'\\n', 1), '\\s+', ' ', 'g')) AS signature FROM documents
""".replace("\\\\", "\\"))
def signature_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.signature(F.col("text")).alias("signature"))


@query("""SELECT doc_id, sha256(concat('blob ', CAST(strlen(text) AS VARCHAR), chr(0), text)) AS hash FROM documents""")
def object_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.object_hash(F.lit("blob"), F.col("text")).alias("hash"))


@query("""
WITH o AS (SELECT doc_id, text, CASE WHEN doc_id % 50 = 7 THEN repeat('0', 64) ELSE sha256(text) END AS stored FROM documents)
SELECT count(*) AS objects, count(*) FILTER (stored <> sha256(text)) AS corrupt, count(DISTINCT stored) AS hashes FROM o
""")
def integrity_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hashes against recomputed ones; every fiftieth stored hash is damaged."""
    stored = F.when(F.col("doc_id") % 50 == 7, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("text", 256))
    o = table(spark, sf_dir, "documents").select(stored.alias("stored"), F.sha2("text", 256).alias("real"))
    return o.agg(F.count(F.lit(1)).alias("objects"), F.count_if(F.col("stored") != F.col("real")).alias("corrupt"), F.countDistinct("stored").alias("hashes"))


@query("""
SELECT p_partkey, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'tsx' THEN 'typescript' WHEN 'h' THEN 'c' WHEN 'hpp' THEN 'cpp' WHEN 'jsx' THEN 'javascript' ELSE '' END AS lang
FROM (SELECT p_partkey, p_brand || '/' || CAST(p_partkey AS VARCHAR) || CASE p_partkey % 8 WHEN 0 THEN '.go' WHEN 1 THEN '.PY' WHEN 2 THEN '.rs' WHEN 3 THEN '.tsx' WHEN 4 THEN '.h' WHEN 5 THEN '.hpp' WHEN 6 THEN '.jsx' ELSE '.md' END AS path FROM part)
""".replace("\\\\", "\\"))
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".go", ".PY", ".rs", ".tsx", ".h", ".hpp", ".jsx", ".md"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    path = F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), ending)
    return table(spark, sf_dir, "part").select("p_partkey", T.language(path).alias("lang"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'src/' || source ELSE 'src/' || source || '/x' END AS path,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang || '::' || CAST(n_chars AS VARCHAR) END AS key FROM documents
""")
def selector_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity selectors cut at their first double colon; the key may hold more of them."""
    whole = F.concat(F.lit("src/"), "source", F.lit("/x::"), "lang", F.lit("::"), F.col("n_chars").cast("string"))
    selector = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("src/"), "source")).otherwise(whole)
    path, key = T.split_selector(selector)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), key.alias("key"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Name' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'M' || o_orderstatus ELSE 'T' || o_orderstatus END AS name FROM orders
""")
def change_key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Name"), F.col("o_custkey").cast("string"))
    keys = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("decl:func:-:"), name, F.lit(":sig:0")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("method:Recv.M"), "o_orderstatus"))
        .otherwise(F.concat(F.lit("type:T"), "o_orderstatus"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.key_name(keys).alias("name"))


@query("""SELECT doc_id, sha256(text) AS oid, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE doc_id % 3 <> 0""")
def lfs_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large-file pointers written and read back; every third document is no pointer."""
    d = table(spark, sf_dir, "documents")
    written = T.lfs_pointer_text(F.sha2("text", 256), F.octet_length("text").cast("long"))
    content = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(written)
    return d.select("doc_id", T.lfs_pointer(content).alias("p")).filter("p IS NOT NULL").select("doc_id", "p.oid", "p.size")


@query("""SELECT n, CAST(CASE WHEN n <= 1 THEN 0 ELSE ceil(log2(n)) END AS BIGINT) AS steps FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS n FROM part)""")
def bisect_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    return n.select("n", T.bisect_steps(F.col("n")).alias("steps"))


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM conversations
""")
def anchor_insertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordered.anchors(c, "conv_id", "turn", "turn", F.col("role") == "user").select("conv_id", "turn", "anchor")


@query("""
SELECT conv_id, turn,
  last_value(CASE WHEN role <> 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_key,
  first_value(CASE WHEN role <> 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_key
FROM conversations
""")
def neighbor_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ordered.neighbours(c, "conv_id", "turn", "turn", F.col("role") != "user").select("conv_id", "turn", "prev_key", "next_key")


@query("""SELECT user_id, event_type, arg_min(event_id, ts) AS event_id FROM events GROUP BY user_id, event_type""")
def first_seen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return ordered.first_seen(e, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query("""
WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 1 ELSE 0 END AS f FROM events),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY user_id, island
""")
def heartbeat_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of one type collapsed, per user."""
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts"))
    e = table(spark, sf_dir, "events").withColumn("breaks", ~F.col("event_type").eqNullSafe(before))
    return ordered.islands(e, "user_id", "ts", F.col("breaks")).groupBy("user_id", "island").agg(
        F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("""
WITH l AS (SELECT l_orderkey AS file, l_linenumber * (1 + l_partkey % 9) AS line FROM lineitem),
d AS (SELECT DISTINCT file, line FROM l),
f AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY file ORDER BY line) <= 6 THEN 0 ELSE 1 END AS s FROM d),
h AS (SELECT *, sum(s) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING) AS hunk FROM f)
SELECT file, CAST(hunk AS BIGINT) AS hunk, min(line) AS first, max(line) AS last, count(*) AS n FROM h GROUP BY file, hunk
""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = (F.col("l_linenumber") * (1 + F.col("l_partkey") % 9)).alias("line")
    changed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), line).distinct()
    return ordered.hunks(changed, "file", "line")


TRACE_TYPES = ("spawn_authorized", "spawn_started", "action_exec_started", "action_exec_finished", "spawn_finished", "note", "spawn_heartbeat", "action_preflight_blocked")


@query("""
WITH p AS (SELECT event_id, user_id, CASE event_id % 8 WHEN 0 THEN 'authorization' WHEN 1 THEN 'activation' WHEN 6 THEN 'activation'
  WHEN 4 THEN 'completion' WHEN 5 THEN 'other' ELSE 'execution' END AS phase FROM events)
SELECT user_id, phase, count(*) AS n, min(event_id) AS first_event FROM p GROUP BY user_id, phase
""")
def phase_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events by the phase of their type, with where each phase begins."""
    kind = F.element_at(F.array(*map(F.lit, TRACE_TYPES)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").withColumn("phase", S.phase(kind)).groupBy("user_id", "phase").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")
    )


@query("""
WITH d AS (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS before FROM d)
SELECT event_type, CAST(day AS VARCHAR) AS day, n, before FROM l WHERE n IS DISTINCT FROM before
""")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a type's count differs from the day's before: polled state, reported on change."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    return d.withColumn("before", before).filter(~F.col("n").eqNullSafe(F.col("before"))).select("event_type", F.col("day").cast("string").alias("day"), "n", "before")


@query("""
WITH t AS (SELECT conv_id, turn, split_part(text, ' ', 1) AS title, CASE WHEN turn % 3 = 2 THEN turn - 2 END AS target FROM conversations),
k AS (SELECT t.conv_id, t.turn, coalesce(m.turn, t.turn) AS a, CASE WHEN m.turn IS NULL THEN 0 ELSE 1 END AS b
      FROM t LEFT JOIN t m ON t.conv_id = m.conv_id AND t.target = m.turn)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY a, b, turn) AS place FROM k
""")
def autosquash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Todo rows moved right behind the row they fix up, otherwise in order."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn").withColumn("target", F.when(F.col("turn") % 3 == 2, F.col("turn") - 2))
    m = t.select("conv_id", F.col("turn").alias("target"), F.lit(True).alias("found"))
    k = t.join(m, ["conv_id", "target"], "left")
    order = [F.when(F.col("found"), F.col("target")).otherwise(F.col("turn")), F.coalesce("found", F.lit(False)), F.col("turn")]
    return k.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long").alias("place"))


@query("""SELECT doc_id, text AS rebuilt FROM documents""")
def line_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into lines and put together again: the identity."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    ordered_lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(ordered_lines["line"], "\n").alias("rebuilt"))
