"""Diff, status, merge and rename queries over snapshots of the driver's tables.

Snapshots are projections of ``orders``, ``part`` and ``documents`` to a key and
a hash; the two sides are arithmetic edits of the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.matching import match2, match3, merge_sets, pair_by_rank, resolve, unique_match
from strata.plans.registry import query, table


def _content(tag: Column) -> Column:
    return F.md5(F.concat_ws("|", F.col("o_orderstatus"), F.col("o_custkey").cast("string"), tag))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base, ours and theirs of the orders: edits, deletions and additions on either side."""
    o = table(spark, sf_dir, "orders").withColumn("key", F.col("o_orderkey"))
    k = F.col("key")
    in_base = k % 10 != 9
    base = o.filter(in_base).select("key", _content(F.lit("v0")).alias("hash"))
    ours_tag = F.when((k % 30 == 0), "both").when(k % 5 == 0, "ours").otherwise("v0")
    theirs_tag = F.when((k % 30 == 0), "both").when(k % 3 == 0, "theirs").otherwise("v0")
    ours = o.filter((in_base & (k % 13 != 0)) | (k % 40 == 9)).select("key", _content(ours_tag).alias("hash"))
    theirs = o.filter((in_base & (k % 17 != 0)) | (k % 20 == 9)).select("key", _content(theirs_tag).alias("hash"))
    return base, ours, theirs


SIDES_SQL = """
WITH o AS (SELECT o_orderkey AS key, o_orderstatus || '|' || CAST(o_custkey AS VARCHAR) || '|' AS c FROM orders),
base AS (SELECT key, md5(c || 'v0') AS hash FROM o WHERE key % 10 <> 9),
ours AS (SELECT key, md5(c || CASE WHEN key % 30 = 0 THEN 'both' WHEN key % 5 = 0 THEN 'ours' ELSE 'v0' END) AS hash
         FROM o WHERE (key % 10 <> 9 AND key % 13 <> 0) OR key % 40 = 9),
theirs AS (SELECT key, md5(c || CASE WHEN key % 30 = 0 THEN 'both' WHEN key % 3 = 0 THEN 'theirs' ELSE 'v0' END) AS hash
           FROM o WHERE (key % 10 <> 9 AND key % 17 <> 0) OR key % 20 = 9)
"""
MATCH3_SQL = SIDES_SQL + """
, m AS (
  SELECT key, b.hash AS base_hash, x.hash AS ours_hash, t.hash AS theirs_hash
  FROM base b FULL JOIN ours x USING (key) FULL JOIN theirs t USING (key)),
d AS (
  SELECT *, CASE
    WHEN base_hash IS NULL AND theirs_hash IS NULL THEN 'AddedOurs'
    WHEN base_hash IS NULL AND ours_hash IS NULL THEN 'AddedTheirs'
    WHEN base_hash IS NULL THEN CASE WHEN ours_hash = theirs_hash THEN 'BothSame' ELSE 'Conflict' END
    WHEN ours_hash IS NULL AND theirs_hash IS NULL THEN 'Unchanged'
    WHEN ours_hash IS NULL THEN CASE WHEN theirs_hash = base_hash THEN 'DeletedOurs' ELSE 'DeleteVsModify' END
    WHEN theirs_hash IS NULL THEN CASE WHEN ours_hash = base_hash THEN 'DeletedTheirs' ELSE 'DeleteVsModify' END
    WHEN ours_hash = base_hash AND theirs_hash = base_hash THEN 'Unchanged'
    WHEN theirs_hash = base_hash THEN 'OursOnly'
    WHEN ours_hash = base_hash THEN 'TheirsOnly'
    WHEN ours_hash = theirs_hash THEN 'BothSame' ELSE 'Conflict' END AS disposition
  FROM m)
"""
RESOLVE_SQL = """
, r AS (
  SELECT *, CASE
    WHEN disposition IN ('OursOnly', 'AddedOurs', 'BothSame') THEN 'ours'
    WHEN disposition IN ('TheirsOnly', 'AddedTheirs') THEN 'theirs'
    WHEN disposition = 'Unchanged' THEN CASE WHEN ours_hash IS NULL THEN 'gone' ELSE 'base' END
    WHEN disposition IN ('Conflict', 'DeleteVsModify') THEN CASE WHEN ours_hash IS NULL THEN 'theirs' ELSE 'ours' END
    ELSE 'gone' END AS side
  FROM d)
SELECT key, CASE side WHEN 'theirs' THEN theirs_hash WHEN 'ours' THEN ours_hash ELSE base_hash END AS hash, side,
       disposition IN ('Conflict', 'DeleteVsModify') AS conflict
FROM r WHERE side <> 'gone'
"""


@query(MATCH3_SQL + "SELECT key, base_hash, ours_hash, theirs_hash, disposition FROM d")
def match3_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match3(*_sides(spark, sf_dir))


@query(MATCH3_SQL + "SELECT disposition, count(*) AS n FROM d GROUP BY disposition")
def match3_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match3(*_sides(spark, sf_dir)).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@query(MATCH3_SQL + RESOLVE_SQL)
def merge_resolve_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(match3(*_sides(spark, sf_dir)))


@query(MATCH3_SQL.replace("base b FULL JOIN ours x USING (key) FULL JOIN theirs t", "theirs b FULL JOIN ours x USING (key) FULL JOIN base t") + RESOLVE_SQL)
def revert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo ``theirs`` in ours: the three-way merge whose base is the commit and whose other side its parent."""
    base, ours, theirs = _sides(spark, sf_dir)
    return resolve(match3(theirs, ours, base))


@query(MATCH3_SQL.replace("base b FULL JOIN ours x USING (key) FULL JOIN theirs t", "base b FULL JOIN theirs x USING (key) FULL JOIN ours t") + RESOLVE_SQL)
def cherry_pick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the change base -> ours on top of theirs (stash apply has the same roles)."""
    base, ours, theirs = _sides(spark, sf_dir)
    return resolve(match3(base, theirs, ours))


@query(SIDES_SQL + """
SELECT key, b.hash AS before_hash, a.hash AS after_hash,
  CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM base b FULL JOIN ours a USING (key) WHERE b.hash IS DISTINCT FROM a.hash
""")
def commit_diff_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = _sides(spark, sf_dir)
    return match2(base, ours)


@query("""
WITH b AS (SELECT p_partkey AS key, md5(p_name || '|' || p_brand) AS hash FROM part WHERE p_partkey % 8 <> 0),
a AS (SELECT p_partkey AS key, md5(p_name || '|' || CASE WHEN p_size % 4 = 0 THEN 'x' ELSE p_brand END) AS hash FROM part WHERE p_partkey % 9 <> 0)
SELECT key, b.hash AS before_hash, a.hash AS after_hash,
  CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM b FULL JOIN a USING (key) WHERE b.hash IS DISTINCT FROM a.hash
""")
def diff2_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("key", F.col("p_partkey"))
    edited = F.when(F.col("p_size") % 4 == 0, "x").otherwise(F.col("p_brand"))
    before = p.filter("key % 8 != 0").select("key", F.md5(F.concat_ws("|", "p_name", "p_brand")).alias("hash"))
    after = p.filter("key % 9 != 0").select("key", F.md5(F.concat_ws("|", F.col("p_name"), edited)).alias("hash"))
    return match2(before, after)


@query("""
WITH e AS (SELECT p_brand AS path, p_type || ':' || p_name AS entity, p_partkey AS pos, p_size, p_retailprice FROM part),
b AS (SELECT path, entity, arg_max(md5(CAST(p_size AS VARCHAR)), pos) AS hash FROM e WHERE pos % 6 <> 0 GROUP BY path, entity),
a AS (SELECT path, entity, arg_max(md5(CAST(p_size + CASE WHEN pos % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR)), pos) AS hash
      FROM e WHERE pos % 11 <> 0 GROUP BY path, entity)
SELECT path, entity, CASE WHEN b.hash IS NULL THEN 'create' WHEN a.hash IS NULL THEN 'delete' ELSE 'modify' END AS change
FROM b FULL JOIN a USING (path, entity) WHERE b.hash IS DISTINCT FROM a.hash
""")
def entity_diff_kindname(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity changes by kind and name within a path; of colliding names the last of the list counts."""
    e = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("path"), F.concat_ws(":", "p_type", "p_name").alias("entity"), F.col("p_partkey").alias("pos"), "p_size"
    )
    more = F.when(F.col("pos") % 10 == 0, 1).otherwise(0)

    def listed(df: DataFrame, size: Column, name: str) -> DataFrame:
        return df.groupBy("path", "entity").agg(F.max_by(F.md5(size.cast("string")), "pos").alias(name))

    before = listed(e.filter("pos % 6 != 0"), F.col("p_size"), "before")
    after = listed(e.filter("pos % 11 != 0"), F.col("p_size") + more, "after")
    change = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "delete").otherwise("modify")
    return (
        before.join(after, ["path", "entity"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
        .select("path", "entity", change.alias("change"))
    )


@query("""
WITH h AS (SELECT p_partkey AS path, md5(p_name) AS hash FROM part WHERE p_partkey % 7 <> 0),
s AS (SELECT p_partkey AS path, md5(CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END) AS hash FROM part WHERE p_partkey % 11 <> 0),
w AS (SELECT p_partkey AS path, md5(CASE WHEN p_partkey % 5 = 0 THEN p_brand WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END) AS hash
      FROM part WHERE p_partkey % 13 <> 0),
j AS (SELECT path, h.hash AS head, s.hash AS staged, w.hash AS work FROM h FULL JOIN s USING (path) FULL JOIN w USING (path)),
c AS (
  SELECT path,
    CASE WHEN head IS NULL AND staged IS NOT NULL THEN 'new' WHEN head IS NOT NULL AND staged IS NULL THEN 'deleted'
         WHEN head IS DISTINCT FROM staged THEN 'modified' ELSE 'clean' END AS index_status,
    CASE WHEN staged IS NULL AND work IS NOT NULL THEN 'untracked' WHEN staged IS NOT NULL AND work IS NULL THEN 'deleted'
         WHEN staged IS DISTINCT FROM work THEN 'dirty' ELSE 'clean' END AS work_status
  FROM j)
SELECT * FROM c WHERE index_status <> 'clean' OR work_status <> 'clean'
""")
def status_3src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, index and working tree joined on path: what is staged and what is not."""
    p = table(spark, sf_dir, "part").withColumn("path", F.col("p_partkey"))
    k = F.col("path")
    staged_text = F.when(k % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    work_text = F.when(k % 5 == 0, F.col("p_brand")).when(k % 3 == 0, F.col("p_type")).otherwise(F.col("p_name"))
    head = p.filter("path % 7 != 0").select("path", F.md5("p_name").alias("head"))
    staged = p.filter("path % 11 != 0").select("path", F.md5(staged_text).alias("staged"))
    work = p.filter("path % 13 != 0").select("path", F.md5(work_text).alias("work"))
    h, s, w = F.col("head"), F.col("staged"), F.col("work")
    index_status = (
        F.when(h.isNull() & s.isNotNull(), "new").when(h.isNotNull() & s.isNull(), "deleted")
        .when(~h.eqNullSafe(s), "modified").otherwise("clean")
    )
    work_status = (
        F.when(s.isNull() & w.isNotNull(), "untracked").when(s.isNotNull() & w.isNull(), "deleted")
        .when(~s.eqNullSafe(w), "dirty").otherwise("clean")
    )
    return (
        head.join(staged, "path", "full_outer").join(work, "path", "full_outer")
        .select("path", index_status.alias("index_status"), work_status.alias("work_status"))
        .filter("index_status != 'clean' OR work_status != 'clean'")
    )


@query("""
WITH d AS (SELECT sha256(text) AS hash, doc_id FROM documents),
o AS (SELECT hash, doc_id, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS nth FROM d WHERE doc_id % 2 = 0),
n AS (SELECT hash, doc_id, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS nth FROM d WHERE doc_id % 2 = 1)
SELECT o.hash, o.doc_id AS old, n.doc_id AS new FROM o JOIN n ON o.hash = n.hash AND o.nth = n.nth
""")
def rename_rank_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed (even) and added (odd) documents of equal content, paired one to one."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return pair_by_rank(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "hash", "doc_id")


@query("""
WITH p AS (SELECT p_partkey AS id, p_brand AS kind, p_type || '|' || CAST(p_size AS VARCHAR) AS body FROM part),
l AS (SELECT kind, body, min(id) AS child FROM p WHERE id % 2 = 0 GROUP BY kind, body HAVING count(*) = 1),
r AS (SELECT kind, body, min(id) AS parent FROM p WHERE id % 2 = 1 GROUP BY kind, body HAVING count(*) = 1)
SELECT child, parent FROM l JOIN r USING (kind, body)
""")
def continuity_unique_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.concat_ws("|", F.col("p_type"), F.col("p_size").cast("string")).alias("body")
    )
    child = p.filter("id % 2 = 0").withColumnRenamed("id", "child")
    parent = p.filter("id % 2 = 1").withColumnRenamed("id", "parent")
    return unique_match(child, parent, ["kind", "body"], "child", "parent")


@query("""
WITH p AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS typ, p_size AS size FROM part),
c AS (SELECT * FROM p WHERE id % 3 = 1), q AS (SELECT * FROM p WHERE id % 3 = 2),
l1 AS (SELECT id AS child, id + 1 AS parent FROM c WHERE id % 5 = 0 AND id + 1 IN (SELECT id FROM q)),
l2 AS (SELECT a.child, b.parent FROM (SELECT brand, typ, size, min(id) AS child FROM c GROUP BY 1, 2, 3 HAVING count(*) = 1) a
       JOIN (SELECT brand, typ, size, min(id) AS parent FROM q GROUP BY 1, 2, 3 HAVING count(*) = 1) b USING (brand, typ, size)),
l3 AS (SELECT a.child, b.parent FROM (SELECT typ, size, min(id) AS child FROM c GROUP BY 1, 2 HAVING count(*) = 1) a
       JOIN (SELECT typ, size, min(id) AS parent FROM q GROUP BY 1, 2 HAVING count(*) = 1) b USING (typ, size))
SELECT c.id AS child, coalesce(l1.parent, l2.parent, l3.parent) AS parent,
  CASE WHEN l1.parent IS NOT NULL THEN 'locator' WHEN l2.parent IS NOT NULL THEN 'body' WHEN l3.parent IS NOT NULL THEN 'signature' ELSE 'none' END AS via
FROM c LEFT JOIN l1 ON c.id = l1.child LEFT JOIN l2 ON c.id = l2.child LEFT JOIN l3 ON c.id = l3.child
""")
def continuity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity's parent version: by its exact locator, else a unique body, else a unique signature."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("typ"), F.col("p_size").alias("size"))
    child = p.filter("p_partkey % 3 = 1").withColumnRenamed("p_partkey", "child")
    parent = p.filter("p_partkey % 3 = 2").withColumnRenamed("p_partkey", "parent")
    exact = child.filter("child % 5 = 0").select("child", (F.col("child") + 1).alias("parent")).join(parent.select("parent"), "parent")
    levels = [
        ("locator", exact),
        ("body", unique_match(child, parent, ["brand", "typ", "size"], "child", "parent")),
        ("signature", unique_match(child, parent, ["typ", "size"], "child", "parent")),
    ]
    out = child.select("child")
    for name, found in levels:
        out = out.join(found.select("child", F.col("parent").alias(name)), "child", "left")
    via = F.lit("none")
    for name, _ in reversed(levels):
        via = F.when(F.col(name).isNotNull(), name).otherwise(via)
    return out.select("child", F.coalesce(*(name for name, _ in levels)).alias("parent"), via.alias("via"))


@query("""
WITH l AS (SELECT l_orderkey AS file, l_partkey % 50 AS m, l_linenumber AS n FROM lineitem),
b AS (SELECT DISTINCT file, m FROM l WHERE n <> 4), o AS (SELECT DISTINCT file, m FROM l WHERE n <> 1), t AS (SELECT DISTINCT file, m FROM l WHERE n <> 2),
f AS (SELECT DISTINCT file FROM l),
k AS (SELECT file, m FROM (SELECT * FROM o UNION SELECT * FROM t) x
      WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.file = x.file AND b.m = x.m AND (
        NOT EXISTS (SELECT 1 FROM o WHERE o.file = x.file AND o.m = x.m) OR NOT EXISTS (SELECT 1 FROM t WHERE t.file = x.file AND t.m = x.m))))
SELECT f.file, coalesce(string_agg(CAST(k.m AS VARCHAR), ',' ORDER BY k.m), '') AS merged FROM f LEFT JOIN k USING (file) GROUP BY f.file
""")
def import_set_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import sets of a file merged three ways; each order is a file, its parts are the imports."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 50).alias("m"), F.col("l_linenumber").alias("n"))

    def members(keep: Column, name: str) -> Column:
        return F.collect_set(F.when(keep, F.col("m"))).alias(name)

    n = F.col("n")
    files = lines.groupBy("file").agg(members(n != 4, "base"), members(n != 1, "ours"), members(n != 2, "theirs"))
    merged = merge_sets(F.col("base"), F.col("ours"), F.col("theirs"))
    return files.select("file", F.array_join(merged.cast("array<string>"), ",").alias("merged"))


@query("""
WITH f AS (SELECT c_nationkey AS entity, c_custkey AS field, c_mktsegment AS typ FROM customer),
b AS (SELECT * FROM f WHERE field % 10 <> 9),
o AS (SELECT entity, field, CASE WHEN field % 6 = 0 THEN 'O' ELSE typ END AS typ FROM f WHERE field % 7 <> 0),
t AS (SELECT entity, field, CASE WHEN field % 4 = 0 THEN 'T' ELSE typ END AS typ FROM f WHERE field % 11 <> 0),
j AS (SELECT entity, field, b.typ AS bt, o.typ AS ot, t.typ AS tt FROM b FULL JOIN o USING (entity, field) FULL JOIN t USING (entity, field))
SELECT entity, field, CASE WHEN ot = tt THEN ot WHEN ot = bt THEN tt WHEN tt = bt THEN ot ELSE coalesce(ot, tt) END AS typ,
  coalesce(ot <> tt AND ot IS DISTINCT FROM bt AND tt IS DISTINCT FROM bt, FALSE) AS conflict
FROM j WHERE NOT (bt IS NOT NULL AND (ot IS NULL OR tt IS NULL))
""")
def field_set_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of an entity merged three ways by name; one-sided deletion wins, two new types conflict."""
    f = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("entity"), F.col("c_custkey").alias("field"), F.col("c_mktsegment").alias("typ"))
    k = F.col("field")
    base = f.filter(k % 10 != 9).withColumnRenamed("typ", "bt")
    ours = f.filter(k % 7 != 0).select("entity", "field", F.when(k % 6 == 0, "O").otherwise(F.col("typ")).alias("ot"))
    theirs = f.filter(k % 11 != 0).select("entity", "field", F.when(k % 4 == 0, "T").otherwise(F.col("typ")).alias("tt"))
    b, o, t = F.col("bt"), F.col("ot"), F.col("tt")
    merged = F.when(o == t, o).when(o == b, t).when(t == b, o).otherwise(F.coalesce(o, t))
    conflict = (o != t) & ~o.eqNullSafe(b) & ~t.eqNullSafe(b)
    return (
        base.join(ours, ["entity", "field"], "full_outer").join(theirs, ["entity", "field"], "full_outer")
        .filter(~(b.isNotNull() & (o.isNull() | t.isNull())))
        .select("entity", "field", merged.alias("typ"), F.coalesce(conflict, F.lit(False)).alias("conflict"))
    )


@query(MATCH3_SQL + """
, g AS (SELECT key, CAST(floor(log2(greatest(key, 1))) AS BIGINT) AS gen FROM o)
SELECT d.key, CASE WHEN disposition = 'Conflict' THEN CASE WHEN gen % 2 = 0 THEN ours_hash ELSE theirs_hash END
  WHEN disposition IN ('TheirsOnly', 'AddedTheirs') THEN theirs_hash WHEN disposition = 'Unchanged' THEN base_hash ELSE coalesce(ours_hash, theirs_hash) END AS hash
FROM d JOIN g USING (key) WHERE disposition NOT IN ('DeletedOurs', 'DeletedTheirs')
""")
def module_merge_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module pins merged three ways; where both moved, the pin of the greater generation wins."""
    m = match3(*_sides(spark, sf_dir))
    ours_newer = F.floor(F.log2(F.greatest(F.col("key"), F.lit(1)))).cast("long") % 2 == 0
    d = F.col("disposition")
    hash_ = (
        F.when(d == "Conflict", F.when(ours_newer, F.col("ours_hash")).otherwise(F.col("theirs_hash")))
        .when(d.isin("TheirsOnly", "AddedTheirs"), F.col("theirs_hash"))
        .when(d == "Unchanged", F.col("base_hash"))
        .otherwise(F.coalesce("ours_hash", "theirs_hash"))
    )
    return m.filter(~d.isin("DeletedOurs", "DeletedTheirs")).select("key", hash_.alias("hash"))
