"""Versions of files and entities taken from one another: picks, stashes, renames in the status, pointers, signers, foreign hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import code as C
from strata.operators.matching import match2, pair_by_rank
from strata.plans.registry import query, table
from strata.plans.structural import FUNCTION_SQL, LINES_SQL, THEIRS_BODY, V, source_files
from strata.sources.files import parse_signers


@query(f"""
WITH {LINES_SQL}
SELECT 'o' || CAST(k AS VARCHAR) || '.go' AS path, 'package o' || CAST(k AS VARCHAR) || chr(10) || chr(10) ||
  string_agg(CASE WHEN n = 3 THEN {THEIRS_BODY} ELSE {FUNCTION_SQL.format(first=V, last="'x'")} END, chr(10) || chr(10) ORDER BY n) || chr(10) AS text
FROM l GROUP BY k
""")
def cherry_pick_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity taken from another version of the file, by its identity; all else stays."""
    return C.picked(source_files(spark, sf_dir), "F3", into="base", source="theirs")


@query("""
WITH b AS (SELECT o_orderkey AS path, md5(o_orderstatus || CAST(o_custkey AS VARCHAR)) AS hash FROM orders WHERE o_orderkey % 9 <> 4),
s AS (SELECT o_orderkey AS path, md5(o_orderstatus || CAST(o_custkey + CASE WHEN o_orderkey % 6 = 1 THEN 1 ELSE 0 END AS VARCHAR)) AS hash FROM orders WHERE o_orderkey % 8 <> 5)
SELECT path, CASE WHEN b.hash IS NULL THEN 'added' WHEN s.hash IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN s USING (path) WHERE b.hash IS DISTINCT FROM s.hash
""")
def stash_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stash changes against the commit it was made on."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")

    def content(more: int) -> Column:
        return F.md5(F.concat("o_orderstatus", (F.col("o_custkey") + F.when(k % 6 == 1, more).otherwise(0)).cast("string")))

    base = o.filter(k % 9 != 4).select(k.alias("key"), content(0).alias("hash"))
    stash = o.filter(k % 8 != 5).select(k.alias("key"), content(1).alias("hash"))
    return match2(base, stash).select(F.col("key").alias("path"), "change")


@query("""
WITH p AS (SELECT p_partkey AS path, md5(p_type) AS hash, CASE WHEN p_size % 2 = 0 THEN '100755' ELSE '100644' END AS mode FROM part),
d AS (SELECT *, row_number() OVER (PARTITION BY hash, mode ORDER BY path) AS nth FROM p WHERE path % 11 = 0 AND path % 7 <> 0),
a AS (SELECT *, row_number() OVER (PARTITION BY hash, mode ORDER BY path) AS nth FROM p WHERE path % 7 = 0 AND path % 11 <> 0)
SELECT d.path AS old, a.path AS new FROM d JOIN a ON d.hash = a.hash AND d.mode = a.mode AND d.nth = a.nth
""")
def status_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted and new paths of the index that are renames: equal content and equal mode, paired in the order of paths."""
    mode = F.when(F.col("p_size") % 2 == 0, "100755").otherwise("100644")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.concat_ws(":", F.md5("p_type"), mode).alias("same"))
    removed, added = p.filter("path % 11 = 0 AND path % 7 != 0"), p.filter("path % 7 = 0 AND path % 11 != 0")
    return pair_by_rank(removed, added, "same", "path").select("old", "new")


@query("""SELECT lang || '/' || CAST(doc_id AS VARCHAR) AS path, sha256(text) AS oid, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE doc_id % 4 = 1""")
def lfs_of_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large-file pointers among the files of a commit; most files are no pointers."""
    d = table(spark, sf_dir, "documents")
    pointer = T.lfs_pointer_text(F.sha2("text", 256), F.octet_length("text").cast("long"))
    files = d.select(F.concat_ws("/", F.col("lang"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 4 == 1, pointer).otherwise(F.col("text")).alias("blob"))
    return files.select("path", T.lfs_pointer(F.col("blob")).alias("p")).filter("p IS NOT NULL").select("path", "p.oid", "p.size")


@query("""
SELECT c_custkey AS commit, CASE WHEN c_custkey % 5 = 0 THEN 'unsigned' WHEN c_nationkey % 4 = 3 THEN 'unknown signer' WHEN c_custkey % 7 = 0 THEN 'other key' ELSE 'verified' END AS status FROM customer
""")
def branch_signers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits against the list of allowed signers: whose key signed, if any."""
    n = table(spark, sf_dir, "nation")
    lines = n.filter("n_nationkey % 4 != 3").select(F.format_string("n%d@example.org ssh-ed25519 KEY%d nation", "n_nationkey", "n_nationkey").alias("value"))
    signers = parse_signers(lines.unionByName(spark.createDataFrame([("# allowed",)], "value string")))
    k = F.col("c_custkey")
    key = F.when(k % 5 != 0, F.format_string("ssh-ed25519 KEY%d nation", F.col("c_nationkey") + F.when(k % 7 == 0, 1).otherwise(0)))
    commits = table(spark, sf_dir, "customer").select(k.alias("commit"), F.format_string("n%d@example.org", "c_nationkey").alias("email"), key.alias("used"))
    status = F.when(F.col("used").isNull(), "unsigned").when(F.col("key").isNull(), "unknown signer").when(F.col("used") != F.col("key"), "other key").otherwise("verified")
    return commits.join(signers, "email", "left").select("commit", status.alias("status"))


@query("""SELECT md5(text) AS other, sha256('blob ' || CAST(strlen(text) AS VARCHAR) || chr(0) || text) AS own, count(*) AS files FROM documents GROUP BY 1, 2""")
def foreign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of another system mapped to our own, each pair once, with the files that have it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("other"), T.object_hash(F.lit("blob"), F.col("text")).alias("own"))
    known = d.select("other", "own").distinct()
    return d.select("doc_id", "other").join(known, "other").groupBy("other", "own").agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT DISTINCT sha256(p_type) AS hash FROM part""")
def unique_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes asked for, without blanks, in one case, each once; what is no hash is left out."""
    h = F.sha2("p_type", 256)
    k = F.col("p_partkey") % 3
    asked = table(spark, sf_dir, "part").select(F.explode(F.array(F.when(k == 0, F.concat(F.lit(" "), h, F.lit("\n"))).otherwise(h), F.lit(""), F.left(h, F.lit(9)))).alias("raw"))
    return asked.select(T.stripped(F.lower("raw")).alias("hash")).filter(T.is_hash(F.col("hash"))).distinct()


@query("""
WITH b AS (SELECT DISTINCT p_brand AS path FROM part WHERE p_size < 20), o AS (SELECT DISTINCT p_brand || '/' || p_type AS path FROM part WHERE p_size > 30), t AS (SELECT DISTINCT p_brand AS path FROM part)
SELECT path FROM b UNION SELECT path FROM o UNION SELECT path FROM t
""")
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path that any of three trees has."""
    p = table(spark, sf_dir, "part")
    sides = (p.filter("p_size < 20").select(F.col("p_brand").alias("path")), p.filter("p_size > 30").select(F.concat_ws("/", "p_brand", "p_type").alias("path")), p.select(F.col("p_brand").alias("path")))
    return sides[0].union(sides[1]).union(sides[2]).distinct()
