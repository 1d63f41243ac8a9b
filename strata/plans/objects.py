"""Object queries: the documents as blobs of trees, the trees as commits of a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import object_hash
from strata.operators import graph as G
from strata.sources import objects as O
from strata.sources.records import commit_text
from strata.plans.registry import query, table


def _objects(kind: str, df: DataFrame, text: str, *keep: str) -> DataFrame:
    return df.select(*keep, object_hash(F.lit(kind), F.col(text)).alias("hash"), F.lit(kind).alias("type"), F.octet_length(text).cast("long").alias("size"), F.col(text).cast("binary").alias("data"))


def object_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All objects, and (language, commit hash): a tree of each language's documents, a commit and a tag of each tree."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    blobs = _objects("blob", d, "text", "doc_id", "lang")
    entries = blobs.select("lang", F.format_string("f%d.txt", "doc_id").alias("name"), F.lit("100644").alias("mode"), F.col("hash").alias("blob"), F.lit(None).cast("string").alias("entities"), F.lit(None).cast("string").alias("subtree"))
    trees = _objects("tree", O.tree_texts(entries, "lang"), "text", "lang")
    none = F.array().cast("array<string>")
    texts = trees.select("lang", commit_text(F.col("hash"), none, F.lit("a"), F.lit(7).cast("long"), F.concat(F.lit("all of "), "lang")).alias("text"))
    commits = _objects("commit", texts, "text", "lang")
    tags = _objects("tag", commits.select("lang", O.tag_text(F.col("hash"), F.lit("release\n")).alias("text")), "text")
    parts = [blobs.drop("doc_id", "lang"), trees.drop("lang"), commits.drop("lang"), tags]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.dropDuplicates(["hash"]), commits.select("lang", "hash")


TREES_SQL = """
WITH b AS (SELECT lang, 'f' || CAST(doc_id AS VARCHAR) || '.txt' AS name, sha256('blob ' || CAST(strlen(text) AS VARCHAR) || chr(0) || text) AS blob FROM documents),
t AS (SELECT lang, 'version 1' || chr(10) || string_agg(name || chr(9) || '100644 ' || blob || ' - -' || chr(10), '' ORDER BY name) AS text FROM b GROUP BY lang),
th AS (SELECT lang, sha256('tree ' || CAST(strlen(text) AS VARCHAR) || chr(0) || text) AS hash FROM t)
"""


@query(TREES_SQL + "SELECT th.hash, b.name, '100644' AS mode, FALSE AS is_dir, b.blob FROM th JOIN b USING (lang)")
def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees written from documents and read back: their entries under the hash of the tree."""
    objects, _ = object_table(spark, sf_dir)
    return O.parse_trees(objects).select("hash", "name", "mode", "is_dir", "blob")


COMMIT_SQL = """
, ct AS (SELECT lang, 'tree ' || hash || chr(10) || 'author a' || chr(10) || 'timestamp 7' || chr(10) || chr(10) || 'all of ' || lang AS text FROM th),
ch AS (SELECT lang, sha256('commit ' || CAST(strlen(text) AS VARCHAR) || chr(0) || text) AS hash FROM ct)
"""


@query(TREES_SQL + COMMIT_SQL + """
, gt AS (SELECT 'version 1' || chr(10) || 'target ' || hash || chr(10) || chr(10) || 'release' || chr(10) AS text, hash FROM ch)
SELECT sha256('tag ' || CAST(strlen(text) AS VARCHAR) || chr(0) || text) AS hash, hash AS target FROM gt
""")
def tag_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag objects and the commits that they name."""
    objects, _ = object_table(spark, sf_dir)
    return O.parse_tags(objects).select("hash", "target")


@query(TREES_SQL + COMMIT_SQL + """
SELECT type, count(*) AS n FROM (
  SELECT 'commit' AS type, hash FROM ch WHERE lang < 'f' UNION SELECT 'tree', th.hash FROM th WHERE lang < 'f' UNION SELECT 'blob', blob FROM b WHERE lang < 'f') GROUP BY type
""")
def object_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects that the commits of some languages reach, of any type, by type."""
    objects, commits = object_table(spark, sf_dir)
    reached = G.closure(O.references(objects), commits.filter("lang < 'f'").select(F.col("hash").alias("node")))
    return reached.join(objects.select(F.col("hash").alias("node"), "type"), "node").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(TREES_SQL + COMMIT_SQL + """
SELECT type, count(*) AS n FROM (
  SELECT 'commit' AS type, hash FROM ch WHERE lang >= 'f' UNION SELECT 'tree', th.hash FROM th WHERE lang >= 'f'
  UNION (SELECT 'blob', blob FROM b WHERE lang >= 'f' EXCEPT SELECT 'blob', blob FROM b WHERE lang < 'f')
  UNION SELECT 'tag', hash FROM ch) GROUP BY type
""")
def collectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What garbage collection can drop: objects that no kept root reaches, by type."""
    objects, commits = object_table(spark, sf_dir)
    reached = G.closure(O.references(objects), commits.filter("lang < 'f'").select(F.col("hash").alias("node")))
    return objects.join(reached.select(F.col("node").alias("hash")), "hash", "left_anti").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(TREES_SQL + "SELECT count(*) AS gaps FROM (SELECT DISTINCT blob FROM b WHERE lang = 'en' AND blob[1:1] = 'a')")
def closure_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that are named but not there, once some blobs are lost."""
    objects, _ = object_table(spark, sf_dir)
    english = table(spark, sf_dir, "documents").filter("lang = 'en'").select(object_hash(F.lit("blob"), F.col("text")).alias("hash")).filter("startswith(hash, 'a')")
    held = objects.join(english, "hash", "left_anti")
    named = O.references(held).select(F.col("parent").alias("hash")).distinct()
    return named.join(held.select("hash"), "hash", "left_anti").agg(F.count(F.lit(1)).alias("gaps"))


@query("""SELECT doc_id, 'interstitial' AS kind, 'n' || CAST(doc_id AS VARCHAR) AS name, sha256(text) AS body_hash, text AS body FROM documents""")
def entity_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity objects written and read back."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("n"), F.col("doc_id").cast("string"))
    texts = d.select("doc_id", O.entity_text(F.lit("interstitial"), name, F.lit(""), F.lit(""), F.col("text")).alias("text"))
    e = O.parse_entities(_objects("entity", texts, "text"))
    return e.select(F.substring("name", 2, 20).cast("long").alias("doc_id"), "kind", "name", "body_hash", "body")


@query("""
WITH e AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, sha256(CAST(o_orderkey AS VARCHAR)) AS entity FROM orders)
SELECT 'p' || CAST(c AS VARCHAR) AS path, 'go' AS language, CAST(pos AS INTEGER) AS pos, entity FROM e
""")
def entity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity lists written and read back: an entity of each order, a list of each customer."""
    o = table(spark, sf_dir, "orders")
    refs = F.array_sort(F.collect_list(F.struct("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"))))["h"]
    lists = o.groupBy("o_custkey").agg(refs.alias("refs"))
    texts = lists.select(O.entity_list_text(F.lit("go"), F.format_string("p%d", "o_custkey"), F.col("refs")).alias("text"))
    return O.parse_entity_lists(_objects("entitylist", texts, "text")).select("path", "language", "pos", "entity")
