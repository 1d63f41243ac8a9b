"""Search, pattern and policy queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import glob_regex
from strata.operators import rules
from strata.plans.registry import query, table

PATH_SQL = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.withColumn("path", F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


LINES_SQL = f"""
WITH f AS (SELECT {PATH_SQL} AS path, string_split(text, E'\\n') AS l FROM documents),
lines AS (SELECT path, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM f)
"""


@query(LINES_SQL + "SELECT path, line_no, line FROM lines WHERE regexp_matches(line, 'Licen[cs]e') AND regexp_matches(path, '^src1[0-9]*/')")
def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match a regular expression, in paths that match a glob (sorted on request by the caller)."""
    files = _files(spark, sf_dir).filter(F.col("path").rlike("^src1[0-9]*/"))
    return _lines(files).filter(F.col("line").rlike("Licen[cs]e"))


@query(LINES_SQL + "SELECT path, line_no, line FROM lines WHERE contains(lower(line), 'apache license')")
def grep_fixed_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(_files(spark, sf_dir)).filter(F.lower("line").contains("apache license"))


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$') AND p_type LIKE 'S%' AND regexp_matches(p_brand, '^Brand#1[^/]*$')""")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by a pattern of the name, the kind, and a glob of the path."""
    p = table(spark, sf_dir, "part")
    return p.filter(F.col("p_name").rlike("^(red|blue) .*t$") & F.col("p_type").like("S%") & F.col("p_brand").rlike(glob_regex("Brand#1*"))).select("p_partkey", "p_name", "p_type")


@query("""
WITH e AS (SELECT conv_id AS file, turn AS entity, turn * 100 AS s, turn * 100 + 40 + length(text) AS e FROM conversations),
m AS (SELECT conv_id AS file, turn AS hit, turn * 100 + 20 AS at FROM conversations)
SELECT m.file, m.hit, arg_min(e.entity, (e.e - e.s) * 1000 + e.entity) AS entity FROM m JOIN e ON m.file = e.file AND e.s <= m.at AND m.at <= e.e GROUP BY m.file, m.hit
""")
def enclosing_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest entity range around each match; the range test runs within the file's equi-join."""
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 100
    e = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("entity"), start.alias("s"), (start + 40 + F.length("text")).alias("e"))
    m = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("hit"), (start + 20).alias("at"))
    around = m.join(e, "file").filter("s <= at AND at <= e")
    return around.groupBy("file", "hit").agg(F.min_by("entity", F.struct(F.col("e") - F.col("s"), F.col("entity"))).alias("entity"))


IGNORE = ("# sources", "src1/", "!src1/en/**", "*7", "", "/src2/de", "!src12/", "fr/", "/es/", "src3/**/1?")
IGNORE_RULES_SQL = """(VALUES (1, '(^|/)[.]git$', FALSE), (2, '(^|/)src1(/|$)', FALSE), (3, '^src1/en/.*$', TRUE), (4, '(^|/)[^/]*7$', FALSE),
  (5, '^src2/de$', FALSE), (6, '(^|/)src12(/|$)', TRUE), (7, '(^|/)fr(/|$)', FALSE), (8, '^es(/|$)', FALSE), (9, '^src3/(.*/)?1[^/]$', FALSE)) AS r(no, pattern, negated)"""


@query(f"""
WITH f AS (SELECT {PATH_SQL} AS path FROM documents)
SELECT f.path, coalesce(NOT arg_max(r.negated, r.no), FALSE) AS ignored, max(r.no) AS rule
FROM f LEFT JOIN {IGNORE_RULES_SQL} ON regexp_matches(f.path, r.pattern) GROUP BY f.path
""")
def ignore_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = rules.ignore_rules(IGNORE)
    path = F.col("path")
    return _files(spark, sf_dir).select("path", rules.ignored(path, held).alias("ignored"), rules.last_match(path, held).alias("rule"))


@query(f"""
WITH f AS (SELECT {PATH_SQL} AS path FROM documents)
SELECT f.path, string_agg(CAST(r.no AS VARCHAR), ',' ORDER BY r.no) AS rules FROM f JOIN {IGNORE_RULES_SQL} ON regexp_matches(f.path, r.pattern) GROUP BY f.path
""")
def ignore_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ignore rule that matches a path, not the last alone."""
    found = F.array_join(rules.all_matches(F.col("path"), rules.ignore_rules(IGNORE)).cast("array<string>"), ",")
    return _files(spark, sf_dir).select("path", found.alias("rules")).filter("rules != ''")


ATTRIBUTES = (("src*", {"diff": "true", "merge": "text"}), ("/src1/en", {"merge": "union"}), ("*3", {"diff": "false"}))


@query(f"""
SELECT path, CASE WHEN regexp_matches(path, '(^|/)[^/]*3(/|$)') THEN 'false' WHEN regexp_matches(path, '(^|/)src[^/]*(/|$)') THEN 'true' END AS diff,
  CASE WHEN regexp_matches(path, '^src1/en(/|$)') THEN 'union' WHEN regexp_matches(path, '(^|/)src[^/]*(/|$)') THEN 'text' END AS merge
FROM (SELECT {PATH_SQL} AS path FROM documents)
""")
def attributes_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _files(spark, sf_dir).select("path", *(rules.attribute(path, ATTRIBUTES, k).alias(k) for k in ("diff", "merge")))


OWNERS = (("src*", ("core",)), ("/src1", ("ann", "core")), ("*5", ("bob", "ann")))


@query(f"""
WITH f AS (SELECT {PATH_SQL} AS path FROM documents),
r AS (SELECT * FROM (VALUES ('(^|/)src[^/]*(/|$)', 'core', 1), ('^src1(/|$)', 'ann', 2), ('^src1(/|$)', 'core', 3), ('(^|/)[^/]*5(/|$)', 'bob', 4), ('(^|/)[^/]*5(/|$)', 'ann', 5)) AS v(p, owner, no)),
m AS (SELECT path, owner, min(no) AS no FROM f JOIN r ON regexp_matches(f.path, r.p) GROUP BY path, owner)
SELECT f.path, coalesce(string_agg(m.owner, ',' ORDER BY m.no), '') AS owners FROM f LEFT JOIN m USING (path) GROUP BY f.path
""")
def owners_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", F.array_join(rules.owners(F.col("path"), OWNERS), ",").alias("owners"))


@query(f"""
SELECT path, CASE WHEN regexp_matches(path, '^src1/en(/|$)') THEN FALSE ELSE regexp_matches(path, '^src1(/|$)') OR regexp_matches(path, '(^|/)de(/|$)') END AS in_cone
FROM (SELECT {PATH_SQL} AS path FROM documents)
""")
def sparse_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path", rules.in_cone(F.col("path"), ("/src1", "de", "!/src1/en")).alias("in_cone"))


@query("""SELECT p_partkey FROM part WHERE regexp_matches(p_type || ':' || p_name, '^[^:]*:.*1.$') OR regexp_matches(p_type || ':' || p_name, '^PROMO[^:]*:')""")
def protected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that any protection pattern names; patterns are kind and name globs."""
    key = F.concat_ws(":", "p_type", "p_name")
    patterns = ("^[^:]*:.*1.$", "^PROMO[^:]*:")
    held = F.lit(False)
    for p in patterns:
        held = held | key.rlike(p)
    return table(spark, sf_dir, "part").filter(held).select("p_partkey")


CLAIM_RULES = (
    rules.PolicyRule("deny-foreign", 10, "owner IS NOT NULL AND owner <> agent AND NOT stale", "deny"),
    rules.PolicyRule("allow-own", 20, "owner = agent", "allow"),
    rules.PolicyRule("take-stale", 20, "owner IS NOT NULL AND stale", "transfer"),
    rules.PolicyRule("warn-large", 30, "size > 300000", "warn"),
)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    owner: Column = F.when(k % 4 != 0, F.col("o_custkey") % 7)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (k % 5).alias("agent"), owner.alias("owner"), (k % 3 == 0).alias("stale"), F.col("o_totalprice").alias("size")
    )


CLAIM_SQL = """
WITH c AS (SELECT o_orderkey, o_orderkey % 5 AS agent, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey % 7 END AS owner, o_orderkey % 3 = 0 AS stale, o_totalprice AS size FROM orders),
h AS (SELECT o_orderkey, coalesce(owner <> agent AND NOT stale, FALSE) AS a, coalesce(owner = agent, FALSE) AS b, owner IS NOT NULL AND stale AS t, size > 300000 AS w FROM c)
"""


@query(CLAIM_SQL + """
SELECT o_orderkey, CASE WHEN a THEN 'deny' WHEN b THEN 'allow' WHEN t THEN 'transfer' WHEN w THEN 'warn' ELSE 'allow-default' END AS action,
  CASE WHEN a THEN 'deny-foreign' WHEN b THEN 'allow-own' WHEN t THEN 'take-stale' WHEN w THEN 'warn-large' END AS rule,
  concat_ws(',', CASE WHEN a THEN 'deny-foreign' END, CASE WHEN b THEN 'allow-own' END, CASE WHEN t THEN 'take-stale' END, CASE WHEN w THEN 'warn-large' END) AS trace
FROM h
""")
def claim_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(_claims(spark, sf_dir), CLAIM_RULES, "allow-default").select("o_orderkey", "action", "rule", "trace")


@query(CLAIM_SQL + """
SELECT o_orderkey, 'deny-foreign' AS rule, 'deny' AS effect FROM h WHERE a UNION ALL SELECT o_orderkey, 'allow-own', 'allow' FROM h WHERE b
UNION ALL SELECT o_orderkey, 'take-stale', 'transfer' FROM h WHERE t UNION ALL SELECT o_orderkey, 'warn-large', 'warn' FROM h WHERE w
""")
def effects_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.all_effects(_claims(spark, sf_dir), CLAIM_RULES).select("o_orderkey", "rule", "effect")


ACTION_RULES = (
    rules.PolicyRule("destructive", 1, "destructive AND NOT forced", "block"),
    rules.PolicyRule("network", 5, "network", "ask"),
    rules.PolicyRule("writes", 9, "writes", "allow"),
)


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_quantity < 40 THEN 'block' WHEN l_linestatus = 'F' THEN 'ask' WHEN l_tax > 0.04 THEN 'allow' ELSE 'ask' END AS action FROM lineitem
""")
def action_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("destructive"), (F.col("l_quantity") >= 40).alias("forced"),
        (F.col("l_linestatus") == "F").alias("network"), (F.col("l_tax") > 0.04).alias("writes"),
    )
    return rules.evaluate(li, ACTION_RULES, "ask").select("l_orderkey", "l_linenumber", "action")


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]{4,}')) AS name FROM benchmark WHERE item_id < 20),
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{4,}')) AS name FROM documents)
SELECT name, count(*) AS n FROM t JOIN w USING (name) GROUP BY name
""")
def impact_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that bodies mention: bodies are cut into words, so containment is an equi-join."""
    return _mentions(spark, sf_dir, table(spark, sf_dir, "benchmark").filter("item_id < 20"))


@query()
def impact_refs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``impact_refs`` with the names of the whole benchmark."""
    return _mentions(spark, sf_dir, table(spark, sf_dir, "benchmark"))


def _mentions(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    def words(text: Column) -> Column:
        return F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{4,}"), F.lit(0))))

    names = items.select(words(F.col("text")).alias("name")).distinct()
    bodies = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("name"))
    return bodies.join(names, "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
