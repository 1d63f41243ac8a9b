"""What follows a merge or a change: diagnostics of rules, and impact over references to a fixpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import entity_merge as M
from strata.operators.merge_rules import diagnostics
from strata.operators.module_impact import module_impact as impact_of
from strata.operators.module_impact import modules_hit
from strata.plans.registry import query, table


@query("""
WITH r AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.go' AS path, p_size % 2 = 0 AS o_more, p_size % 3 = 0 AS t_more, p_retailprice > 1000 AS o_const, p_size > 20 AS t_const, p_size % 4 = 0 AS o_init, p_size % 6 = 0 AS t_init FROM part)
SELECT path, 'warning' AS severity, 'go-interface-impl' AS rule, 'Store: ' || CASE WHEN o_more THEN 'ours added 1' ELSE 'theirs added 2' END || ' method(s) to interface — implementors may need updating' AS message FROM r WHERE o_more <> t_more
UNION ALL SELECT path, 'info', 'go-const-var-block', 'A: both sides modified const/var block — consider set-union merge' FROM r WHERE o_const AND t_const
UNION ALL SELECT path, 'warning', 'go-init-func', 'init() modified on both sides — review carefully, execution order may matter' FROM r WHERE o_init AND t_init
""")
def merge_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules for Go say to merges of files with an interface, a group of constants and an init function."""
    def when(condition: Column | bool, text: str, other: str = "") -> Column:
        return F.when(condition if isinstance(condition, Column) else F.lit(condition), text).otherwise(other)

    def text(methods: Column, value: Column, started: Column) -> Column:
        return F.concat(F.lit("package p\n\ntype Store interface {\n\t// reads\n\tGet() int\n"), methods, F.lit("}\n\nconst (\n\tA = "), value, F.lit("\n)\n\nfunc init() {\n\trun("), started, F.lit(")\n}\n"))

    size = F.col("p_size")
    files = table(spark, sf_dir, "part").select(
        F.format_string("p%d.go", "p_partkey").alias("path"), F.lit("go").alias("lang"), text(F.lit(""), F.lit("0"), F.lit("0")).alias("base"),
        text(when(size % 2 == 0, "\tPut(v int)\n"), when(F.col("p_retailprice") > 1000, "1", "0"), when(size % 4 == 0, "1", "0")).alias("ours"),
        text(when(size % 3 == 0, "\tDrop()\n\n\tClose() error\n"), when(size > 20, "2", "0"), when(size % 6 == 0, "2", "0")).alias("theirs"),
    )
    return diagnostics(M.matched(M.versions(files))).select("path", "severity", "rule", "message")


# part k is an entity of module k div 20; lines of greatest quantity are references from their part to one of their supplier's
IMPACT = """
RECURSIVE u AS (SELECT DISTINCT l_partkey AS a, l_suppkey * 20 + l_linenumber AS b FROM lineitem WHERE l_quantity >= 49),
r AS (SELECT p_partkey AS node, 0 AS d FROM part WHERE p_size = 50 UNION SELECT a, d + 1 FROM r JOIN u ON b = node WHERE d < 60),
m AS (SELECT node, min(d) AS d FROM r GROUP BY node),
v AS (SELECT m.node, m.d, min(n.node) AS via FROM m LEFT JOIN u ON u.a = m.node LEFT JOIN m n ON n.node = u.b AND n.d = m.d - 1 GROUP BY m.node, m.d),
t AS (SELECT node, d, node AS source, CAST(node AS VARCHAR) AS path FROM v WHERE d = 0 UNION ALL SELECT v.node, v.d, t.source, t.path || '>' || CAST(v.node AS VARCHAR) FROM t JOIN v ON v.via = t.node AND v.d = t.d + 1)
"""


def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, used = F.col("l_partkey").cast("long"), (F.col("l_suppkey") * 20 + F.col("l_linenumber")).cast("long")
    module = lambda node: F.floor(node / 20)
    references = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(module(part).alias("module"), part.alias("entity"), module(used).alias("uses_module"), used.alias("uses_entity"))
    key = F.col("p_partkey").cast("long")
    changes = table(spark, sf_dir, "part").filter("p_size = 50").select(module(key).alias("module"), key.alias("entity"))
    return impact_of(references, references.select("module", F.col("uses_module").alias("needs")), changes)


@query(f"WITH {IMPACT} SELECT node // 20 AS module, node AS entity, d AS distance, source AS source_entity, path FROM t WHERE d > 0")
def module_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity that changes reach over references, with the shortest way there; references run in cycles."""
    path = F.array_join(F.transform("path", lambda s: s["entity"].cast("string")), ">")
    return _impact(spark, sf_dir).select("module", "entity", "distance", "source_entity", path.alias("path"))


@query(f"WITH {IMPACT} SELECT source // 20 AS source_module, node // 20 AS module, count(*) AS entities, min(d) AS nearest FROM t WHERE d > 0 AND source // 20 <> node // 20 GROUP BY ALL")
def module_impact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities of each module the changes of another reach."""
    return modules_hit(_impact(spark, sf_dir))
