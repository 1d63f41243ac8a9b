"""Code intelligence queries over source files that the order lines make."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.extract import extracted
from strata.functions.lines import with_edit_script
from strata.operators import code as C
from strata.operators import entity_merge as M
from strata.operators.tables import settled
from strata.plans.registry import query, table
from strata.plans.structural import FUNCTION_SQL, LINES_SQL, OURS_BODY, OURS_FIRST, THEIRS_BODY, V, source_files

PATH = "'o' || CAST(k AS VARCHAR) || '.go'"
NAMED_SQL = f"""
WITH {LINES_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS i, 'pkg' || CAST(k % 7 AS VARCHAR) AS pkg, 'pkg' || CAST((k + 1) % 7 AS VARCHAR) AS other FROM l)
"""


def caller_files(spark: SparkSession, sf_dir: str, only: Sequence[str] = (), kinds: Sequence[str] = ()) -> DataFrame:
    """The entities of one file for each order, in one of seven packages; each line is a function that calls one of the next package."""
    once = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    k = F.col("l_orderkey")
    other = (k + 1) % 7
    body = F.format_string("func F%d() {\n\tpkg%d.F%d()\n}", "l_linenumber", other, F.col("p") % 9)
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", body.alias("b"))))["b"]
    files = once.groupBy("l_orderkey").agg(listed.alias("b"))
    text = F.concat(F.format_string('package pkg%d\n\nimport "example.org/m/pkg%d"\n\n', k % 7, other), F.array_join("b", "\n\n"), F.lit("\n"))
    path = F.format_string("pkg%d/f%d.go", k % 7, k)
    return extracted(files.select(path.alias("path"), F.lit("go").alias("lang"), text.alias("text")), ["path"], only=only, kinds=kinds)


@query(NAMED_SQL + "SELECT pkg AS package, 'func:F' || CAST(n AS VARCHAR) AS key, 'F' || CAST(n AS VARCHAR) AS name, max(pkg || '/f' || CAST(k AS VARCHAR) || '.go') AS file FROM o GROUP BY pkg, n")
def export_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each package exports, and from which file."""
    return C.exports(caller_files(spark, sf_dir, C.EXPORT_COLUMNS, ("declaration",)))


@query(NAMED_SQL + """
SELECT 'example.org/m/' || other || '.F' || CAST(p % 9 AS VARCHAR) AS name, pkg || '/f' || CAST(k AS VARCHAR) || '.go' AS file, 'F' || CAST(n AS VARCHAR) AS entity,
  CAST(4 * i + 2 AS INTEGER) AS line FROM o
""")
def xref_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of an imported name: who calls it, where."""
    return C.references(caller_files(spark, sf_dir, C.REFERENCE_COLUMNS, C.REFERENCE_KINDS))


@query(NAMED_SQL + """
, x AS (SELECT DISTINCT pkg, n FROM o WHERE n IN (2, 3)),
s AS (SELECT 'F' || CAST(p % 9 AS VARCHAR) AS name, other, pkg || '/f' || CAST(k AS VARCHAR) || '.go:F' || CAST(n AS VARCHAR) || ':' || CAST(4 * i + 2 AS VARCHAR) AS caller FROM o)
SELECT 'func:F' || CAST(x.n AS VARCHAR) AS key, s.caller FROM x JOIN s ON s.other = x.pkg AND s.name = 'F' || CAST(x.n AS VARCHAR)
""")
def impact_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites that a change of two functions reaches, through the export index and the references."""
    # cut once: exports and references read the table
    entities = settled(caller_files(spark, sf_dir, {*C.EXPORT_COLUMNS, *C.REFERENCE_COLUMNS}, C.REFERENCE_KINDS))
    changes = spark.createDataFrame([("func:F2", "F2"), ("func:F3", "F3")], "key string, name string")
    return C.impact(changes, C.exports(entities), C.references(entities), F.lit("example.org/m"))


@query(NAMED_SQL + "SELECT 'func:F' || CAST(n AS VARCHAR) AS key, max(pkg || '/f' || CAST(k AS VARCHAR) || '.go') AS file FROM o WHERE n <> 4 GROUP BY pkg, n")
def entity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files in which entities of given keys are found."""
    keys = spark.range(1, 8).filter("id != 4").select(F.format_string("func:F%d", "id").alias("key"))
    return C.exports(caller_files(spark, sf_dir, C.EXPORT_COLUMNS, ("declaration",))).join(keys, "key").select("key", "file")


@query(f"""
WITH {LINES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS i FROM l)
SELECT {PATH} AS path, 'decl:function_declaration::F' || CAST(n AS VARCHAR) || ':func F' || CAST(n AS VARCHAR) || '(x int) int:0' AS key, CAST(6 * i - 3 AS INTEGER) AS start_line, CAST(6 * i + 1 AS INTEGER) AS end_line FROM o
UNION ALL SELECT DISTINCT {PATH}, 'decl:gone', NULL, NULL FROM o
""")
def comment_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments on entities of the base, found again in ours by identity; those of vanished ones have no lines."""
    files = source_files(spark, sf_dir)
    comments = extracted(files, ["path"], "base").filter("kind = 'declaration'").select("path", "key")
    comments = comments.unionByName(files.select("path", F.lit("decl:gone").alias("key")))
    return C.comment_lines(comments, extracted(files, ["path"], "ours"))


CHANGED_SQL = f"""
WITH {LINES_SQL},
c AS (SELECT k, n, p FROM l WHERE p % 11 = 0 OR p % 7 = 0)
"""


@query(CHANGED_SQL + f"""
, r AS (SELECT k, n, '  ~ func F' || CAST(n AS VARCHAR) || '     (modified)' || chr(10) AS line FROM c UNION ALL SELECT DISTINCT k, 99, '  + func Ours     (added)' || chr(10) FROM l WHERE k % 2 = 0)
SELECT {PATH} AS path, {PATH} || ':' || chr(10) || string_agg(line, '' ORDER BY n) AS text FROM r GROUP BY k
""")
def entity_diff_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in each file, entity by entity."""
    return C.entity_diff_text(_changes(spark, sf_dir))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.file_changes(source_files(spark, sf_dir), "base", "ours")


@query(CHANGED_SQL + f"""
SELECT {PATH} AS path, '--- a/' || {PATH} || '::func F' || CAST(n AS VARCHAR) || chr(10) || '+++ b/' || {PATH} || '::func F' || CAST(n AS VARCHAR) || chr(10) ||
  ' func F' || CAST(n AS VARCHAR) || '(x int) int {{' || chr(10) || '-' || chr(9) || 'a := ' || {V} || chr(10) || '+' || chr(9) || 'a := ' || {OURS_FIRST} || chr(10) ||
  ' ' || chr(9) || 'keep(' || CAST(n AS VARCHAR) || ')' || chr(10) || ' ' || chr(9) || 'return x' || chr(10) || ' }}' || chr(10) AS text FROM c
UNION ALL SELECT DISTINCT {PATH}, '+++ b/' || {PATH} || '::func Ours' || chr(10) || '+func Ours() {{}}' || chr(10) FROM l WHERE k % 2 = 0
""".replace("{{", "{").replace("}}", "}"))
def line_diff_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed entities of each file line by line."""
    return C.line_diff_text(_changes(spark, sf_dir)).select("path", "text")


@query(f"""
WITH {LINES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS no FROM l WHERE p % 11 = 0)
SELECT {PATH} AS path, CAST(no AS INTEGER) AS no, 'func F' || CAST(n AS VARCHAR) AS name, {OURS_BODY} AS ours, {THEIRS_BODY} AS theirs FROM c
""")
def conflict_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conflicts that a merge has marked, with both sides."""
    return C.conflicts(_merged(spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_files(source_files(spark, sf_dir)).select("path", F.col("merged").alias("text"))


@query(f"""
WITH {LINES_SQL}
SELECT {PATH} AS path, CAST(count(*) FILTER (p % 11 = 0) AS INTEGER) AS taken, CAST(0 AS INTEGER) AS left FROM l GROUP BY k
""")
def conflicts_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conflict resolved with our side: how often our edit stands in the text then, and which markers are left."""
    text = C.resolved_text(F.col("text"), "ours")
    rows = _merged(spark, sf_dir).select("path", text.alias("text"), F.regexp_count("text", F.lit("(?m)^<<<<<<< ours")).alias("taken"))
    return rows.select("path", "taken", F.regexp_count("text", F.lit("(?m)^(<<<<<<<|=======|>>>>>>>)")).alias("left"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, 'Licen[cs]e')) AS n, sha256(regexp_replace(text, 'Licen[cs]e', 'Permit', 'g')) AS hash FROM documents""")
def grep_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match replaced, with the number of matches."""
    text, n = C.replaced(F.col("text"), "Licen[cs]e", "Permit")
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n"), F.sha2(text, 256).alias("hash"))


@query(f"""
WITH {LINES_SQL}
SELECT {PATH} AS path, 'package o' || CAST(k AS VARCHAR) || chr(10) || chr(10) || string_agg(CASE WHEN n = 2 THEN 'func F2() {{}}' ELSE {FUNCTION_SQL.format(first=V, last="'x'")} END, chr(10) || chr(10) ORDER BY n) || chr(10) AS text
FROM l GROUP BY k
""".replace("F2() {{}}", "F2() {}"))
def entity_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity of each file given a new body; all else stays byte for byte."""
    e = extracted(source_files(spark, sf_dir), ["path"], "base")
    edits = e.filter("name = 'F2'").select("path", "key", F.lit("func F2() {}").alias("body"))
    return C.applied_edits(e, edits)


@query()
def hunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of each document against itself with every twentieth line rewritten: where they begin and how long they are."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edited = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 20 == 10, F.lit("rewritten")).otherwise(x)), "\n")
    return C.hunk_ranges(with_edit_script(d.select("doc_id", "text", edited.alias("edited")), "text", "edited"), "doc_id")
