"""Text kernel queries: edit scripts, three-way merges, renames by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import lines as L
from strata.operators import renames
from strata.plans.registry import query, table

PLAIN_SQL = """
WITH s AS (SELECT doc_id, text, string_split(text, E'\\n') AS l FROM documents),
d AS (SELECT * FROM s WHERE len(l) >= 5 AND len(list_distinct(l)) = len(l) AND l[-1] <> '')
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their lines: short ones, repeated lines and empty texts too; null reads as empty."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.withColumn("l", F.split("text", "\n", -1))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of five lines or more, none of which repeats."""
    lines = F.split("text", "\n", -1)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", lines.alias("l"))
    return d.filter((F.size("l") >= 5) & (F.size(F.array_distinct("l")) == F.size("l")) & (F.element_at("l", -1) != ""))


def _replaced(at: Column, line: str) -> Column:
    return F.array_join(F.transform("l", lambda x, i: F.when(i == at, F.lit(line)).otherwise(x)), "\n")


@query(PLAIN_SQL + "SELECT doc_id, CAST(len(l) - 1 AS BIGINT) AS kept, CAST(1 AS BIGINT) AS removed, CAST(1 AS BIGINT) AS added FROM d")
def myers_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit scripts of documents against themselves with the third line rewritten."""
    return _script_counts(_plain(spark, sf_dir), F.lit(2))


@query()
def myers_ops_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``myers_ops`` over every document; the last line is rewritten where there is no third."""
    return _script_counts(_documents(spark, sf_dir), _third())


def _third() -> Column:
    return F.least(F.lit(2), F.size("l") - 1)


def _script_counts(d: DataFrame, at: Column) -> DataFrame:
    d = L.with_edit_script(d.select("doc_id", "text", _replaced(at, "rewritten").alias("edited")), "text", "edited")

    def count(op: str) -> Column:
        return F.size(F.filter("ops", lambda o: o["op"] == op)).cast("long")

    return d.select("doc_id", count("=").alias("kept"), count("-").alias("removed"), count("+").alias("added"))


@query(PLAIN_SQL + "SELECT doc_id, array_to_string(list_concat(['OURS'], l[2:len(l)-1], ['THEIRS']), E'\\n') AS merged, CAST(0 AS INTEGER) AS conflicts FROM d")
def diff3_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ours rewrites the first line, theirs the last: both stand in the merge."""
    return _both_ends(_plain(spark, sf_dir))


@query()
def diff3_merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``diff3_merge`` over every document; in texts of one or two lines the sides meet in a conflict."""
    return _both_ends(_documents(spark, sf_dir))


def _both_ends(d: DataFrame) -> DataFrame:
    ours, theirs = _replaced(F.lit(0), "OURS"), _replaced(F.size("l") - 1, "THEIRS")
    d = d.select("doc_id", "text", ours.alias("ours"), theirs.alias("theirs"))
    return L.merge_texts(d, "text", "ours", "theirs").select("doc_id", "merged", "conflicts")


@query(PLAIN_SQL + """
SELECT doc_id % 4 AS side, count(*) AS files, CAST(sum(CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS conflicts,
  CAST(sum(CASE doc_id % 4 WHEN 0 THEN len(l) ELSE CASE WHEN doc_id % 4 = 3 THEN len(l) + 4 ELSE len(l) END END) AS BIGINT) AS lines FROM d GROUP BY 1
""")
def merge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: files merged three ways, reported by which side changed (0 none, 1 ours, 2 theirs, 3 both differently)."""
    return _merge_report(_plain(spark, sf_dir), F.lit(2))


@query()
def merge_preview_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``merge_preview`` over every document; the last line is changed where there is no third."""
    return _merge_report(_documents(spark, sf_dir), _third())


def _merge_report(d: DataFrame, at: Column) -> DataFrame:
    side = F.col("doc_id") % 4
    ours = F.when(side.isin(1, 3), _replaced(at, "ours")).otherwise(F.col("text"))
    theirs = F.when(side.isin(2, 3), _replaced(at, "theirs")).otherwise(F.col("text"))
    d = d.select(side.alias("side"), "text", ours.alias("ours"), theirs.alias("theirs"))
    return L.merge_texts(d, "text", "ours", "theirs").groupBy("side").agg(
        F.count(F.lit(1)).alias("files"), F.sum("conflicts").cast("long").alias("conflicts"),
        F.sum(F.size(F.split("merged", "\n", -1))).cast("long").alias("lines"),
    )


@query()
def rename_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents removed (even) and added (odd) of one language, matched by line similarity."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return renames.renamed(d.filter("id % 2 = 0"), d.filter("id % 2 = 1"))
