"""Readers of a repository's small files: refs, the index, the commit graph, modules, signers, coordination records.

All go through Spark's own readers, so they read whatever store Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.text import is_hash, stripped

INDEX = (
    "entries map<string, struct<path: string, blob_hash: string, entity_list_hash: string, mode: string, conflict: boolean, "
    "base_blob_hash: string, ours_blob_hash: string, theirs_blob_hash: string, mod_time: bigint, size: bigint>>"
)
COMMIT_GRAPH = "version int, entries map<string, struct<tree: string, parents: array<string>, generation: bigint, timestamp: bigint>>"
MODULE_LOCK = "modules map<string, struct<commit: string, url: string, track: string>>"
MODULE_KEYS = ("url", "path", "track", "pin")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every file below a folder (or of one file)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("content").cast("string").alias("text"))


def read_refs(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(name, hash) of the refs below ``folder``/refs whose name begins with ``prefix``; a ref that holds no hash has a null."""
    files = _whole(spark, f"{folder}/refs")
    name, text = F.substring_index("path", "/refs/", -1), stripped(F.regexp_replace("text", r"\s+$", ""))
    return files.select(name.alias("name"), F.when(is_hash(text), text).alias("hash")).filter(F.col("name").startswith(prefix))


def branches(refs: DataFrame) -> DataFrame:
    """(branch, hash) of refs."""
    return refs.filter(F.col("name").startswith("heads/")).select(F.substring("name", 7, 1 << 20).alias("branch"), "hash")


def tags(refs: DataFrame) -> DataFrame:
    """(tag, hash) of refs."""
    return refs.filter(F.col("name").startswith("tags/")).select(F.substring("name", 6, 1 << 20).alias("tag"), "hash")


def _json(spark: SparkSession, path: str, schema: str, field: str, key: str) -> DataFrame:
    """One row for each entry of a JSON map."""
    held = spark.read.schema(schema).option("multiLine", "true").json(path)
    return held.select(F.explode(field).alias(key, "_v")).select(key, "_v.*")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The staged files: path, hashes of blob, entities and the sides of a conflict, mode, times."""
    return _json(spark, path, INDEX, "entries", "staged").drop("staged")


def read_commit_graph(spark: SparkSession, path: str) -> DataFrame:
    """hash, tree, parents, generation, timestamp."""
    return _json(spark, path, COMMIT_GRAPH, "entries", "hash")


def read_module_lock(spark: SparkSession, path: str) -> DataFrame:
    """name, commit, url, track of pinned modules."""
    return _json(spark, path, MODULE_LOCK, "modules", "name")


def parse_modules(files: DataFrame) -> DataFrame:
    """path of the file, name, url, path, track, pin of each section ``[module "name"]`` of texts in column text.

    Lines of a file are numbered within it, so sections need no order among files.
    """
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    line = stripped(F.regexp_replace("line", r"\s[#;].*$", ""))
    lines = lines.select("file", "no", line.alias("line")).filter("line != '' AND NOT startswith(line, '#') AND NOT startswith(line, ';')")
    name = F.regexp_extract("line", r'^\[module "(.*)"\]$', 1)
    ordered = F.array_sort(F.collect_list(F.struct("no", F.when(name != "", name).alias("name"), "line")))
    whole = lines.groupBy("file").agg(ordered.alias("l"))
    # each line with the section that opened last before it
    start = F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("line")))
    carried = F.aggregate("l", start, lambda acc, x: F.concat(acc, F.array(F.struct(F.coalesce(x["name"], F.element_at(acc, -1)["name"]).alias("name"), x["line"].alias("line")))))
    rows = whole.select("file", F.explode(carried).alias("r")).select("file", "r.name", "r.line").filter("name != ''")
    key, value = stripped(F.substring_index("line", "=", 1)), stripped(F.regexp_extract("line", "=(.*)$", 1))
    return rows.groupBy("file", "name").agg(*(F.max(F.when(key == k, value)).alias(k) for k in MODULE_KEYS))


def read_modules(spark: SparkSession, path: str) -> DataFrame:
    return parse_modules(_whole(spark, path))


def parse_signers(lines: DataFrame) -> DataFrame:
    """(email, key) of lines ``email type data`` in column value; the last line of an email counts."""
    part = F.split(stripped(F.col("value")), " ", 3)
    rows = lines.filter("trim(value) != '' AND NOT startswith(trim(value), '#')").select(
        part[0].alias("email"), F.concat(part[1], F.lit(" "), part[2]).alias("key"), F.monotonically_increasing_id().alias("no")
    )
    return rows.groupBy("email").agg(F.max_by("key", "no").alias("key"))


def parse_shallow(lines: DataFrame) -> DataFrame:
    """(hash) of the commits at which a shallow history ends; other lines are left out."""
    text = stripped(F.col("value"))
    return lines.select(text.alias("hash")).filter(is_hash(F.col("hash"))).distinct()


def read_records(spark: SparkSession, folder: str, schema: str, order: str | None = None) -> DataFrame:
    """Coordination records, one JSON file each or one JSON line each, with an explicit schema; damaged ones are left out."""
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json*").json(folder)
    return found.orderBy(order) if order else found


# schemas of the coordination records
DECISION = "id string, kind string, entity string, agent string, action string, rule string, created_at timestamp"
SESSION = "id string, agent string, host string, started_at timestamp, heartbeat_at timestamp"
EVENT = "id string, type string, agent string, spawn_id string, at timestamp, detail string"
SNAPSHOT = "id string, branch string, head string, dirty boolean, created_at timestamp"
EXEC_TRACE = "id string, spawn_id string, argv array<string>, exit_code int, started_at timestamp, finished_at timestamp"
SPAWN = "id string, parent string, name string, status string, profile string, created_at timestamp, heartbeat_at timestamp"


def stale(sessions: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Sessions without a heartbeat for longer than ``seconds``."""
    return sessions.filter(F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") > seconds)
