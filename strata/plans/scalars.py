"""Queries of the scalar functions: inputs are arithmetic on the driver's tables, so SQL can say what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import scalars as S
from strata.functions import shell
from strata.functions import text as T
from strata.plans.registry import query, table


def _pick(values: tuple, number: Column) -> Column:
    """The value at ``number`` modulo their count."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _sql_pick(values: tuple, number: str) -> str:
    items = ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[CAST({number} % {len(values)} + 1 AS BIGINT)]"


DECLS = ("function_item", "method_declaration", "type_spec", "class_definition", "struct_item", "trait_item", "interface_declaration", "const_declaration", "macro_item")
DECL_SHORT = ("func", "func", "type", "class", "struct", "trait", "interface", "const", "macro_item")


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'preamble:0' ELSE {_sql_pick(DECL_SHORT, "p_partkey")} ||
  CASE WHEN p_size % 3 = 0 THEN ' (' || p_brand || ')' ELSE '' END || ' ' || p_name END AS display FROM part
""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities as people read them: the short kind, the receiver and the name."""
    kind = F.when(F.col("p_partkey") % 5 == 0, "preamble").otherwise("declaration")
    receiver = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise("")
    name = S.display_name(kind, _pick(DECLS, F.col("p_partkey")), receiver, F.col("p_name"), F.lit("preamble:0"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("display"))


WANTED = ("Func", "type", "method", "class", "struct", "interface", "const", "MACRO", "item")
WANTED_SQL = """CASE f WHEN 'Func' THEN d = 'function_item' WHEN 'type' THEN d = 'type_spec' WHEN 'method' THEN d = 'method_declaration'
  WHEN 'class' THEN d = 'class_definition' WHEN 'struct' THEN d = 'struct_item' WHEN 'interface' THEN d = 'interface_declaration'
  WHEN 'const' THEN d = 'const_declaration' WHEN 'MACRO' THEN d = 'macro_item' ELSE contains(d, 'item') END"""


@query(f"""
SELECT p_partkey, f AS filter FROM (SELECT p_partkey, {_sql_pick(DECLS, "p_partkey")} AS d, {_sql_pick(WANTED, "p_size")} AS f FROM part) WHERE {WANTED_SQL}
""")
def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of a searched kind."""
    wanted = _pick(WANTED, F.col("p_size"))
    held = S.is_kind(_pick(DECLS, F.col("p_partkey")), wanted)
    return table(spark, sf_dir, "part").filter(held).select("p_partkey", wanted.alias("filter"))


FORMATS = ("json", "go", "yaml", "python", "toml", "csv", "")


@query(f"""
SELECT doc_id, l IN ('json', 'yaml', 'toml', 'csv') AS is_data, l IN ('json', 'yaml', 'toml', 'csv') AND doc_id % 4 <> 0 AND size > 262144 AS skipped
FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) * 40 AS size, {_sql_pick(FORMATS, "doc_id")} AS l FROM documents)
""")
def extraction_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are not taken apart: large ones of a data format, unless forced."""
    language = _pick(FORMATS, F.col("doc_id"))
    size = F.octet_length("text").cast("long") * 40
    skipped = S.skips_extraction(language, size, F.col("doc_id") % 4 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", S.is_data_format(language).alias("is_data"), skipped.alias("skipped"))


@query("""
SELECT doc_id, doc_id % 3 = 0 OR contains(text, chr(0)) AS whole, (doc_id % 3 = 0 AND strlen(text) < 8192) OR contains(text[1:8192], chr(0)) AND doc_id % 3 = 0 AS head
FROM documents WHERE NOT contains(text, chr(0))
""")
def binary_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content with a NUL anywhere, and in its first 8192 bytes; every third document gets one at its end."""
    d = table(spark, sf_dir, "documents").filter(~S.is_binary(F.col("text")))
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.encode("text", "UTF-8"), F.lit(b"\0"))).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", S.is_binary(content).alias("whole"), S.is_binary(content, S.BINARY_HEAD).alias("head"))


@query("""
SELECT o_orderkey, sha256('decl:func:' || o_clerk || ':' || CAST(o_custkey AS VARCHAR)) AS hash, sha256('decl:func:' || o_clerk || ':' || CAST(o_custkey AS VARCHAR))[1:8] AS short FROM orders
""" .replace("o_clerk", "o_orderpriority"))
def entity_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of identity keys, whole and as shown."""
    hash_ = F.sha2(F.concat_ws(":", F.lit("decl"), F.lit("func"), "o_orderpriority", F.col("o_custkey").cast("string")), 256)
    return table(spark, sf_dir, "orders").select("o_orderkey", hash_.alias("hash"), S.short_hash(hash_).alias("short"))


@query("""
SELECT c_custkey, split_part(c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'body' || chr(10) || 'more' ELSE '' END, chr(10), 1) AS title,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_name ELSE c_name || ' <' || lower(c_mktsegment) || '@example.org>' END AS author,
  CASE WHEN c_nationkey < 12 THEN '-' ELSE '+' END || lpad(CAST(abs(c_nationkey - 12) AS VARCHAR), 2, '0') || CASE WHEN c_custkey % 3 = 0 THEN '30' ELSE '00' END AS zone
FROM customer
""")
def commit_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of messages, authors with and without name or address, and zone offsets."""
    k = F.col("c_custkey")
    message = F.when(k % 2 == 0, F.concat("c_name", F.lit("\nbody\nmore"))).otherwise(F.col("c_name"))
    name = F.when(k % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("c_name")))
    email = F.when(k % 4 == 1, F.lit(" ")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("@example.org ")))
    sign = F.when(F.col("c_nationkey") < 12, -1).otherwise(1)
    seconds = sign * (F.abs(F.col("c_nationkey") - 12) * 3600 + F.when(k % 3 == 0, 1800).otherwise(0))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.first_line(message).alias("title"), S.author(name, email).alias("author"), S.zone_offset(seconds).alias("zone")
    )


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '100755' ELSE '100644' END AS mode, p_partkey % 4 = 0 AS valid FROM part
""")
def modes_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File modes of two kinds, and what is a hash: 64 lower-case hexadecimal digits."""
    mode = _pick(("100755", "100644", "", "100664", None, "120000"), F.col("p_size"))
    mode = F.when(F.col("p_size") % 3 == 0, F.lit("100755")).otherwise(F.when(mode == "100755", "").otherwise(mode))
    hash_ = F.sha2("p_name", 256)
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, hash_).when(k == 1, F.upper(F.concat(F.lit("A"), F.substring(hash_, 2, 63)))).when(k == 2, F.left(hash_, F.lit(63)))
    return table(spark, sf_dir, "part").select("p_partkey", T.file_mode(mode).alias("mode"), T.is_hash(text).alias("valid"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'func ' || p_name WHEN 1 THEN 'func (' || p_brand || ') ' || p_name ELSE '' END AS annotation FROM part
""")
def conflict_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity that a conflict marker names."""
    k = F.col("p_partkey") % 4
    inside = F.when(k == 0, F.concat(F.lit(" (func "), "p_name", F.lit(")"))).when(k == 1, F.concat(F.lit(" (func ("), "p_brand", F.lit(") "), "p_name", F.lit(")")))
    line = F.concat(F.lit("<<<<<<< ours"), F.coalesce(inside, F.when(k == 2, F.concat(F.lit(" ("), "p_name")).otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", S.conflict_annotation(line).alias("annotation"))


RAW = ("Go::func $F", "a b::c", "::x", "plain", "rust::a::b", "src/x::y")


@query(f"""
SELECT o_orderkey, {_sql_pick(("go", "", "", "", "rust", ""), "o_orderkey")} AS lang,
  {_sql_pick(("func $F", "a b::c", "::x", "plain", "a::b", "src/x::y"), "o_orderkey")} AS pattern FROM orders
""")
def grep_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural patterns cut into language and pattern."""
    lang, pattern = S.grep_pattern(_pick(RAW, F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", lang.alias("lang"), pattern.alias("pattern"))


LIMITS = ("max_batch=50, max_object = 7,x=1", "max_batch=-3,max_payload=9", "", "max_batch=4,max_batch=6,max_payload=z", "max_object=0")


@query(f"""
SELECT o_orderkey, {_sql_pick((50, 0, 0, 6, 0), "o_orderkey")} AS batch, {_sql_pick((0, 9, 0, 0, 0), "o_orderkey")} AS payload,
  {_sql_pick((7, 0, 0, 0, 0), "o_orderkey")} AS object, CASE WHEN o_orderkey % 3 = 0 THEN 'pack,shallow' WHEN o_orderkey % 3 = 1 THEN 'zstd' ELSE '' END AS caps FROM orders
""")
def protocol_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits and capabilities as the other side announces them."""
    raw, k = _pick(LIMITS, F.col("o_orderkey")), F.col("o_orderkey") % 3
    caps = F.when(k == 0, " shallow, pack,,pack ").when(k == 1, "zstd").otherwise(" , ")
    limits = [S.limit(raw, f"max_{x}").alias(x) for x in ("batch", "payload", "object")]
    return table(spark, sf_dir, "orders").select("o_orderkey", *limits, F.array_join(S.capabilities(caps), ",").alias("caps"))


FILTERS = ("blob:none", " blob:limit=2000 ", "tree:3", "blob:limit=-1", "", "blob:limit=0", "tree:x")


@query(f"""
SELECT doc_id, t AS type, d AS tree_depth, CASE t WHEN 'blob:none' THEN FALSE WHEN 'blob:limit' THEN size < l WHEN 'tree' THEN TRUE END AS allowed
FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, {_sql_pick(("blob:none", "blob:limit", "tree", None, None, "blob:limit", None), "doc_id")} AS t,
  {_sql_pick((0, 2000, 0, None, None, 0, None), "doc_id")} AS l, {_sql_pick((0, 0, 3, None, None, 0, None), "doc_id")} AS d FROM documents) WHERE t IS NOT NULL
""")
def object_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial-clone filters that are valid, and which blobs pass them."""
    f = table(spark, sf_dir, "documents").select("doc_id", S.object_filter(_pick(FILTERS, F.col("doc_id"))).alias("f"), F.octet_length("text").alias("size"))
    allowed = S.allows_blob(F.col("f"), F.col("size"))
    return f.filter("f IS NOT NULL").select("doc_id", "f.type", "f.tree_depth", allowed.alias("allowed"))


@query("""
SELECT p_partkey, p_brand LIKE 'Brand#1_' AND regexp_matches(p_name, '^[^/]*t$') AS owned, regexp_matches(p_name, '^b[^:]*$') AS guarded,
  p_brand = 'Brand#22' AS whole, regexp_matches(p_name, '^[a-m][^/]* [^/]*$') AS classed
FROM part
""")
def entity_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ways in which patterns name entities: owners, guarded ones, and the log's filter."""
    key = F.concat_ws(":", "p_brand", "p_name")
    kinds = [S.owner_entity(f"Brand#1{i}:*t", key) for i in range(10)]
    owned = kinds[0]
    for k in kinds[1:]:
        owned = owned | k
    guarded = S.config_entity("*:b*", key)
    return table(spark, sf_dir, "part").select(
        "p_partkey", owned.alias("owned"), guarded.alias("guarded"), S.config_entity("Brand#22:*", key).alias("whole"),
        S.reflog_entity("[a-m]* *", F.col("p_name")).alias("classed"),
    )


@query("""
WITH x AS (SELECT DISTINCT p_type AS name FROM part WHERE p_size % 7 = 0),
c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_name) END AS name, p_type FROM part)
SELECT p_partkey, regexp_matches(c.name, '^[A-Z]') OR x.name IS NOT NULL AS exported FROM c LEFT JOIN x USING (name)
""")
def exported_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of exported entities: by the export index, else by the capital of the name."""
    p = table(spark, sf_dir, "part")
    index = p.filter("p_size % 7 = 0").select(F.concat(F.lit("type:"), "p_type").alias("k")).select(T.key_name(F.col("k")).alias("name")).distinct()
    key = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("type:"), "p_type")).otherwise(F.concat(F.lit("func:"), F.lower("p_name")))
    c = p.select("p_partkey", T.key_name(key).alias("name"))
    found = c.join(index.withColumn("listed", F.lit(True)), "name", "left")
    return found.select("p_partkey", (S.is_exported(F.col("name")) | F.coalesce("listed", F.lit(False))).alias("exported"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'example.org/m/pkg' || CAST(s_nationkey AS VARCHAR) || '.' || s_name WHEN 1 THEN 'example.org/m.' || s_name
  WHEN 2 THEN 'pkg' || CAST(s_nationkey AS VARCHAR) || '.' || s_name ELSE s_name END AS name FROM supplier
""")
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    module = F.when(k < 2, "example.org/m").otherwise("")
    package = F.when(k % 2 == 0, F.concat(F.lit("pkg"), F.col("s_nationkey").cast("string"))).otherwise("")
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.qualified_name(module, package, F.col("s_name")).alias("name"))


@query("""
SELECT o_orderkey, 0 AS place, 'a:b,c%' AS path, 'declaration:' || o_orderstatus AS entity, 'modify' AS change FROM orders WHERE o_orderkey % 3 <> 2
UNION ALL SELECT o_orderkey, 1, 'p' || CAST(o_custkey AS VARCHAR), 'func', 'create' FROM orders WHERE o_orderkey % 3 = 0
""")
def reflog_entity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity changes of a log line, with the escapes of their paths undone."""
    k = F.col("o_orderkey") % 3
    first = F.concat(F.lit("a%3Ab%2Cc%25:declaration:"), "o_orderstatus", F.lit(":modify"))
    data = F.when(k == 0, F.concat(first, F.lit(", bad:item,,p"), F.col("o_custkey").cast("string"), F.lit(":func:create"))).when(k == 1, first).otherwise("  ")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(S.entity_changes(data)).alias("place", "c"))
    return rows.select("o_orderkey", "place", "c.path", "c.entity", "c.change")


# a command line; program, subcommand; what it does: a allowed by default, f writes files, r writes the repository,
# c writes coordination, n network, q needs the repository, d destroys; the paths it names; its profile
COMMANDS = (
    ("/bin/cat a.txt", "cat", "a.txt", "a", "", "read_only"),
    ("sed -i s/a/b/ f", "sed", "s/a/b/", "f", "", "repo_write"),
    ("sed -n 1p f", "sed", "1p", "a", "", "read_only"),
    ("rm -rf build", "rm", "build", "fd", "build", "repo_write"),
    ("rm -r .", "rm", ".", "fd", ".", "repo_write"),
    ("rm -i old.txt", "rm", "old.txt", "f", "old.txt", "repo_write"),
    ("curl -s http://x", "curl", "http://x", "n", "", "network_read"),
    ("git", "git", "", "a", "", "read_only"),
    ("git status", "git", "status", "a", "", "read_only"),
    ("git fetch origin", "git", "fetch", "nq", "", "network_read"),
    ("git push origin main", "git", "push", "rnq", "", "repo_write_network"),
    ("git reset --hard HEAD", "git", "reset", "rqd", "", "repo_write"),
    ("git clean -fd", "git", "clean", "rqd", "", "repo_write"),
    ("git checkout -- f.go", "git", "checkout", "rqd", "f.go", "repo_write"),
    ("git add -p a b", "git", "add", "rq", "a,b", "repo_write"),
    ("git frobnicate", "git", "frobnicate", "rq", "", "repo_write"),
    ("git restore --staged x", "git", "restore", "rqd", "x", "repo_write"),
    ("strata log", "strata", "log", "a", "", "read_only"),
    ("strata coord join", "strata", "coord", "ac", "", "repo_write"),
    ("strata clone url", "strata", "clone", "af", "", "repo_write"),
    ("strata pull", "strata", "pull", "rnq", "", "repo_write_network"),
    ("strata add x y", "strata", "add", "rq", "x,y", "repo_write"),
    ("strata other", "strata", "other", "fq", "", "repo_write"),
    ("make -j all", "make", "all", "f", "", "repo_write"),
    ("unknown-tool x", "unknown-tool", "x", "f", "", "repo_write"),
    ("touch  a  -c b", "touch", "a", "f", "a,b", "repo_write"),
    ("", "", "", "", "", "read_only"),
)
FLAGS = {"default_allowed": "a", "writes_filesystem": "f", "writes_repo": "r", "writes_coord": "c", "network": "n", "requires_repo": "q", "destructive": "d"}


def _argv() -> Column:
    line = _pick(tuple(c[0] for c in COMMANDS), F.col("o_orderkey"))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def _sql_column(i: int) -> str:
    return _sql_pick(tuple(c[i] for c in COMMANDS), "o_orderkey")


@query(f"""
SELECT o_orderkey, {_sql_column(1)} AS program, {_sql_column(2)} AS subcommand, 'shell:' || regexp_replace({_sql_column(0)}, ' +', ' ', 'g') AS selector,
  {", ".join(f"contains({_sql_column(3)}, '{c}') AS {n}" for n, c in FLAGS.items())} FROM orders
""")
def shell_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command lines and what each of them touches."""
    return table(spark, sf_dir, "orders").select("o_orderkey", shell.inspect(_argv()).alias("a")).select("o_orderkey", "a.*")


@query(f"SELECT o_orderkey, {_sql_column(4)} AS files, {_sql_column(5)} AS profile FROM orders")
def command_files_and_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that a command line names and the least profile under which it can run."""
    files = F.array_join(F.filter(shell.files_of(_argv()), lambda x: x != ""), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", files.alias("files"), shell.profile_for(shell.inspect(_argv())).alias("profile"))


NAMES = ("blocked", "read_only", "repo_write", "network_read", "repo_write_network")


@query("""
WITH p(name, f, n, d) AS (VALUES ('blocked', 0, 1, 1), ('read_only', 1, 1, 1), ('repo_write', 2, 1, 2), ('network_read', 1, 2, 1), ('repo_write_network', 2, 2, 2))
SELECT a.name AS granted, b.name AS required, count(*) AS n, a.f >= b.f AND a.n >= b.n AND a.d >= b.d AS allowed
FROM orders o JOIN p a ON a.name = (['blocked', 'read_only', 'repo_write', 'network_read', 'repo_write_network'])[CAST(o_orderkey % 5 + 1 AS BIGINT)]
JOIN p b ON b.name = (['blocked', 'read_only', 'repo_write', 'network_read', 'repo_write_network'])[CAST(o_custkey % 5 + 1 AS BIGINT)]
GROUP BY ALL
""")
def profile_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which profile is enough for which other one."""
    granted, required = _pick(NAMES, F.col("o_orderkey")), _pick(NAMES, F.col("o_custkey"))
    allowed = shell.profile_allows(shell.profile(granted), shell.profile(required))
    o = table(spark, sf_dir, "orders").select(granted.alias("granted"), required.alias("required"), allowed.alias("allowed"))
    return o.groupBy("granted", "required", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, starts_with(s, 'shell:git ') OR s = 'shell:MAIL' AS allowed
FROM (SELECT l_orderkey, l_linenumber, 'shell:' || CASE WHEN l_linenumber % 2 = 0 THEN 'git ' ELSE '' END || l_shipmode AS s FROM lineitem)
""".replace("l_shipmode", "CASE WHEN l_quantity < 20 THEN 'MAIL' ELSE 'AIR' END"))
def allowlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors on a list whose entries are exact or end in a star."""
    mode = F.when(F.col("l_quantity") < 20, "MAIL").otherwise("AIR")
    selector = F.concat(F.lit("shell:"), F.when(F.col("l_linenumber") % 2 == 0, "git ").otherwise(""), mode)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.allowed_selector(selector, [" shell:git *", "", "shell:MAIL"]).alias("allowed"))
