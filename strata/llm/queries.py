"""The registered queries of the numbered operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import (
    column_bwt,
    hard_negatives,
    importance_resampling,
    jaccard_join,
    language_bitmask,
    order_minhash,
    packing,
    periodic_runs,
    secret_scan,
    source_mixing,
    stream_dedup,
    tensor_minhash,
    token_counts,
)
from strata.llm.common import documents


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_dedup(documents(spark, sf_dir))


OP2_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM n GROUP BY text_sha256)
SELECT n.doc_id, k.keep_id, k.group_size, n.doc_id = k.keep_id AS kept, n.text_sha256
FROM n JOIN k USING (text_sha256)
"""

def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(documents(spark, sf_dir))


def op4_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_bitmask.identify(documents(spark, sf_dir))


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_duplicates(documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(documents(spark, sf_dir))


# Weights 5, 2, 1 over the sources by code point; the capped sources are those of the
# smallest 3 * size / weight, so one pass in that order finds where capping ends.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
         md5(concat('11:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS rank
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS i,
         CAST((SELECT sum(source_size) FROM s) AS BIGINT) AS total
  FROM s),
c AS (
  SELECT *, total - coalesce(CAST(sum(3 * source_size) OVER b AS BIGINT), 0) AS rest,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS free
  FROM o WINDOW b AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT coalesce(min(i) FILTER (w * rest < 3 * source_size * free), 1 + count(*)) AS first_free FROM c),
t AS (
  SELECT c.source, c.source_size,
         CASE WHEN c.i < f.first_free THEN CAST(3 * c.source_size AS DOUBLE)
              ELSE CAST(c.w * x.rest AS DOUBLE) / x.free END AS target
  FROM c CROSS JOIN f LEFT JOIN c x ON x.i = f.first_free),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         size * (words // source_size) + greatest(0, least(size, words % source_size - before)) END AS taken
FROM r
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op10_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_bwt.remove_repeats(documents(spark, sf_dir))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT d, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT d, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT d, count(*) AS n FROM s GROUP BY d),
c AS (SELECT a.d AS x, b.d AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.d <> b.d GROUP BY a.d, b.d),
l AS (
  SELECT x, y FROM c JOIN n a ON a.d = x JOIN n b ON b.d = y
  WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (
  SELECT d, d AS reached FROM w
  UNION
  SELECT r.d, l.y FROM r JOIN l ON l.x = r.reached)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM r JOIN w ON w.d = r.d JOIN w o ON o.d = r.reached LEFT JOIN n ON n.d = w.d
GROUP BY w.d, w.doc_id
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.every_hundredth(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, positive_score, s.other_id AS negative_id, s.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(documents(spark, sf_dir))


QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_order_minhash": op3_order_minhash,
    "op4_language_bitmask": op4_language_bitmask,
    "op5_cost_packing": op5_cost_packing,
    "op6_tensor_minhash": op6_tensor_minhash,
    "op7_source_mixing": op7_source_mixing,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_column_bwt": op10_column_bwt,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op7_source_mixing": OP7_SQL,
    "op11_jaccard_join": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
