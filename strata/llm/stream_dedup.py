"""Exact deduplication as a stateful stream.

Every arriving document is reduced to ``(digest, doc_id, n_chars, locator)``
and appended to an inbox.  A Structured Streaming aggregation keyed by the
digest keeps, in RocksDB and without expiry, the stable identifier and content
locator of the document that stays and the number of documents seen.  A later
call with the same ``state_dir`` reads only what is new in the inbox; the state
carries on.  Whatever hits a digest that is already held is then compared with
the full text of the document that stays, so a digest collision cannot merge
different texts; where that text cannot be found again, the call fails.

Defined results: null text counts as empty; a null ``doc_id`` sorts after every
other; rows that repeat in full are members of one group and each gets a row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import hashlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import WHITE_BYTES, Workspace, row_mark, rows_marked, shared_dir, utf8_values

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Many small stores: without fallocate each takes the disk it fills, not 4 MB and more;
#: all stores of an executor share one bound of memory, and idle ones are closed soon.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


Digest = Callable[[bytes], bytes]


def sha256_digest(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


def _arrivals(docs: DataFrame, digest: Digest, with_body: bool = False) -> DataFrame:
    """doc_id, n_chars, digest, text_sha256, locator and, if asked for, the normalised bytes."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            bodies = [x.translate(None, WHITE_BYTES) for x in utf8_values(texts)]
            columns = [
                batch.column("doc_id"),
                pc.cast(pc.utf8_length(texts), pa.int64()),
                pa.array([digest(x) for x in bodies], pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string()),
                batch.column("locator"),
                batch.column("mark"),
            ]
            names = ["doc_id", "n_chars", "digest", "text_sha256", "locator", "mark"]
            if with_body:
                columns.append(pa.array(bodies, pa.binary()))
                names.append("body")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_chars long, digest binary, text_sha256 string, locator string, mark long"
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["text"].cast("string").alias("text"),
        F.input_file_name().alias("locator"),
        row_mark(docs["text"].cast("string")).alias("mark"),
    ).mapInArrow(reduce, schema + ", body binary" * with_body)


def _advance_state(spark: SparkSession, state_dir: str, inbox: DataFrame) -> DataFrame:
    """Run the stateful stream over what is new in the inbox; the newest row of each digest."""
    own = spark.newSession()  # the options of the state are not the caller's
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in STREAM_CONF.items():
        own.conf.set(key, value)
    seen = own.readStream.schema(inbox.schema).parquet(f"{state_dir}/inbox")
    # the greatest length, then the smallest id: ~id falls as id rises and a null is smallest
    keyed = seen.groupBy("digest").agg(
        F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("rank"), "doc_id", "locator")).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )

    def publish(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state_dir}/changes/batch={batch:09d}")

    (
        keyed.writeStream.outputMode("update")
        .option("checkpointLocation", f"{state_dir}/stream")
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
        .awaitTermination()
    )
    changes = spark.read.schema(
        "digest binary, best struct<n_chars:long,rank:long,doc_id:long,locator:string>, group_size long, batch int"
    ).parquet(f"{state_dir}/changes")
    newest = changes.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s"))
    return newest.select("digest", "s.best", "s.group_size")


def exact_dedup(
    docs: DataFrame,
    state_dir: str | None = None,
    digest: Digest = sha256_digest,
) -> DataFrame:
    """One row per document of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``state_dir`` names the stream's durable state; calls that share it see one
    growing collection, and keep_id and group_size then cover all documents
    that have arrived.  Texts of earlier calls are found again by their locator; a
    ValueError tells of a text that is not.
    """
    return _deduplicated(docs, state_dir, digest).drop("mark")


def _deduplicated(docs: DataFrame, state_dir: str | None, digest: Digest) -> DataFrame:
    """What ``exact_dedup`` returns, with each row's mark."""
    spark = docs.sparkSession
    own = state_dir is None
    state_dir = state_dir or f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    work = Workspace(spark, "dedup-check")

    arrived = _arrivals(docs, digest)
    arrived.write.mode("append").parquet(f"{state_dir}/inbox")
    inbox = spark.read.schema(arrived.schema).parquet(f"{state_dir}/inbox")
    state = work.write(_advance_state(spark, state_dir, inbox), "state")
    shared = state.filter("group_size > 1").select(
        "digest", F.col("best.doc_id").alias("keep_id"), "best.locator", "group_size"
    )

    # full bytes on hits: only documents of shared digests carry their text on
    if own:
        held = docs
    else:
        places = [r[0] for r in inbox.select("locator").distinct().toLocalIterator() if r[0]]
        held = spark.read.parquet(*places) if places else docs
    texts = _arrivals(held, digest, with_body=True)
    hits = work.write(texts.select("doc_id", "digest", "body").join(shared.select("digest", "keep_id"), "digest"), "hits")
    # a table of its own: a join of two tables lets a digest of many copies be split over tasks
    kept = hits.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("kept_body"))
    kept = work.write(kept, "kept")
    if not hits.select("digest").distinct().join(kept, "digest", "left_anti").isEmpty():
        raise ValueError("the text of a document that stays was not found at its locator, so hits cannot be compared with it")
    checked = hits.join(kept, "digest").select("digest", (F.col("body") != F.col("kept_body")).alias("differs"))
    mixed = work.write(checked.filter("differs").select("digest"), "mixed").distinct()

    out = inbox.join(shared, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
        "digest",
        "mark",
    )
    if not mixed.isEmpty():
        out = out.join(mixed, "digest", "left_anti").unionByName(_split_by_bytes(texts.join(mixed, "digest")))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "mark",
    )


def _split_by_bytes(rows: DataFrame) -> DataFrame:
    """Groups of the digests that different texts share, told apart by their bytes."""
    rows = rows.withColumn("rank", F.bitwise_not("doc_id"))
    best = rows.groupBy("digest", "body").agg(
        F.max(F.struct("n_chars", "rank", "doc_id")).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    return rows.join(best, ["digest", "body"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "text_sha256", "digest", "mark"
    )


def keep_first_of_equal(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; of rows that repeat in full one stays."""
    work = Workspace(docs.sparkSession, "dedup-kept")
    rows = work.write(_deduplicated(docs, None, sha256_digest).filter("kept").select("doc_id", "mark", "text_sha256"), "rows")
    # rows without a doc_id, or with a repeated one, are told apart by their mark
    one = rows.groupBy("text_sha256").agg(F.min("mark").alias("mark"))
    kept = rows.join(one, ["text_sha256", "mark"]).select("doc_id", "mark")
    return rows_marked(docs, work.write(kept, "kept"))
