"""What the operators share: working folders, column handling, byte classes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract of this package.
WHITE_BYTES = b" \t\n\x0b\x0c\r"
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the session names one; without it local
    mode (tests) gets a folder of its own, and a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its driver and executors share")
        base = tempfile.mkdtemp(prefix="strata-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Workspace:
    """Tables that cut lineage, each a Parquet folder below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the reader of what was written."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def flat_utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, and the n + 1 offsets of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def utf8_values(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def bit_table(bits: DataFrame, size: int) -> np.ndarray:
    """A table of ``size`` bits, 64 to a word, from rows of (word, mask).

    Words are merged and put into blocks of 8 KB on the executors, so the driver
    gets size / 8 bytes at most and no row per word.
    """
    block = min(1024, size // 64)

    def fill(table: pa.Table) -> pa.Table:
        words = np.zeros(block, np.int64)
        at = table.column("word").to_numpy()
        np.bitwise_or.at(words, at % block, table.column("mask").to_numpy())
        return pa.table({"block": pa.array([int(at[0]) // block], pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})

    merged = bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).withColumn("block", F.floor(F.col("word") / block))
    out = np.zeros(size // 64, np.uint64)
    for r in merged.groupBy("block").applyInArrow(fill, "block long, words binary").collect():
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(r.words, np.uint64)
    return out


def row_mark(text: Column) -> Column:
    """64 bits of a text: with doc_id they tell rows apart that lack or share a doc_id."""
    return F.xxhash64(text)


def rows_marked(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and mark are in ``kept`` (doc_id, mark), a table; rows that repeat in full once."""
    ids, mark = docs["doc_id"].cast("long"), row_mark(docs["text"].cast("string"))
    found = docs.join(kept, ids.eqNullSafe(kept["doc_id"]) & mark.eqNullSafe(kept["mark"]), "left_semi")
    if not kept.groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", "text"])
    return found.select(*docs.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
