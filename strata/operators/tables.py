"""Cutting lineage in iterative plans: compressed tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` computed once and written below the checkpoint folder, which survives lost executors.

    Columns lie apart and compressed, a fraction of what a checkpoint of rows takes; ``by`` puts the rows of each of
    its values in files of their own.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    place = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    rows = df.write.option("compression", "zstd")
    (rows.partitionBy(by) if by else rows).parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it local mode gets a folder of its own, and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its driver and executors share")
    return tempfile.mkdtemp(prefix="strata-")
