"""Cutting the lineage of intermediate tables that are read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="utterscope-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark).rstrip('/')}/utterscope/{name}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back.

    The result survives the loss of executors, is computed once, and its row count and size cost
    next to nothing to ask for.
    """
    spark = frame.sparkSession
    path = fresh_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs that run inside."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def spread(scan: DataFrame) -> DataFrame:
    """Give every core work on a scan that has fewer partitions than the cluster has cores.

    Meant for small or unsplittable inputs ahead of expensive expressions. A large splittable scan
    is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def broadcast_if_small(
    table: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Mark a materialized table for broadcast when its rows, of at most ``row_bytes``, fit ``limit``."""
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


def vector_table_bytes(vectors: DataFrame, column: str) -> tuple[int, int]:
    """Row count of a materialized table and a bound for the bytes of its rows in memory."""
    row = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("values")
    ).first()
    return row["n"], 8 * row["values"] + 256 * row["n"]
