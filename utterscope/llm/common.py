"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its counted rows times their width stay below this.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Rows of an Arrow batch while a table is written: texts and sets are large, and two tasks share an executor.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: White space of the word and line rules: blank and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_folder(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``.

    Only a local session that names no folder, as in tests, gets one of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="utterscope-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/utterscope-llm/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors and fixes row numbers that were drawn while
    writing. :func:`drop_scratch` removes what an application wrote.
    """
    spark = frame.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(frame.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables written by :func:`save`; frames that read them are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a saved table for broadcast when its counted rows fit ``limit``; else leave the join to Spark."""
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than :data:`BLANKS`; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(
        F.size(F.split(bare, r"[\x20\x09-\x0D]+"))
    ).cast("long")


def slices(texts: pa.Array, limit: int = 512 * 1024) -> Iterator[slice]:
    """Cut an Arrow batch into runs of about ``limit`` bytes of text, whole texts each."""
    ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())).to_numpy()
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(ends.searchsorted(before + limit, side="right")))
        yield slice(start, stop)
        start = stop


def released(task: Callable) -> Callable:
    """``task`` of ``mapInArrow``; at its end the worker, which Spark keeps, returns the memory it does not use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()

    return run


def shards(n: int, rows: int) -> int:
    """How many shards of about ``rows`` rows hold ``n`` rows; at least one."""
    return max(1, math.ceil(n / rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most :data:`BATCH_ROWS` rows for the jobs that run inside."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def fresh_names(frame: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores ahead until no column of ``frame`` and no earlier one is called so."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(frame: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``frame`` with its columns of these names renamed, and columns that give it back as it was.

    For operators that add columns of these names: the caller's own come through unchanged.
    """
    wanted = {n.lower() for n in names}
    clashing = [c for c in frame.columns if c.lower() in wanted]
    new = dict(zip(clashing, fresh_names(frame, *clashing)))
    return frame.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in frame.columns]
