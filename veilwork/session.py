"""Where intermediate tables go, and how small inputs are spread."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# What one task of a spread input gets, about, as the input lies in its files.
SPREAD_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a new folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="veilwork-")
        context.setCheckpointDir(folder)
    return folder


# Spark's 64 MB and 10,000 rows: a task holds several times that in and out of Python, whatever the texts' length.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed meanwhile reaches Python in Arrow batches of about 4 MB at most, all of it."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Computed now and kept as a table on shared storage.

    The table outlives executors, cuts the lineage, is read column by column and
    has a known size, so that later joins are planned on facts.
    """
    path = new_folder(df.sparkSession, "table")
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """Use all cores for an input that is smaller than one split per core.

    Scanning texts is CPU-bound, and a small file is one task.  Anything that
    already fills the cores comes back unchanged, without a shuffle.  The number of parts grows
    with the input, so that what a task reads does not.  ``like`` is
    a table of the size to go by, for a stream whose own size is not known.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    sized = df if like is None else like
    size = int(sized._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(cores, -(-size // SPREAD_BYTES)), *keys) if size < cores * split else df
