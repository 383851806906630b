"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, if it names one."""
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)


def steady_unions(spark: SparkSession) -> None:
    """Let a union hide the partitioning of its inputs.

    Spark 4.1 plans on it, but adaptive execution may change one input's
    partition count afterwards, and the job then fails to zip them.  Every union
    here joins short lists, so the shuffle this saves is not worth the risk.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result that is read several times to the shared checkpoint folder, and read it back.

    It is computed once, outlives the executors that computed it, and comes back
    with its size known.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While this lasts, a Python function is handed ``rows`` rows at a time: for long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for written intermediate tables, inside the shared checkpoint folder.

    Only a local session, which has one machine, may fall back on its own disk.
    """
    shared = checkpoint_dir(spark)
    if shared:
        return f"{shared.rstrip('/')}/recordlens-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.mkdtemp(prefix="recordlens-"), "table")
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
