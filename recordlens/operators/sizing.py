"""Choosing between a broadcast and a shuffle by a checked size, and splitting hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A query is at most 500 characters, 24 terms and one vector, so this many
# queries stay near 100 MB in every form in which they are broadcast.
MAX_BROADCAST_QUERIES = 20_000
# Ids broadcast to pick rows out of a large table: a few hundred MB at most.
MAX_BROADCAST_IDS = 2_000_000
# Chunks of one vehicle that may meet in one task.
CHUNKS_PER_SALT = 1_000_000


def is_small(df: DataFrame, rows: int = MAX_BROADCAST_QUERIES) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than it must."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def keep_ids(df: DataFrame, ids: DataFrame, key: str, rows: int = MAX_BROADCAST_IDS) -> DataFrame:
    """The rows of a large table whose ``key`` is listed.

    ``ids`` comes from a written table, so counting it is cheap.  Up to ``rows``
    ids are broadcast and the table is filtered where it is read, before its
    texts meet any shuffle; more are joined by a shuffle.
    """
    wanted = ids.select(key).distinct()
    return df.join(F.broadcast(wanted) if is_small(wanted, rows) else wanted, key, "left_semi")


def spread(scan: DataFrame) -> DataFrame:
    """Use every core on a scan with fewer splits than cores; larger scans stay as they are.

    Meant for a plain file scan, whose splits are known without running a job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def hot_vehicles(corpus: DataFrame, chunks_per_salt: int = CHUNKS_PER_SALT) -> DataFrame:
    """``vehicle_id, salts`` of the vehicles too large for one task.

    There are at most (all chunks / ``chunks_per_salt``) of them, which bounds
    what is broadcast: a hundred thousand rows for a hundred billion chunks.
    """
    return (
        corpus.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("chunks"))
        .where(F.col("chunks") > chunks_per_salt)
        .select("vehicle_id", F.ceil(F.col("chunks") / chunks_per_salt).cast("int").alias("salts"))
    )


def salted(df: DataFrame, key: Column, hot: DataFrame) -> DataFrame:
    """The large side of a join: rows of a hot vehicle are spread over its salts."""
    return df.join(F.broadcast(hot), "vehicle_id", "left").withColumn(
        "salt", F.pmod(F.xxhash64(key), F.coalesce("salts", F.lit(1))).cast("int")
    ).drop("salts")


def replicated(df: DataFrame, hot: DataFrame) -> DataFrame:
    """The small side: rows of a hot vehicle are repeated for each of its salts, others stay single."""
    return df.join(F.broadcast(hot), "vehicle_id", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    ).drop("salts")
