"""Incremental loads as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.vectors import EMBEDDING_DIMENSIONS
from ..operators.catalog import STATE_LEVEL, load_state
from ..operators.planning import dedupe_first
from ..plans.embed import MAX_BATCH, Provider, embed, pending_chunks, require_provider
from ..schemas import EMBEDDINGS
from ..sources.keys import KEYS_A_FILE, RUNS_A_LEVEL, StoredKeys
from ..sources.tables import read_or_empty

def read_landing(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that land in a folder, or that match a pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def insert_if_absent(
    table: str, keys: list[str], order: str, width: int = RUNS_A_LEVEL, keys_a_file: int = KEYS_A_FILE,
) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds the rows whose key the table does not hold.

    Keys are looked up in ``<table>.keys`` (``StoredKeys``); the table itself is not read.
    Each batch has its own folder and looks only at the others, so a batch that
    is run again after a failure writes the same rows over itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        fields = {f.name: f.dataType.simpleString() for f in batch.schema}
        spark = batch.sparkSession
        held = StoredKeys(spark, f"{table}.keys", keys, ", ".join(f"`{k}` {fields[k]}" for k in keys), width, keys_a_file)
        held.merge(before=batch_id)
        fresh = without_stored(batch, held.stored(batch, without=batch_id), keys)
        path = f"{table}/batch_id={batch_id}"
        dedupe_first(fresh, keys, order).select(*batch.columns).write.mode("overwrite").parquet(path)
        held.add(spark.read.schema(batch.schema).parquet(path), batch_id)

    return write


def without_stored(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a batch whose key is not stored; null keys are keys too."""
    on = F.lit(True)
    for key in keys:
        on = on & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    return batch.alias("a").join(stored.alias("b"), on, "left_anti")


def stream_landing(
    spark: SparkSession, in_dir: str, schema: str, table: str, keys: list[str], order: str,
    checkpoint: str, files_per_batch: int | None = None, width: int = RUNS_A_LEVEL, keys_a_file: int = KEYS_A_FILE,
) -> StreamingQuery:
    """Load what has landed, once per natural key, whenever it landed."""
    return (
        read_landing(spark, in_dir, schema, files_per_batch)
        .writeStream.foreachBatch(insert_if_absent(table, keys, order, width, keys_a_file))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_backfill(
    spark: SparkSession, chunks_dir: str, schema: str, table: str, provider: Provider | None,
    checkpoint: str, dim: int = EMBEDDING_DIMENSIONS, batch: int = MAX_BATCH,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Embed chunks as they land, in bounded batches that a restart goes on from."""
    require_provider(provider)

    held = StoredKeys(spark, f"{table}.keys", ["chunk_id"], "chunk_id long")

    def write(landed: DataFrame, batch_id: int) -> None:
        held.merge(before=batch_id)
        pending = pending_chunks(landed, held.stored(landed, without=batch_id))
        path = f"{table}/batch_id={batch_id}"
        embed(pending, provider, dim, batch).write.mode("overwrite").parquet(path)
        held.add(spark.read.schema(EMBEDDINGS).parquet(path), batch_id)

    return (
        read_landing(spark, chunks_dir, schema, files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_state(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep each job's furthest state; only jobs that moved are written per batch.

    State is one row per job.  A reader takes the newest batch of each job.
    """
    def write(moved: DataFrame, batch_id: int) -> None:
        moved.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        load_state(events).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_state(spark: SparkSession, table: str) -> DataFrame:
    """``job_id, state, at`` as of the newest batch of each job."""
    rows = spark.read.parquet(table)
    return rows.groupBy("job_id").agg(
        F.max_by(F.struct("state", "at"), "batch_id").alias("s")
    ).select("job_id", "s.state", "s.at")


def furthest_moves(events: DataFrame, keep: str, delay: str) -> DataFrame:
    """The moves of each job in a stream of ``job_id, event_id, state, at``, from a state that ends.

    A job whose events have been silent for ``keep`` of event time leaves the state.  Moves
    back and repeats are refused while it is held; one that comes after it left may be a row again, and
    ``reached_state`` refuses it there.  Events more than ``delay`` behind the newest, events without
    a time and unknown states are dropped.
    """
    kept = pd.Timedelta(keep) // pd.Timedelta("1ms")
    job = events.schema["job_id"].dataType.simpleString()

    def move(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        best = held and (-held[0], *held[1:4])
        newest = held[4] if held else 0
        for frame in frames:
            # Plain arrays: there is a small frame for each job, and sorting one as a frame costs more than all else.
            down, us, ids = (frame[name].to_numpy() for name in ("down", "us", "event_id"))
            newest = max(newest, int(us.max()))
            first = np.lexsort((ids, us, down))[0] if len(us) > 1 else 0
            found = (int(down[first]), int(us[first]), int(ids[first]), frame["state"].iat[first])
            best = found if best is None or found[:3] < best[:3] else best
        state.update((-best[0], *best[1:], newest))
        state.setTimeoutTimestamp(max(newest // 1000 + kept, state.getCurrentWatermarkMs() + 1))
        if held is None or best[:3] != (-held[0], *held[1:3]):
            yield pd.DataFrame({"job_id": [key[0]], "event_id": [best[2]], "state": [best[3]], "us": [best[1]]})

    level = F.coalesce(*[F.when(F.col("state") == s, F.lit(-n)) for s, n in STATE_LEVEL.items()])
    known = events.where(F.col("state").isin(list(STATE_LEVEL)) & F.col("at").isNotNull()).select(
        "job_id", "event_id", "state", F.col("at").cast("timestamp").alias("at"), level.alias("down"))
    moves = known.withWatermark("at", delay).withColumn("us", F.unix_micros("at")).groupBy("job_id").applyInPandasWithState(
        move, f"job_id {job}, event_id long, state string, us long",
        "level int, us long, event_id long, state string, newest long", "update", GroupStateTimeout.EventTimeTimeout)
    return moves.select("job_id", "event_id", "state", F.timestamp_micros("us").alias("at"))


def stream_moves(events: DataFrame, table: str, checkpoint: str, keep: str = "7 days", delay: str = "1 day") -> StreamingQuery:
    """Write the moves of each batch; the state holds the jobs that are not done with, not every job there ever was."""
    def write(moved: DataFrame, batch_id: int) -> None:
        moved.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        furthest_moves(events, keep, delay).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def reached_state(spark: SparkSession, table: str) -> DataFrame:
    """``job_id, state, at`` by the moves written so far; a row that would move a job back changes nothing."""
    return load_state(spark.read.parquet(table))


Stage = Callable[[DataFrame, int], None]
LEDGER = "batch_id long, stage string, outcome string, problem string, tried long"
DONE, FAILED = "done", "failed"


class Ledger:
    """The outcome of every enrichment of every batch, one small file for each try."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def tries(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, LEDGER)

    def outcomes(self) -> DataFrame:
        """``batch_id, stage, outcome, problem, tries``: how each enrichment of a batch stands."""
        return self.tries().groupBy("batch_id", "stage").agg(
            F.max_by(F.struct("outcome", "problem"), "tried").alias("last"), F.count(F.lit(1)).alias("tries")
        ).select("batch_id", "stage", "last.*", "tries")

    def due(self) -> list[tuple[int, str]]:
        """What failed and was not done since, in order of batches."""
        failed = self.outcomes().where(F.col("outcome") == FAILED)
        return [(r["batch_id"], r["stage"]) for r in failed.orderBy("batch_id", "stage").collect()]

    def enter(self, batch_id: int, stage: str, problem: str | None) -> None:
        tried = self.tries().where((F.col("batch_id") == batch_id) & (F.col("stage") == stage)).count()
        row = (batch_id, stage, DONE if problem is None else FAILED, problem, tried)
        self.spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(self.path)


def enrich_batch(
    load: Stage, *enrichments: Stage, on_failure: Callable[[str], None] = print,
    ledger: Ledger | None = None, reload: Callable[[int], DataFrame] | None = None,
) -> Stage:
    """A batch writer that loads, then enriches; a failed enrichment never fails the load.

    Each stage writes its own table under the batch id.  With a ``ledger`` every outcome is
    entered, and the next batch first runs what failed before, alone, over the rows that
    ``reload`` gives for its batch; what was done is not run again.
    """
    def attempt(stage: Stage, batch: DataFrame, batch_id: int) -> None:
        problem = None
        try:
            stage(batch, batch_id)
        except Exception as failure:  # noqa: BLE001 - recorded, the load stands
            problem = str(failure)[:500] or type(failure).__name__
            on_failure(f"batch {batch_id}: {stage.__name__}: {failure}")
        if ledger is not None:
            ledger.enter(batch_id, stage.__name__, problem)

    def write(batch: DataFrame, batch_id: int) -> None:
        load(batch, batch_id)
        if ledger is not None and reload is not None:
            retry_failed(ledger, enrichments, reload, attempt, before=batch_id)
        for stage in enrichments:
            attempt(stage, batch, batch_id)

    return write


def retry_failed(
    ledger: Ledger, enrichments: tuple[Stage, ...], reload: Callable[[int], DataFrame],
    attempt: Callable[[Stage, DataFrame, int], None], before: int | None = None,
) -> None:
    """Run the failed enrichments of earlier batches once more."""
    by_name = {stage.__name__: stage for stage in enrichments}
    for batch_id, name in ledger.due():
        if name in by_name and (before is None or batch_id < before):
            attempt(by_name[name], reload(batch_id), batch_id)


def stream_enriched(
    spark: SparkSession, in_dir: str, schema: str, table: str, keys: list[str], order: str, checkpoint: str,
    ledger: str, *enrichments: Stage, files_per_batch: int | None = None, on_failure: Callable[[str], None] = print,
) -> StreamingQuery:
    """``stream_landing`` with enrichments of each batch's new rows, and a ledger of how they went."""
    def reload(batch_id: int) -> DataFrame:
        return read_or_empty(spark, table, schema + ", batch_id long").where(F.col("batch_id") == batch_id).drop("batch_id")

    def over_new_rows(stage: Stage) -> Stage:
        def run(_: DataFrame, batch_id: int) -> None:
            stage(reload(batch_id), batch_id)

        run.__name__ = stage.__name__
        return run

    write = enrich_batch(insert_if_absent(table, keys, order), *map(over_new_rows, enrichments),
                         on_failure=on_failure, ledger=Ledger(spark, ledger), reload=reload)
    return (
        read_landing(spark, in_dir, schema, files_per_batch).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
