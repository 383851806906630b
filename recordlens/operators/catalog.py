"""Reports over the stored tables: record counts, loads, evaluation runs, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import is_stale
from ..functions.identity import fit_is_known, fit_label, vin_descriptor
from ..schemas import KINDS

HISTORY_LIMIT = 20
FINISHED = ["succeeded", "failed"]
# How far each state is along a load.
STATE_LEVEL = {"queued": 1, "running": 2, "succeeded": 3, "failed": 3}


def vehicle_counts(vehicles: DataFrame, documents: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Every vehicle with its records per kind, zero where it has none."""
    kinds = kinds or KINDS
    counts = documents.groupBy("vehicle_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    )
    return vehicles.join(counts, "vehicle_id", "left").na.fill(0, kinds)


def vehicle_list(vehicles: DataFrame, documents: DataFrame) -> DataFrame:
    """The vehicle picker: counts and fit label, by year then model."""
    fit = [F.col(c) for c in ("trim", "engine_litres", "engine_cylinders")]
    return (
        vehicle_counts(vehicles, documents)
        .select(
            "vehicle_id", "display_name", "make", "model", "model_year", *KINDS,
            F.when(fit_is_known(*fit), fit_label(*fit)).alias("trim"),
        )
        .orderBy("model_year", "model", "vehicle_id")
    )


def is_finished(state: Column) -> Column:
    return state.isin(FINISHED)


def dismiss(jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop finished jobs of the given ids: the kept jobs, and an outcome per id."""
    asked = ids.select("job_id").distinct()
    outcome = asked.join(jobs.select("job_id", "state"), "job_id", "left").select(
        "job_id",
        F.when(F.col("state").isNull(), "not_found")
        .when(is_finished(F.col("state")), "dismissed")
        .otherwise("still_running").alias("outcome"),
    )
    gone = outcome.where(F.col("outcome") == "dismissed")
    return jobs.join(gone, "job_id", "left_anti"), outcome


def latest_load(jobs: DataFrame, key: str = "display_name") -> DataFrame:
    """The newest job of each vehicle, by queue time then id."""
    newest = F.max_by(F.struct(*jobs.columns), F.struct("queued_at", "job_id"))
    return jobs.groupBy(F.col(key).alias("_key")).agg(newest.alias("job")).select("job.*")


def last_success(jobs: DataFrame) -> DataFrame:
    """``vehicle_id, last_success`` over the loads that succeeded."""
    return jobs.where(F.col("state") == "succeeded").groupBy("vehicle_id").agg(
        F.max("finished_at").alias("last_success")
    )


def stale_scopes(
    vehicles: DataFrame, jobs: DataFrame, now: Column, interval_hours: int = 24
) -> DataFrame:
    """``vehicle_id, last_success`` of vehicles due for a load and without one under way."""
    busy = jobs.where(~is_finished(F.col("state"))).select("display_name")
    return (
        vehicles.join(busy, "display_name", "left_anti")
        .join(last_success(jobs), "vehicle_id", "left")
        .where(is_stale(F.col("last_success"), now, interval_hours))
        .select("vehicle_id", "last_success")
    )


def newest(df: DataFrame, time: str, key: str, n: int = HISTORY_LIMIT) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def recent_loads(jobs: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    """The newest ``n`` loads, finished ones marked."""
    return newest(jobs, "queued_at", "job_id", n).withColumn(
        "is_finished", is_finished(F.col("state"))
    )


def recent_runs(runs: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    """The newest ``n`` evaluation runs."""
    return newest(runs, "ran_at", "run_id", n)


def latest_and_history(runs: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    """The newest ``n`` runs, the first of them marked as the latest."""
    window = Window.orderBy(F.desc("ran_at"), F.desc("run_id"))
    return recent_runs(runs, n).withColumn("is_latest", F.row_number().over(window) == 1)


def read_metrics(runs: DataFrame) -> DataFrame:
    """Runs with their metrics as a variant; text that is not JSON reads as ``{}``."""
    return runs.withColumn(
        "metrics", F.coalesce(F.try_parse_json("metrics"), F.parse_json(F.lit("{}")))
    )


def embedding_progress(corpus: DataFrame) -> DataFrame:
    """``vehicle_id, pending, embedded`` chunks."""
    return corpus.groupBy("vehicle_id").agg(
        F.count_if(F.col("embedding").isNull()).alias("pending"),
        F.count_if(F.col("embedding").isNotNull()).alias("embedded"),
    )


def load_state(events: DataFrame) -> DataFrame:
    """The state each job has reached; a state never goes back.

    ``events`` is ``job_id, event_id, state, at``.  The furthest level wins, and
    within a level the first event, which is what applying events in order and
    refusing the backward ones gives.  The aggregate is the same in a stream.
    """
    level = F.coalesce(*[
        F.when(F.col("state") == s, F.lit(n)) for s, n in STATE_LEVEL.items()
    ])
    first = F.min_by(
        F.struct("state", "at"), F.struct((-level).alias("level"), F.col("at"), F.col("event_id"))
    )
    return events.where(F.col("state").isin(list(STATE_LEVEL))).groupBy("job_id").agg(
        first.alias("reached")
    ).select("job_id", F.col("reached.state").alias("state"), F.col("reached.at").alias("at"))


def describable(documents: DataFrame) -> DataFrame:
    """Complaints with the ``vin_descriptor`` their stored payload gives."""
    from ..functions.identity import payload_vin

    return documents.where(F.col("kind") == "complaint").withColumn(
        "vin_descriptor", vin_descriptor(payload_vin(F.col("raw_payload")))
    )
