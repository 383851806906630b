"""Work out which version of a model each complaint is about, from its VIN."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.identity import fit, fit_is_known
from ..operators.catalog import describable
from ..schemas import FIT_COLUMNS, VIN_DECODES
from ..session import cut_lineage
from ..sources.tables import read_or_empty

# A picklable function from (descriptor, model year) pairs to (trim, litres,
# cylinders) triples, in order; unknown parts are None.
Decoder = Callable[[list[tuple[str, int]]], list[tuple[str | None, float | None, int | None]]]

KEY = ["descriptor", "model_year"]


def described(documents: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Complaints with their ``descriptor`` and their vehicle's ``model_year``."""
    return describable(documents).withColumnRenamed("vin_descriptor", "descriptor").join(
        vehicles.select("vehicle_id", "model_year"), "vehicle_id"
    )


def descriptor_worklist(records: DataFrame, decodes: DataFrame) -> DataFrame:
    """Distinct (descriptor, year) nobody has asked about yet; empty answers count as asked."""
    return records.where(F.col("descriptor").isNotNull()).select(*KEY).distinct().join(
        decodes.select(*KEY), KEY, "left_anti"
    )


def resolve_decodes(records: DataFrame, decodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with the fit of their descriptor, and the descriptors still to ask."""
    kept = [c for c in records.columns if c not in FIT_COLUMNS]
    # Records without a descriptor match nothing; spread, so that they are not one key.
    apart = F.pmod(F.xxhash64("document_id"), F.lit(4096)) if "document_id" in kept else F.lit(0)
    fits = decodes.select(*KEY, *FIT_COLUMNS, F.lit(0).cast("long").alias("_apart"))
    resolved = records.select(*kept, F.when(F.col("descriptor").isNull(), apart).otherwise(0).cast("long").alias("_apart")).join(
        fits, [*KEY, "_apart"], "left").drop("_apart")
    return resolved, descriptor_worklist(records, decodes)


def decode_worklist(worklist: DataFrame, decoder: Decoder, batch: int = 50) -> DataFrame:
    """``descriptor, model_year`` and the fit a provider answers, empty answers included."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at:at + batch]
                asked = list(zip(part["descriptor"], part["model_year"].astype(int)))
                fits = decoder(asked)
                if len(fits) != len(asked):
                    raise ValueError(f"Asked for {len(asked)} decodes and received {len(fits)}.")
                yield pd.DataFrame({
                    "descriptor": part["descriptor"].to_numpy(), "model_year": part["model_year"].to_numpy(),
                    "t": [f[0] for f in fits],
                    "l": [None if f[1] is None else str(f[1]) for f in fits],
                    "c": [None if f[2] is None else str(f[2]) for f in fits],
                })

    answered = worklist.select(*KEY).mapInPandas(
        run, "descriptor string, model_year int, t string, l string, c string"
    )
    made = fit(F.col("t"), F.col("l").try_cast("decimal(4,1)"), F.col("c").try_cast("int"))
    return answered.select(*KEY, made.alias("f")).select(*KEY, "f.*")


def read_decodes(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """One answer for each descriptor and year, though runs that overlapped may both have asked; the first run's stands."""
    answers = read_or_empty(spark, path, f"{VIN_DECODES}, run_id string")
    if without is not None:
        answers = answers.where(~F.col("run_id").eqNullSafe(F.lit(without)))
    order = F.struct(F.coalesce("run_id", F.lit("")), *[F.col(c) for c in FIT_COLUMNS])
    return answers.groupBy(*KEY).agg(F.min_by(F.struct(*FIT_COLUMNS), order).alias("first")).select(*KEY, "first.*")


def decode_records(
    documents: DataFrame, vehicles: DataFrame, path: str, decoder: Decoder, run_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ask about every descriptor nobody has asked about yet, remember the answers, fit the records.

    Answers go to a folder of the run under ``path``; asking once per descriptor and
    year is what keeps the calls few.  A run with the ``run_id`` of an earlier one writes
    over it, and does not see it.  Returns the documents with their fits and the report.
    """
    spark = documents.sparkSession
    records = cut_lineage(described(documents, vehicles).select("document_id", *KEY))
    work = descriptor_worklist(records, read_decodes(spark, path, without=run_id))
    # Not read from the folder that is being written: a run that is repeated replaces its own answers.
    decode_worklist(work, decoder).write.mode("overwrite").parquet(f"{path}/run_id={run_id or uuid.uuid4().hex}")
    decodes = read_decodes(spark, path)
    report = decode_report(records, vehicles.withColumn("was_decoded", F.lit(False)))
    return with_fit(documents, vehicles, decodes), report


def with_fit(documents: DataFrame, vehicles: DataFrame, decodes: DataFrame) -> DataFrame:
    """All documents, complaints with the fit their VIN decodes to.

    The fit is derived by join and not stored, so a corrected decode reaches
    every record it concerns.
    """
    plain = [c for c in documents.columns if c not in (*FIT_COLUMNS, "descriptor", "model_year")]
    fitted, _ = resolve_decodes(described(documents.select(*plain), vehicles), decodes)
    others = documents.where(F.col("kind") != "complaint").select(*plain)
    return fitted.select(*plain, *FIT_COLUMNS).unionByName(others, allowMissingColumns=True)


def decode_vehicles(vehicles: DataFrame, own: DataFrame) -> DataFrame:
    """Vehicles with the fit of their own whole VIN where they had none.

    ``own`` is ``vehicle_id`` and the fit columns.
    """
    known = fit_is_known(*[F.col(f"v.{c}") for c in ("trim", "engine_litres", "engine_cylinders")])
    take = F.col("v.vin").isNotNull() & ~known
    rest = [c for c in vehicles.columns if c not in FIT_COLUMNS]
    return vehicles.alias("v").join(own.alias("o"), "vehicle_id", "left").select(
        *[F.col("vehicle_id") if c == "vehicle_id" else F.col(f"v.{c}") for c in rest],
        *[F.when(take, F.col(f"o.{c}")).otherwise(F.col(f"v.{c}")).alias(c) for c in FIT_COLUMNS],
        (take & F.col("o.vehicle_id").isNotNull()).alias("was_decoded"),
    )


def decode_report(records: DataFrame, vehicles: DataFrame) -> DataFrame:
    """One row: vehicles, own VINs decoded, complaints described, complaints without a VIN.

    ``records`` come from ``described``; ``vehicles`` from ``decode_vehicles``.
    """
    counted = records.agg(
        F.count_if(F.col("descriptor").isNotNull()).alias("complaints_described"),
        F.count_if(F.col("descriptor").isNull()).alias("complaints_without_vin"),
    ).withColumn("one", F.lit(1))
    owned = vehicles.agg(
        F.count(F.lit(1)).alias("vehicles"), F.count_if("was_decoded").alias("own_vins_decoded")
    ).withColumn("one", F.lit(1))
    return owned.join(counted, "one").drop("one")
