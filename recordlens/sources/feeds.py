"""Scans of the JSON feeds, landed as one envelope per file.

The path and the position inside the envelope are kept: together they are the
feed order, which first-wins rules need.  ``raw`` is one element as it is written.
A response is one string and is read once, in one task; a body that cannot be read is
a row of ``rejected_envelopes``, and the load does not start with one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import is_ambiguous_date, slash_date
from ..functions.identity import fit
from ..functions.jsonfields import array_elements, find_field, object_fields, read_outcome, read_results, read_text, result_elements
from ..functions.text import is_blank, non_blank, trim_ws

NOT_JSON = "not JSON"
NO_RESULTS = "no results array"


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed response: ``path, body``."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")
    )


def record_fields(envelopes: DataFrame) -> DataFrame:
    """One row per element of ``results``: ``feed_order, raw, fields`` and what came along."""
    carried = [c for c in envelopes.columns if c not in ("path", "body")]
    return result_elements(envelopes.select("path", *carried, "body")).select(
        *carried, F.struct("path", F.col("pos").cast("long").alias("seq")).alias("feed_order"), "raw", "fields"
    )


def rejected_envelopes(envelopes: DataFrame) -> DataFrame:
    """``path, reason`` of the responses that give no rows because they cannot be read."""
    read = envelopes.select("path", read_outcome("body").alias("read"))
    reason = F.when(~F.col("read.is_json"), NOT_JSON).when(~F.col("read.found"), NO_RESULTS)
    return read.select("path", reason.alias("reason")).where(F.col("reason").isNotNull())


def _fields(envelopes: DataFrame, columns: dict) -> DataFrame:
    records = record_fields(envelopes)
    carried = [c for c in records.columns if c not in ("feed_order", "raw", "fields")]
    return records.select(*carried, "feed_order", *[c.alias(n) for n, c in columns.items()], "raw")


def complaints_from(envelopes: DataFrame) -> DataFrame:
    f = F.col("fields")
    return _fields(envelopes, {
        "odi_number": read_text(f, "odiNumber"),
        "components": read_text(f, "components"),
        "summary": read_text(f, "summary"),
        "filed_text": read_text(f, "dateComplaintFiled"),
        "filed_on": slash_date(read_text(f, "dateComplaintFiled")),
        "vin": read_text(f, "vin"),
    })


def recalls_from(envelopes: DataFrame) -> DataFrame:
    f = F.col("fields")
    return _fields(envelopes, {
        "campaign_number": read_text(f, "NHTSACampaignNumber"),
        "component": read_text(f, "Component"),
        "summary": read_text(f, "Summary"),
        "consequence": read_text(f, "Consequence"),
        "remedy": read_text(f, "Remedy"),
        "received_text": read_text(f, "ReportReceivedDate"),
        "received_on": slash_date(read_text(f, "ReportReceivedDate")),
    })


def read_complaints(spark: SparkSession, path: str) -> DataFrame:
    return complaints_from(read_envelopes(spark, path))


def read_recalls(spark: SparkSession, path: str) -> DataFrame:
    return recalls_from(read_envelopes(spark, path))


def classify_envelopes(responses: DataFrame) -> DataFrame:
    """Outcome of each response: ``rows``, ``empty`` or ``failed``.

    A failed response counts as empty only when it is a JSON object whose
    ``results`` is an array of length zero; anything else is a failed load.
    """
    read = F.col("_read")
    count = read["count"]
    ok = F.col("status").between(200, 299)
    return responses.withColumn("_read", read_outcome("body")).withColumn(
        "outcome",
        F.when(read["found"] & (count == 0), "empty")
        .when(ok & read["found"], "rows")
        .when(ok & read["is_json"], "empty")
        .otherwise("failed"),
    ).drop("_read")


def ambiguous_dates(feed: DataFrame, column: str) -> DataFrame:
    """The feed rows whose date reads differently day first and month first."""
    return feed.where(is_ambiguous_date(F.col(column)))


def read_model_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct model names per make and year, first spelling kept."""
    f = F.col("fields")
    names = record_fields(read_envelopes(spark, path)).select(
        "feed_order",
        F.upper(trim_ws(read_text(f, "make"))).alias("make"),
        read_text(f, "modelYear").try_cast("int").alias("model_year"),
        non_blank(read_text(f, "model")).alias("model"),
    )
    return distinct_model_names(names)


def distinct_model_names(names: DataFrame) -> DataFrame:
    """``make, model_year, model`` without repeats in any case; needs ``feed_order``."""
    return (
        names.where(~is_blank(F.col("model")))
        .groupBy("make", "model_year", F.upper(trim_ws(F.col("model"))).alias("model_key"))
        .agg(F.min_by(trim_ws(F.col("model")), "feed_order").alias("model"))
        .select("make", "model_year", "model")
    )


def vin_decodes_from(envelopes: DataFrame) -> DataFrame:
    """The fit of the first result of each response; no result is an unknown fit.

    ``envelopes`` carries the ``descriptor`` and ``model_year`` each response answers.
    """
    first = F.get(F.col("read.elements"), F.lit(0))["fields"]
    f = F.col("fields")
    litres = F.regexp_replace(read_text(f, "DisplacementL"), ",", "").try_cast("decimal(4,1)")
    decoded = fit(read_text(f, "Trim"), litres, read_text(f, "EngineCylinders").try_cast("int"))
    return (
        envelopes.withColumn("read", read_results("body")).withColumn("fields", first)
        .select("descriptor", "model_year", decoded.alias("fit"))
        .select("descriptor", "model_year", "fit.*")
    )


def read_vin_decodes(spark: SparkSession, path: str) -> DataFrame:
    """Decode responses landed as ``descriptor=<d>/model_year=<y>/*.json``."""
    bodies = read_envelopes(spark, path)
    return vin_decodes_from(bodies.select(
        F.regexp_extract("path", r"descriptor=([^/]+)", 1).alias("descriptor"),
        F.regexp_extract("path", r"model_year=(\d+)", 1).cast("int").alias("model_year"),
        "body",
    ))


def read_registry(spark: SparkSession, path: str, section: str = "Registry") -> DataFrame:
    """Vehicles of a settings file: ``{section: {"Vehicles": [...]}}``."""
    settings = read_envelopes(spark, path)
    inner = find_field(object_fields(F.col("body")), section)["text"]
    vehicles = find_field(object_fields(inner), "vehicles")["text"]
    f = F.col("fields")
    return (
        settings.select(F.explode(array_elements(vehicles)).alias("raw"))
        .select(object_fields(F.col("raw")).alias("fields"))
        .select(
            F.upper(trim_ws(read_text(f, "make"))).alias("make"),
            F.upper(trim_ws(F.coalesce(
                F.nullif(read_text(f, "nhtsaModel"), F.lit("")), read_text(f, "model")
            ))).alias("model"),
            F.upper(non_blank(read_text(f, "recallModel"))).alias("recall_model"),
            read_text(f, "modelYear").try_cast("int").alias("model_year"),
            trim_ws(read_text(f, "displayName")).alias("display_name"),
            F.upper(non_blank(read_text(f, "vin"))).alias("vin"),
        )
    )


def find_by_display_name(vehicles: DataFrame, name: str) -> DataFrame:
    """Vehicles of that display name, ignoring case and padding."""
    return vehicles.where(F.lower(trim_ws(F.col("display_name"))) == name.strip().lower())
