"""Load the records of every registered vehicle in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import is_blank
from ..operators.names import split_known
from ..operators.planning import (
    investigation_lines, investigation_links, keyed_complaints, keyed_recalls, keyed_rows, match_family, passages_of,
    plan_complaints, plan_investigations, plan_recalls,
)
from ..schemas import CHUNKS, DOCUMENTS, LINKS
from ..session import cut_lineage, steady_unions
from ..sources.tables import (
    DOCUMENT_KEY, commit_load, explode_passages, load_report, new_links, not_stored, read_table, require_own_ids, write_part,
)

DOCUMENT_COLUMNS = [
    "document_id", "vehicle_id", "kind", "external_id", "component", "filed_on", "title", "body",
    "raw_payload",
]


class FeedFailed(Exception):
    """A feed did not load, so nothing of the load is stored."""


def for_vehicles(feed: DataFrame, vehicles: DataFrame, model: str = "model") -> DataFrame:
    """Feed rows of a request (``make, model, model_year``) with the vehicle that asked.

    Recalls may be filed under another model name, which ``model`` picks.
    """
    asked = F.coalesce(F.col(model), F.col("model")) if model != "model" else F.col("model")
    wanted = vehicles.select("vehicle_id", "make", asked.alias("model"), "model_year")
    return feed.join(wanted, ["make", "model", "model_year"]).drop("make", "model", "model_year")


def known_vehicles(vehicles: DataFrame, model_names: DataFrame | None) -> DataFrame:
    """Vehicles whose model the feed lists; all of them when no list is given."""
    return vehicles if model_names is None else split_known(vehicles, model_names)[0]


def plan_records(
    complaints: DataFrame, recalls: DataFrame, investigations: DataFrame
) -> DataFrame:
    """Planned documents of all three kinds, with their ids."""
    planned = plan_complaints(complaints).unionByName(plan_recalls(recalls)).unionByName(
        plan_investigations(investigations)
    )
    return planned.withColumn("document_id", F.xxhash64("vehicle_id", "kind", "external_id"))


def fetched_rows(complaints: DataFrame, recalls: DataFrame, investigations: DataFrame) -> DataFrame:
    """``vehicle_id, kind, external_id, is_empty`` of every keyed row that came in; a row that is not stored has no id."""
    row = lambda df, kind, empty: df.select(
        "vehicle_id", F.lit(kind).alias("kind"), "external_id", empty.alias("is_empty")
    )
    return (
        row(complaints, "complaint", is_blank(F.col("summary")))
        .unionByName(row(recalls, "recall", F.lit(False)))
        .unionByName(row(investigations, "investigation", F.lit(False)))
    )


def require_loaded(outcomes: DataFrame) -> None:
    """Refuse the load when any response failed (``path, outcome``)."""
    failed = outcomes.where(F.col("outcome") == "failed").select("path").limit(5).collect()
    if failed:
        raise FeedFailed("Feeds that did not load: " + ", ".join(r["path"] for r in failed))


def load_records(
    spark: SparkSession, root: str, load_id: str, vehicles: DataFrame,
    complaints: DataFrame, recalls: DataFrame, rows: DataFrame,
    outcomes: DataFrame, model_names: DataFrame | None = None,
) -> DataFrame:
    """Store what is new under ``root`` and report the counts per vehicle.

    ``complaints`` and ``recalls`` carry the ``vehicle_id`` they were fetched
    for; ``rows`` are flat-file rows of every vehicle; ``outcomes`` says of each
    response whether it was read (``classify_envelopes``), and one that was not stops the load.  All of it is planned
    before anything is written, and the write becomes visible as a whole.
    """
    steady_unions(spark)
    require_loaded(outcomes)
    known = known_vehicles(vehicles, model_names)
    ours = known.select("vehicle_id")
    complaints = complaints.join(ours, "vehicle_id", "left_semi")
    recalls = recalls.join(ours, "vehicle_id", "left_semi")
    # A small part of the file, read by five branches from here on.
    matched = cut_lineage(match_family(rows, known))

    # A load that is run again must not see itself.
    stored = read_table(spark, root, "documents", DOCUMENTS, without=load_id)
    keyed = {
        "complaint": keyed_complaints(complaints), "recall": keyed_recalls(recalls), "investigation": keyed_rows(matched),
    }
    fresh = [unstored(feed, stored, kind) for kind, feed in keyed.items()]
    # Bodies are written here, once; all that follows reads what was written.
    new = write_part(plan_records(*fresh).select(*DOCUMENT_COLUMNS), root, "documents", load_id)
    require_own_ids(new, stored, "document_id")
    chunks = write_part(
        explode_passages(new.withColumn("passages", passages_of(F.col("kind"), F.col("body")))), root, "chunks", load_id)
    links = write_part(new_links(new, investigation_links(matched)), root, "links", load_id)
    lines = investigation_lines(matched).join(
        new.where(F.col("kind") == "investigation").select("document_id", "vehicle_id", "external_id"),
        ["vehicle_id", "external_id"],
    ).select("document_id", "feed_order", "raw_line")
    write_part(lines, root, "investigation_lines", load_id)
    commit_load(spark, root, load_id)

    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_passages"))
    made = new.select("document_id", "vehicle_id", "kind").join(counts, "document_id", "left")
    fetched = cut_lineage(fetched_rows(*keyed.values()))
    planned = fetched.where(F.col("external_id").isNotNull()).select(*DOCUMENT_KEY).distinct()
    return load_report(fetched, planned, made, links)


def unstored(keyed: DataFrame, stored: DataFrame, kind: str) -> DataFrame:
    """Feed rows of one kind that may be stored and are not; the text of a stored record goes no further."""
    known = stored.where(F.col("kind") == kind)
    return not_stored(keyed.where(F.col("external_id").isNotNull()), known, ["vehicle_id", "external_id"]).drop("external_id")


def stored_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The committed documents, chunks and links."""
    return {
        "documents": read_table(spark, root, "documents", DOCUMENTS),
        "chunks": read_table(spark, root, "chunks", CHUNKS),
        "links": read_table(spark, root, "links", LINKS),
    }
