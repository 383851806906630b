"""The filters a query puts on records before anything is ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import fits
from ..schemas import CAMPAIGN_KINDS

FIT_KEYS = ["trim_key", "engine_litres", "engine_cylinders"]
RECORD_COLUMNS = ["vehicle_id", "kind", "component", "filed_on", *FIT_KEYS]


def in_pool(kind: Column, scope: Column) -> Column:
    """``all`` takes every kind, ``campaigns`` the official records only."""
    return (scope == "all") | kind.isin(CAMPAIGN_KINDS)


def pool(df: DataFrame, scope: str) -> DataFrame:
    """Records of a pool; a plain ``kind in (...)`` that reaches the scan."""
    return df if scope == "all" else df.where(F.col("kind").isin(CAMPAIGN_KINDS))


def component_is(component: Column, wanted: Column) -> Column:
    return wanted.isNull() | (component == wanted)


def filed_between(filed_on: Column, start: Column, end: Column) -> Column:
    """Inclusive window; a record without a date passes only when no bound is given."""
    return (start.isNull() | (filed_on >= start)) & (end.isNull() | (filed_on <= end))


def passes(record: str, query: str, trims: bool = True) -> Column:
    """All filters of a query on a record, for rows already joined on the vehicle."""
    r = lambda name: F.col(f"{record}.{name}")
    q = lambda name: F.col(f"{query}.{name}")
    passed = (
        in_pool(r("kind"), q("scope"))
        & component_is(r("component"), q("component"))
        & filed_between(r("filed_on"), q("filed_from"), q("filed_to"))
    )
    if trims:
        own = fits({k: r(k) for k in FIT_KEYS}, {k: q(f"own_{k}") for k in FIT_KEYS})
        passed = passed & ((q("trims") == "allTrims") | own)
    return passed


def own_fit(queries: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Queries of registered vehicles with that vehicle's fit as ``own_*`` columns."""
    own = vehicles.select("vehicle_id", *[F.col(k).alias(f"own_{k}") for k in FIT_KEYS])
    return queries.join(own, "vehicle_id")


def reject_unknown_scope(queries: DataFrame, vehicles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split queries by whether their vehicle is registered."""
    known = vehicles.select("vehicle_id")
    unknown = queries.join(known, "vehicle_id", "left_anti").withColumn(
        "problem",
        F.concat(F.lit("No vehicle with id "), F.col("vehicle_id").cast("string"),
                 F.lit(" is registered.")),
    )
    return queries.join(known, "vehicle_id", "left_semi"), unknown


def within_fit(records: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Records that could be their vehicle's own version."""
    own = vehicles.select("vehicle_id", *FIT_KEYS)
    return records.alias("r").join(
        own.alias("v"),
        (F.col("r.vehicle_id") == F.col("v.vehicle_id"))
        & fits({k: F.col(f"r.{k}") for k in FIT_KEYS}, {k: F.col(f"v.{k}") for k in FIT_KEYS}),
        "left_semi",
    )


SIGNATURE = ["vehicle_id", "scope", "component", "filed_from", "filed_to"]


def _signatures(queries: DataFrame) -> DataFrame:
    """The distinct filter settings among the queries, trims left out."""
    return queries.select(*SIGNATURE, *[f"own_{k}" for k in FIT_KEYS]).distinct()


def _per_query(queries: DataFrame, per_signature: DataFrame, how: str) -> DataFrame:
    same = F.lit(True)
    for name in SIGNATURE:
        same = same & F.col(f"q.{name}").eqNullSafe(F.col(f"s.{name}"))
    return queries.alias("q").join(per_signature.alias("s"), same, how)


def count_other_trims(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query, the chunks that pass its other filters but not its vehicle's fit.

    Both sides are first reduced to what a filter can look at: chunks to counted
    combinations of record columns, queries to distinct filter settings.
    """
    combos = chunks.groupBy(*RECORD_COLUMNS).agg(F.count(F.lit(1)).alias("chunks"))
    own = fits({k: F.col(f"r.{k}") for k in FIT_KEYS}, {k: F.col(f"q.own_{k}") for k in FIT_KEYS})
    other = (
        combos.alias("r")
        .join(
            _signatures(queries).alias("q"),
            (F.col("r.vehicle_id") == F.col("q.vehicle_id")) & passes("r", "q", trims=False) & ~own,
        )
        .groupBy(*[F.col(f"q.{c}") for c in SIGNATURE]).agg(F.sum("r.chunks").alias("other_trims"))
    )
    return _per_query(queries, other, "left").select(
        "q.query_id", F.coalesce("s.other_trims", F.lit(0)).cast("long").alias("other_trims")
    )


def dense_ready(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split queries by whether any embedded chunk passes their filters.

    Queries without one are not answered with an empty result; they carry the
    reason they were skipped.
    """
    combos = corpus.where(F.col("embedding").isNotNull()).select(*RECORD_COLUMNS).distinct()
    keep = ["query_id", "vehicle_id", "trims", "scope", "component", "filed_from", "filed_to",
            *[f"own_{k}" for k in FIT_KEYS]]
    settings = queries.select(*keep[1:]).distinct()
    found = (
        settings.alias("q")
        .join(
            combos.alias("r"),
            (F.col("r.vehicle_id") == F.col("q.vehicle_id")) & passes("r", "q"),
            "left_semi",
        )
    )
    same = F.lit(True)
    for name in keep[1:]:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    ready = queries.alias("a").join(found.alias("b"), same, "left_semi")
    waiting = queries.alias("a").join(found.alias("b"), same, "left_anti")
    return ready, waiting.withColumn("problem", F.lit(NOT_EMBEDDED))


# Fixed value: the reason given when nothing in reach has a vector.
NOT_EMBEDDED = (
    "No chunk for this vehicle has an embedding yet. Run the embed command, "
    "or search with mode=sparse."
)
