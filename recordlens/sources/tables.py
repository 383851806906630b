"""Stored tables: insert-if-absent, all-or-nothing publishing, and append-only logs.

A load writes each table under ``<root>/<table>/load_id=<id>`` and then one row
under ``<root>/_commits``.  Readers keep the loads that have such a row, so a
load is seen whole or not at all, and writing a load again replaces itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCUMENT_KEY = ["vehicle_id", "kind", "external_id"]


def stable_id(*columns: str) -> Column:
    """A row id that depends on the natural key alone."""
    return F.xxhash64(*[F.col(c) for c in columns])


def colliding_ids(df: DataFrame, id_column: str) -> DataFrame:
    """The ids that more than one row carries; empty when there is no collision."""
    return df.groupBy(id_column).count().where("count > 1")


class IdsCollide(Exception):
    """Two natural keys have one id, so neither may be stored under it."""


def require_own_ids(new: DataFrame, stored: DataFrame, id_column: str) -> None:
    """Refuse new rows that share an id with each other or with a stored row.

    ``stored`` holds no key of ``new``, so an id on both sides is a collision; only new ids are shuffled.
    """
    ids = new.select(id_column)
    shared = colliding_ids(ids, id_column).select(id_column).unionByName(
        stored.select(id_column).join(ids, id_column, "left_semi"))
    found = [r[0] for r in shared.limit(5).collect()]
    if found:
        raise IdsCollide(f"Ids of more than one record: {sorted(found)}")


def not_stored(planned: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows whose key is not stored yet."""
    return planned.join(existing.select(*keys), keys, "left_anti")


def append_new(
    existing: DataFrame, planned: DataFrame, keys: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split planned rows into new and unchanged; stored rows are never rewritten."""
    keys = keys or DOCUMENT_KEY
    known = existing.select(*keys)
    return planned.join(known, keys, "left_anti"), planned.join(known, keys, "left_semi")


def explode_passages(new: DataFrame) -> DataFrame:
    """Chunk rows of newly stored documents."""
    return new.select("document_id", F.explode("passages").alias("p")).select(
        F.xxhash64("document_id", "p.ordinal").alias("chunk_id"),
        "document_id", "p.ordinal", "p.text",
    )


def new_links(new: DataFrame, links: DataFrame) -> DataFrame:
    """Planned links of the investigations that are newly stored."""
    stored = new.where(F.col("kind") == "investigation").select(
        "vehicle_id", "external_id", F.col("document_id").alias("investigation_document_id")
    )
    return links.join(stored, ["vehicle_id", "external_id"]).select(
        "investigation_document_id", "vehicle_id", "campaign_number", "component",
        "opened_on", "closed_on",
    )


def upsert_registry(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (make, model, year): stored rows win, but gain a missing VIN."""
    keys = ["make", "model", "model_year"]
    old = existing.select(*keys, F.struct(*existing.columns).alias("old"))
    new = incoming.select(*keys, F.struct(*existing.columns).alias("new"))
    kept = F.coalesce("old", "new")
    return old.join(new, keys, "full_outer").select(*[
        F.coalesce("old.vin", "new.vin").alias("vin") if c == "vin" else kept[c].alias(c)
        for c in existing.columns
    ])


def lookup_documents(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored documents of the given ids, bodies verbatim."""
    return documents.join(ids.select("document_id"), "document_id", "left_semi")


def load_report(
    fetched: DataFrame, planned: DataFrame, new: DataFrame, links: DataFrame
) -> DataFrame:
    """Counts of one load per vehicle.

    ``fetched`` is ``vehicle_id, kind, is_empty``; ``planned`` and ``new`` are
    plan rows, new ones with their ``passages`` or the number of them, ``n_passages``;
    ``links`` are the link rows created.
    """
    passages = F.col("n_passages") if "n_passages" in new.columns else F.size("passages")
    of = lambda kind: F.col("kind") == kind
    seen = fetched.groupBy("vehicle_id").agg(
        F.count_if(of("complaint")).alias("complaints_fetched"),
        F.count_if(of("complaint") & F.col("is_empty")).alias("complaints_skipped_empty"),
        F.count_if(of("recall")).alias("recalls_fetched"),
        F.count_if(of("investigation")).alias("investigation_rows"),
    )
    kept = planned.groupBy("vehicle_id").agg(
        F.count_if(of("complaint")).alias("complaints_planned"),
        F.count_if(of("recall")).alias("recalls_planned"),
    )
    stored = new.groupBy("vehicle_id").agg(
        F.count_if(of("complaint")).alias("complaints_new"),
        F.count_if(of("recall")).alias("recalls_new"),
        F.count_if(of("investigation")).alias("investigations_new"),
        F.sum(passages).alias("chunks_created"),
    )
    linked = links.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("links_created"))
    joined = seen
    for counts in (kept, stored, linked):
        joined = joined.join(counts, "vehicle_id", "left")
    joined = joined.na.fill(0)
    return joined.select(
        "vehicle_id", "complaints_fetched", "complaints_skipped_empty", "complaints_new",
        (F.col("complaints_planned") - F.col("complaints_new")).alias("complaints_unchanged"),
        "recalls_fetched", "recalls_new",
        (F.col("recalls_planned") - F.col("recalls_new")).alias("recalls_unchanged"),
        "investigation_rows", "investigations_new", "links_created", "chunks_created",
    )


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of that schema where none was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_part(table: DataFrame, root: str, name: str, load_id: str) -> DataFrame:
    """Write one table of a load, unseen until the load is committed, and read it back."""
    path = f"{root}/{name}/load_id={load_id}"
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def commit_load(spark: SparkSession, root: str, load_id: str) -> None:
    """Write the one row that makes a load visible."""
    commit = spark.createDataFrame([(load_id,)], "load_id string")
    commit.coalesce(1).write.mode("overwrite").json(f"{root}/_commits/load_id={load_id}")


def write_load(tables: dict[str, DataFrame], root: str, load_id: str) -> None:
    """Write every table of a load, then the one row that makes it visible."""
    for name, table in tables.items():
        write_part(table, root, name, load_id)
    commit_load(next(iter(tables.values())).sparkSession, root, load_id)


def read_table(
    spark: SparkSession, root: str, name: str, schema: str, without: str | None = None
) -> DataFrame:
    """The rows of the committed loads of a table, one load left out when named."""
    partitioned = schema + ", load_id string"
    rows = read_or_empty(spark, f"{root}/{name}", partitioned)
    try:
        commits = spark.read.schema("load_id string").json(f"{root}/_commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows.limit(0).drop("load_id")
    if without is not None:
        rows = rows.where(F.col("load_id") != without)
    return rows.join(commits.select("load_id").distinct(), "load_id", "left_semi").drop("load_id")


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to an append-only Parquet log (answers, evaluation runs, jobs)."""
    rows.write.mode("append").parquet(path)
