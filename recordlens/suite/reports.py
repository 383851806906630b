"""Reports, evaluation and streams."""

from __future__ import annotations

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import hash_embed
from ..operators import catalog, metrics
from ..operators.blocks import pack_blocks
from ..operators.ground_truth import build_ground_truth
from ..operators.sizing import spread
from ..plans import embed, evaluate as plan
from ..session import cut_lineage, scratch_folder
from ..streaming import landing
from . import tables as t
from .records import _LINKS
from .tables import DENSE, DOCS, FUSED, PAIRS, SPARSE, VEHICLES, with_sql

QUERIES: dict = {}
ORACLE: dict = {}
NOW = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return keep


# --- catalog ---------------------------------------------------------------------


@query("scope_kind_counts", with_sql(DOCS, VEHICLES, select="""
SELECT display_name, count(*) FILTER (kind = 'complaint') AS complaint, count(*) FILTER (kind = 'recall') AS recall,
  count(*) FILTER (kind = 'investigation') AS investigation FROM vehicles JOIN docs USING (vehicle_id) GROUP BY ALL"""))
def scope_kind_counts(spark, d):
    return catalog.vehicle_counts(t.vehicles(spark, d), t.documents(spark, d)).select(
        "display_name", "complaint", "recall", "investigation"
    )


@query("vehicle_list", with_sql(DOCS, VEHICLES, select="""
SELECT v.vehicle_id, display_name, make, model, model_year, count(*) FILTER (kind = 'complaint') AS complaint,
  count(*) FILTER (kind = 'recall') AS recall, count(*) FILTER (kind = 'investigation') AS investigation,
  CASE WHEN v.trim IS NOT NULL OR v.engine_litres IS NOT NULL OR v.engine_cylinders IS NOT NULL THEN
    concat_ws(' · ', v.trim, regexp_replace(CAST(v.engine_litres AS VARCHAR), '\\.0$', '') || 'L',
      v.engine_cylinders || ' cyl') END AS trim
FROM vehicles v JOIN docs USING (vehicle_id) GROUP BY ALL"""))
def vehicle_list(spark, d):
    return catalog.vehicle_list(t.vehicles(spark, d), t.documents(spark, d))


def _jobs(spark, d) -> DataFrame:
    """Events as loads: users are vehicles, large signups still wait."""
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "succeeded").when(
        (kind == "signup") & (F.col("value") > 200), "queued"
    ).otherwise("failed")
    return t.table(spark, d, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("vehicle_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("display_name"),
        F.when(kind == "view", "scheduled").otherwise("manual").alias("trigger"),
        state.alias("state"), F.col("ts").alias("queued_at"),
        F.when(state != "queued", F.col("ts")).alias("finished_at"),
    )


_JOBS = """jobs AS (SELECT event_id AS job_id, user_id AS vehicle_id, 'user ' || user_id AS display_name,
    CASE event_type WHEN 'view' THEN 'scheduled' ELSE 'manual' END AS trigger,
    CASE WHEN event_type = 'purchase' THEN 'succeeded' WHEN event_type = 'signup' AND value > 200 THEN 'queued'
      ELSE 'failed' END AS state, ts AS queued_at FROM events)"""


@query("latest_load", with_sql(_JOBS, select="""
SELECT display_name, job_id, state, trigger FROM (SELECT *, row_number() OVER (PARTITION BY display_name
  ORDER BY queued_at DESC, job_id DESC) AS n FROM jobs) WHERE n = 1"""))
def latest_load(spark, d):
    return catalog.latest_load(_jobs(spark, d)).select("display_name", "job_id", "state", "trigger")


@query("last_success", with_sql(_JOBS, select="""
SELECT vehicle_id, epoch_us(max(queued_at)) AS last_success FROM jobs WHERE state = 'succeeded' GROUP BY ALL"""))
def last_success(spark, d):
    return catalog.last_success(_jobs(spark, d)).select(
        "vehicle_id", F.unix_micros(F.col("last_success").cast("timestamp")).alias("last_success")
    )


@query("stale_scopes", with_sql(_JOBS, select=f"""
SELECT v.vehicle_id, max(queued_at) FILTER (state = 'succeeded') IS NOT NULL AS loaded
FROM (SELECT DISTINCT user_id AS vehicle_id FROM events) v LEFT JOIN jobs USING (vehicle_id) GROUP BY ALL
HAVING count(*) FILTER (state = 'queued') = 0 AND coalesce(max(queued_at) FILTER (state = 'succeeded')
  <= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR, TRUE)"""))
def stale_scopes(spark, d):
    jobs = _jobs(spark, d)
    vehicles = jobs.select("vehicle_id", "display_name").distinct()
    stale = catalog.stale_scopes(vehicles, jobs, F.lit(NOW).cast("timestamp_ntz"))
    return stale.select("vehicle_id", F.col("last_success").isNotNull().alias("loaded"))


@query("recent_loads", with_sql(_JOBS, select="""
SELECT job_id, display_name, state, trigger, state <> 'queued' AS is_finished FROM jobs
ORDER BY queued_at DESC, job_id DESC LIMIT 20"""))
def recent_loads(spark, d):
    return catalog.recent_loads(_jobs(spark, d)).select("job_id", "display_name", "state", "trigger", "is_finished")


@query("dismiss_outcomes", with_sql(_JOBS, select="""
SELECT o.o_orderkey AS job_id, CASE WHEN j.job_id IS NULL THEN 'not_found' WHEN state = 'queued' THEN 'still_running'
  ELSE 'dismissed' END AS outcome FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN jobs j ON j.job_id = o_orderkey"""))
def dismiss_outcomes(spark, d):
    """Order numbers are the loads asked to be dismissed."""
    ids = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"))
    return catalog.dismiss(_jobs(spark, d), ids)[1]


@query("dismiss_kept", with_sql(_JOBS, select="""
SELECT job_id, state FROM jobs WHERE state = 'queued' OR job_id NOT IN (SELECT o_orderkey FROM orders)"""))
def dismiss_kept(spark, d):
    ids = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"))
    return catalog.dismiss(_jobs(spark, d), ids)[0].select("job_id", "state")


def _runs(spark, d) -> DataFrame:
    """Events as evaluation runs; error events wrote metrics that are not JSON."""
    return t.table(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("vehicle_id"), F.col("ts").alias("ran_at"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("<"), "props")).otherwise(F.col("props")).alias("metrics"),
    )


@query("run_history", """
SELECT run_id, row_number() OVER (ORDER BY ran_at DESC, run_id DESC) = 1 AS is_latest
FROM (SELECT event_id AS run_id, ts AS ran_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)""")
def run_history(spark, d):
    return catalog.latest_and_history(_runs(spark, d)).select("run_id", "is_latest")


@query("read_metrics", """
SELECT event_id AS run_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k
FROM events""")
def read_metrics(spark, d):
    return catalog.read_metrics(_runs(spark, d)).select(
        "run_id", F.try_variant_get("metrics", "$.k", "int").alias("k")
    )


@query("embedding_progress", with_sql(DOCS, select="""
SELECT vehicle_id, count(*) FILTER (vec_id IS NULL) AS pending, count(vec_id) AS embedded
FROM docs LEFT JOIN embeddings ON vec_id = document_id GROUP BY ALL"""))
def embedding_progress(spark, d):
    return catalog.embedding_progress(t.corpus(spark, d))


def _states(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").alias("at"),
        F.when(kind == "signup", "queued").when(kind == "purchase", "succeeded")
        .when(kind == "error", "failed").otherwise("running").alias("state"),
    )


_STATES = """
SELECT job_id, arg_min(state, (-level, ts, event_id)) AS state FROM (SELECT user_id AS job_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed'
    ELSE 'running' END AS state,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN 3 ELSE 2 END AS level FROM events)
GROUP BY ALL"""


@query("load_state", _STATES)
def load_state(spark, d):
    return catalog.load_state(_states(t.table(spark, d, "events"))).select("job_id", "state")


# --- evaluation ------------------------------------------------------------------

_QUERIES = """queries AS (SELECT link * 1000000000 + document_id AS case_row, s.scope,
    (link * 1000000000 + document_id) * 2 + CASE s.scope WHEN 'all' THEN 0 ELSE 1 END AS query_id, document_id AS asked,
    vehicle_id, body AS text, 'allTrims' AS trims, CAST(NULL AS VARCHAR) AS component, CAST(NULL AS DATE) AS filed_from,
    CAST(NULL AS DATE) AS filed_to FROM cases, (VALUES ('all'), ('campaigns')) s(scope)
  WHERE length(trim(body, E' \\n\\t\\r')) >= 2)"""
_GRID = [DOCS, VEHICLES, _LINKS, _QUERIES, t.terms_sql(), t.tokens_sql(), PAIRS, SPARSE, DENSE.replace(
    "FROM pairs p JOIN embeddings a ON a.vec_id = p.query_id",
    "FROM pairs p JOIN (SELECT query_id, asked FROM queries) q USING (query_id) JOIN embeddings a ON a.vec_id = q.asked"),
    FUSED, """
modes AS (SELECT query_id, chunk_id, 'sparse' AS mode, 1.0 / (60 + sparse_rank) AS s FROM sparse UNION ALL
  SELECT query_id, chunk_id, 'dense', 1.0 / (60 + dense_rank) FROM dense UNION ALL
  SELECT query_id, chunk_id, 'hybrid', fused_score FROM fused),
ranked AS (SELECT q.scope, mode, q.case_row, m.chunk_id AS document_id, row_number() OVER
    (PARTITION BY m.query_id, mode ORDER BY s DESC, chunk_id) AS rank
  FROM modes m JOIN (SELECT query_id, scope, case_row FROM queries) q USING (query_id)),
scores AS (SELECT r.scope, mode, r.case_row, count(*) FILTER (rank <= 5) / any_value(n) AS recall_at_5,
    count(*) FILTER (rank <= 10) / any_value(n) AS recall_at_10, 1.0 / min(rank) AS reciprocal_rank
  FROM ranked r JOIN cases c ON r.case_row = c.link * 1000000000 + c.document_id
  JOIN qrels q ON q.link = c.link AND q.document_id = r.document_id
  JOIN (SELECT link, count(*) AS n FROM qrels GROUP BY ALL) w ON w.link = c.link WHERE rank <= 10 GROUP BY ALL)"""]


def _evaluation(spark, d):
    vectors = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    return (t.links(spark, d), t.documents(spark, d), t.vehicles(spark, d), t.corpus(spark, d), vectors)


@query("evaluation_grid", with_sql(*_GRID, select="""
SELECT g.scope, g.mode, CASE g.scope WHEN 'all' THEN g.mode ELSE 'campaigns' || upper(left(g.mode, 1)) || substr(g.mode, 2)
    END AS key, round(coalesce(sum(recall_at_5), 0) / (SELECT count(*) FROM cases), 9) AS recall_at_5,
  round(coalesce(sum(recall_at_10), 0) / (SELECT count(*) FROM cases), 9) AS recall_at_10,
  round(coalesce(sum(reciprocal_rank), 0) / (SELECT count(*) FROM cases), 9) AS mrr,
  (SELECT count(*) FROM cases) AS scored, 0 AS skipped,
  (SELECT count(*) FROM cases) - (SELECT count(DISTINCT case_row) FROM queries) AS not_asked,
  (SELECT count(*) FROM cases WHERE document_id NOT IN (SELECT vec_id FROM embeddings)) AS no_vector
FROM (SELECT * FROM (VALUES ('all'), ('campaigns')) s(scope), (VALUES ('sparse'), ('dense'), ('hybrid')) m(mode)) g
LEFT JOIN scores USING (scope, mode) GROUP BY ALL"""))
def evaluation_grid(spark, d):
    """The first 20 complaints of each link, of any length, asked by their first 24 distinct terms."""
    return _grid_rows(plan.evaluate(*_evaluation(spark, d), settings=plan.CAPPED))


def _grid_rows(rows, *more):
    return rows.select("scope", "mode", "key", *[
        F.round(c, 9).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr")
    ], "scored", "skipped", "not_asked", "no_vector", *more)


@query("evaluation_published", ORACLE["evaluation_grid"].replace("E' \\n\\t\\r')) >= 2", "E' \\n\\t\\r')) BETWEEN 2 AND 500"))
def evaluation_published(spark, d):
    """The published setting: as ``evaluation_grid``, and a case text over 500 characters is no query."""
    return _grid_rows(plan.evaluate(*_evaluation(spark, d), settings=plan.PUBLISHED))


def _uncapped(sql: str) -> str:
    """The SQL of a grid without its limits of terms a text and complaints a link."""
    for limit in ("WHERE pos < 24", "WHERE pick <= 20"):
        assert limit in sql
        sql = sql.replace(limit, "")
    return sql


@query("evaluation_whole", _uncapped(ORACLE["evaluation_grid"]).replace(" AS no_vector", " AS no_vector, 0 AS not_picked"))
def evaluation_whole(spark, d):
    """Every complaint of each link's window, asked with all terms of its text."""
    blocks = cut_lineage(pack_blocks(t.worded(spark, d)))
    rows = plan.evaluate(*_evaluation(spark, d), settings=plan.Settings(max_terms=None, per_link=None), blocks=blocks)
    return _grid_rows(rows, "not_picked")


@query("case_metrics", with_sql(*_GRID, select="""
SELECT scope, mode, link * 1000000000 + c.document_id AS case_row, round(recall_at_5, 9) AS recall_at_5,
  round(recall_at_10, 9) AS recall_at_10, round(reciprocal_rank, 9) AS reciprocal_rank
FROM scores s JOIN cases c ON s.case_row = c.link * 1000000000 + c.document_id"""))
def case_metrics(spark, d):
    links, docs, vehicles, corpus, vectors = _evaluation(spark, d)
    cases, relevant = build_ground_truth(links, docs)
    cases = spread(cut_lineage(cases))
    ranked, _ = plan.case_rankings(cases, vehicles, corpus, vectors, settings=plan.CAPPED, relevant=relevant)
    link = relevant.join(links.select(F.col("investigation_document_id").alias("document_id")), "document_id").select(
        "link_id", F.col("document_id").alias("link")
    )
    row = cases.join(link, "link_id").select(
        "case_row", (F.col("link") * 1000000000 + F.col("document_id")).alias("row")
    )
    return metrics.per_case(ranked, cases, relevant, ["scope", "mode"]).join(row, "case_row").select(
        "scope", "mode", F.col("row").alias("case_row"),
        *[F.round(c, 9).alias(c) for c in ("recall_at_5", "recall_at_10", "reciprocal_rank")],
    )


@query("evaluation_without_vectors", with_sql(*_GRID[:8], """
modes AS (SELECT query_id, chunk_id, sparse_rank FROM sparse WHERE sparse_rank <= 10)""", select=f"""
SELECT s.scope, m.mode, CASE WHEN m.mode = 'sparse' THEN (SELECT count(*) FROM cases) END AS scored,
  CASE WHEN m.mode <> 'sparse' THEN '{plan.NO_PROVIDER}' END AS skipped_reason,
  CASE WHEN m.mode = 'sparse' THEN (SELECT round(count(*) / (SELECT count(*) FROM cases), 9) FROM (
    SELECT DISTINCT q.case_row FROM modes x JOIN queries q USING (query_id) JOIN cases c
      ON q.case_row = c.link * 1000000000 + c.document_id JOIN qrels r ON r.link = c.link AND r.document_id = x.chunk_id
    WHERE q.scope = s.scope)) END AS hit_share
FROM (VALUES ('all'), ('campaigns')) s(scope), (VALUES ('sparse'), ('dense'), ('hybrid')) m(mode)"""))
def evaluation_without_vectors(spark, d):
    """No embedding provider: keyword rankings are scored, the other modes say why they are not."""
    links, docs, vehicles, corpus, _ = _evaluation(spark, d)
    cases, relevant = build_ground_truth(links, docs)
    cases = spread(cut_lineage(cases))
    ranked, skips = plan.case_rankings(cases, vehicles, t.corpus(spark, d, embedded=False), None, settings=plan.CAPPED, relevant=relevant)
    rows = metrics.summarise(ranked, cases, relevant, skips)
    share = metrics.per_case(ranked, cases, relevant, ["scope", "mode"]).groupBy("scope", "mode").agg(
        F.count(F.lit(1)).alias("hits")
    )
    return rows.join(share, ["scope", "mode"], "left").select(
        "scope", "mode", "scored", "skipped_reason",
        F.round(F.when(F.col("scored").isNotNull(), F.coalesce("hits", F.lit(0))) / F.col("scored"), 9).alias("hit_share"),
    )


@query("metrics_json", with_sql(*_GRID, select="""
SELECT (SELECT count(*) FROM cases) AS case_count, round(coalesce(sum(recall_at_10) FILTER (scope = 'campaigns'
  AND mode = 'hybrid'), 0) / (SELECT count(*) FROM cases), 9) AS campaigns_hybrid_recall_at_10 FROM scores"""))
def metrics_json(spark, d):
    stored = metrics.metrics_json(plan.evaluate(*_evaluation(spark, d), settings=plan.CAPPED))
    return stored.select("case_count", F.round(
        F.get_json_object("metrics", "$.campaignsHybrid.recallAt10").cast("double"), 9
    ).alias("campaigns_hybrid_recall_at_10"))


# Documents of a landed file.
ROWS_A_FILE = 10_000
# Events of a landed file, about.
EVENTS_A_FILE = 250_000

# --- streams ---------------------------------------------------------------------

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("stream_landing", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def stream_landing(spark, d):
    """Events landing as a stream, kept once per user and type."""
    folder = scratch_folder(spark)
    landing.stream_landing(
        spark, f"{d}/events*.parquet", _EVENTS, f"{folder}/table", ["user_id", "event_type"], "event_id",
        f"{folder}/checkpoint",
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("user_id", "event_type", "event_id")


@query("stream_landing_merged", ORACLE["stream_landing"])
def stream_landing_merged(spark, d):
    """Events landing in slices, each with a part of the one before again, small enough files and levels that keys are merged."""
    folder = scratch_folder(spark)
    events = t.table(spark, d, "events")
    slices = 6
    marks = events.select(F.percentile_approx("event_id", [n / slices for n in range(1, slices)]).alias("m")).first()["m"] or []
    place = sum((F.col("event_id") > m).cast("int") for m in marks) if marks else F.lit(0)
    again = F.when(F.pmod("event_id", F.lit(5)) == 0, F.array(F.col("slice"), F.col("slice") + 1)).otherwise(F.array("slice"))
    dealt = cut_lineage(events.withColumn("slice", place).withColumn("slice", F.explode(again)))
    # A slice has as many files whatever its size, so a batch is a slice and no task holds all of it.
    files = 1 + dealt.count() // (slices * EVENTS_A_FILE)
    for n in range(len(marks) + 2):
        dealt.where(F.col("slice") == n).drop("slice").repartition(files).write.mode("append").parquet(f"{folder}/in")
    landing.stream_landing(
        spark, f"{folder}/in", _EVENTS, f"{folder}/table", ["user_id", "event_type"], "event_id", f"{folder}/checkpoint",
        files_per_batch=files, width=3, keys_a_file=1000,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("user_id", "event_type", "event_id")


@query("stream_state", _STATES)
def stream_state(spark, d):
    folder = scratch_folder(spark)
    events = landing.read_landing(spark, f"{d}/events*.parquet", _EVENTS)
    landing.stream_state(_states(events), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return landing.current_state(spark, f"{folder}/table").select("job_id", "state")


@query("stream_moves", _STATES)
def stream_moves(spark, d):
    """Events in order of time, a slice a run, each slice with a fifth of the one before again; done jobs leave the state."""
    folder = scratch_folder(spark)
    events = t.table(spark, d, "events")
    marks = events.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.5]).alias("m")).first()["m"] or []
    place = sum((F.unix_micros(F.col("ts").cast("timestamp")) > m).cast("int") for m in marks) if marks else F.lit(0)
    again = F.when(F.pmod("event_id", F.lit(5)) == 0, F.array(F.col("slice"), F.col("slice") + 1)).otherwise(F.array("slice"))
    dealt = cut_lineage(events.withColumn("slice", place).withColumn("slice", F.explode(again)))
    for n in range(len(marks) + 2):
        dealt.where(F.col("slice") == n).drop("slice").write.mode("append").parquet(f"{folder}/in")
        landed = landing.read_landing(spark, f"{folder}/in", _EVENTS)
        landing.stream_moves(_states(landed), f"{folder}/table", f"{folder}/checkpoint", keep="2 days", delay="6 hours").awaitTermination()
    return landing.reached_state(spark, f"{folder}/table").select("job_id", "state")


def _hash64(texts: list[str]):
    return hash_embed(texts, 64)


@query("stream_backfill", "SELECT doc_id AS chunk_id, 64 AS width FROM documents")
def stream_backfill(spark, d):
    """Documents landing as chunks, each given a vector once."""
    folder = scratch_folder(spark)
    # The landing folder's files hold chunks; here they are written from the documents.
    t.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text").write.parquet(f"{folder}/chunks")
    landing.stream_backfill(
        spark, f"{folder}/chunks", "chunk_id long, text string", f"{folder}/vectors", _hash64,
        f"{folder}/checkpoint", dim=64,
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/vectors").select("chunk_id", F.size("embedding").alias("width"))


@query("backfill_embeddings", "SELECT count(*) AS embedded, 0 AS remaining FROM documents")
def backfill_embeddings(spark, d):
    chunks = t.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return embed.backfill_embeddings(chunks, f"{scratch_folder(spark)}/vectors", "first", _hash64, dim=64)


@query("backfill_one_vehicle", """
SELECT count(*) AS embedded, 0 AS remaining FROM documents WHERE CAST(regexp_extract(source, '\\d+') AS BIGINT) = 3""")
def backfill_one_vehicle(spark, d):
    """Only the chunks of the vehicle that is named."""
    chunks = t.documents(spark, d).select(F.col("document_id").alias("chunk_id"), "vehicle_id", F.col("body").alias("text"))
    named = chunks.select("vehicle_id").distinct().withColumn("display_name", F.concat(F.lit("Vehicle "), F.col("vehicle_id").cast("string")))
    return embed.backfill_embeddings(chunks, f"{scratch_folder(spark)}/vectors", "one", _hash64, named, " Vehicle 3 ", dim=64)


def _ones_but_for(broken: str):
    """A provider that gives out at one text; its vectors are all ones."""
    def ones(texts: list[str]):
        if broken in texts:
            raise RuntimeError("the provider gave out")
        return np.ones((len(texts), 64))

    return ones


def _twos(texts: list[str]):
    return np.full((len(texts), 64), 2.0)


@query("backfill_resumed", "SELECT count(*) AS embedded, 0 AS remaining, 0 AS asked_again, true AS gave_out FROM documents")
def backfill_resumed(spark, d):
    """A run whose provider gives out, started again under its id: slices that were done are not asked for again."""
    path = f"{scratch_folder(spark)}/vectors"
    chunks = t.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    slice_chunks = -(-chunks.count() // 6)
    broken = chunks.select(F.max_by("text", "chunk_id")).first()[0]
    gave_out = False
    try:
        embed.backfill_embeddings(chunks, path, "run", _ones_but_for(broken), dim=64, slice_chunks=slice_chunks)
    except PySparkException:
        gave_out = True
    before = cut_lineage(embed.committed_vectors(spark, path, "run").select("chunk_id"))
    report = embed.backfill_embeddings(chunks, path, "run", _twos, dim=64, slice_chunks=slice_chunks)
    again = embed.committed_vectors(spark, path, "run").where(F.get("embedding", F.lit(0)) == 2).join(before, "chunk_id", "left_semi")
    return report.select("embedded", "remaining", F.lit(again.count()).alias("asked_again"), F.lit(gave_out).alias("gave_out"))


@query("enrichment_chain", "SELECT count(*) AS loaded, count(*) AS embedded, 3 AS done, 1 AS failed FROM documents")
def enrichment_chain(spark, d):
    """Documents landing in three batches; the first batch's vectors fail once and are made with the second."""
    folder = scratch_folder(spark)
    chunks = t.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    # Three batches of as many files as their rows ask for, so that no task holds a third of all texts.
    files = -(-chunks.count() // (3 * ROWS_A_FILE)) or 1
    chunks.repartition(3 * files).write.parquet(f"{folder}/landed")
    tried = []

    def vectors(batch: DataFrame, batch_id: int) -> None:
        tried.append(batch_id)
        if tried == [0]:
            raise RuntimeError("the provider gave out")
        embed.embed(batch, _hash64, 64).write.mode("overwrite").parquet(f"{folder}/vectors/batch_id={batch_id}")

    landing.stream_enriched(
        spark, f"{folder}/landed", "chunk_id long, text string", f"{folder}/table", ["chunk_id"], "chunk_id", f"{folder}/checkpoint",
        f"{folder}/ledger", vectors, files_per_batch=files, on_failure=lambda said: None).awaitTermination()
    outcomes = landing.Ledger(spark, f"{folder}/ledger")
    counts = outcomes.outcomes().agg(F.count_if(F.col("outcome") == landing.DONE).alias("done")).withColumn(
        "failed", F.lit(outcomes.tries().where(F.col("outcome") == landing.FAILED).count()))
    return counts.select(
        F.lit(spark.read.parquet(f"{folder}/table").count()).alias("loaded"),
        F.lit(spark.read.parquet(f"{folder}/vectors").select("chunk_id").distinct().count()).alias("embedded"), "done", "failed")
