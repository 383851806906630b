"""Score every mode in every pool against the ground truth, in one job."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.blocks import ASKED, block_ranking, pack_blocks
from ..operators.filters import FIT_KEYS, dense_ready, own_fit
from ..functions.text import COMPONENT_PREFIX_LENGTH, MAX_TERMS, query_lexeme_array
from ..functions.wordlists import is_plain, plain_query_lexemes
from ..operators.ground_truth import MAX_QUERIES_PER_LINK, asked_in_windows, build_ground_truth, count_matches, in_window
from ..operators.metrics import SCOPES, averages, metrics_json, per_case, relevant_counts, summarise
from ..operators.neighbours import knn
from ..operators.postings import query_terms, tokens_of
from ..operators.ranking import CANDIDATE_WINDOW, evaluation_ranking, fused_order, merge_rankings, rrf_score
from ..operators.sizing import MAX_BROADCAST_IDS, MAX_BROADCAST_QUERIES, is_small, keep_ids, spread
from ..operators.validation import MAX_QUERY_LENGTH, checked_queries, validate_queries
from ..session import cut_lineage, small_batches, steady_unions
from ..sources.tables import append_log
from .search import hot_or_none, sparse_ranking

RANKING_DEPTH = 10
# Texts whose words a task holds at once.
TEXTS_AT_ONCE = 256
OWN = [f"own_{name}" for name in FIT_KEYS]
NO_PROVIDER = (
    "No embedding provider is configured. Set one up, or search with mode=sparse."
)


@dataclass(frozen=True)
class Settings:
    """What an evaluation asks: by default every complaint of each link's window, with all terms of its text.

    ``CAPPED`` asks the first 20 complaints of a link (the others are ``not_picked``),
    each by its first 24 distinct terms.  ``PUBLISHED`` has the limits of a typed query
    too; a case beyond them is not asked, counts as not asked, and scores zero.
    """

    max_length: int | None = None
    max_terms: int | None = None
    per_link: int | None = None
    prefix_len: int = COMPONENT_PREFIX_LENGTH
    window: int = CANDIDATE_WINDOW
    depth: int = RANKING_DEPTH


CAPPED = Settings(max_terms=MAX_TERMS, per_link=MAX_QUERIES_PER_LINK)
PUBLISHED = replace(CAPPED, max_length=MAX_QUERY_LENGTH)


def case_texts(cases: DataFrame) -> DataFrame:
    """``document_id, query_text``: the text of each complaint, once."""
    return cases.select("document_id", "query_text").dropDuplicates(["document_id"])


def once_each(texts: DataFrame) -> DataFrame:
    """``document_id, query_text``, each document once; nothing moves if none repeats."""
    repeated = texts.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return texts if is_small(repeated, 0) else cut_lineage(case_texts(texts))


def case_queries(
    cases: DataFrame, texts: DataFrame, vehicles: DataFrame, settings: Settings = Settings(), pools: list[str] = SCOPES,
) -> DataFrame:
    """Every complaint that can be asked as a query in each pool, once for all cases that ask it."""
    pairs = cases.select("vehicle_id", "document_id").distinct()
    few = is_small(pairs, MAX_BROADCAST_IDS)
    # Vehicles meet the ids, and these the texts, which then need not move.
    fitted = own_fit(pairs, vehicles)
    asked = texts.withColumnRenamed("query_text", "text").join(F.broadcast(fitted) if few else fitted, "document_id").select(
        "*", F.explode(F.array(*map(F.lit, pools))).alias("scope")).select(
        F.xxhash64("vehicle_id", "document_id", "scope").alias("query_id"), "vehicle_id", "document_id",
        "text", "scope", F.lit("hybrid").alias("mode"), F.lit("allTrims").alias("trims"),
        F.lit(None).cast("string").alias("component"), F.lit(None).cast("date").alias("filed_from"),
        F.lit(None).cast("date").alias("filed_to"), F.lit(1).alias("limit"), *OWN,
    )
    return validate_queries(asked, settings.max_length)[0]


def cut_queries(cases: DataFrame, texts: DataFrame, vehicles: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``case_queries`` without their texts, the texts' words as rows ``vehicle_id, asks, terms``, and how many words
    each has.  Each text is checked and cut once for both pools, and written."""
    single = case_queries(cases, texts, vehicles, settings, SCOPES[:1])
    text, max_terms = F.col("text"), settings.max_terms
    told = single.select("vehicle_id", "document_id", *[c for c in ASKED if c != "scope"], F.when(is_plain(text), text).alias("plain"),
                         F.when(~is_plain(text), query_lexeme_array(text, max_terms)).alias("terms"))
    schema = T.StructType([f for f in told.schema if f.name != "plain"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [done if text.as_py() is None else plain_query_lexemes(text.as_py(), max_terms)
                     for text, done in zip(batch.column("plain"), batch.column("terms").to_pylist())]
            kind = batch.schema.field("terms").type
            yield pa.RecordBatch.from_arrays([pa.array(terms, kind) if name == "terms" else batch.column(name) for name in schema.names], names=schema.names)

    with small_batches(cases.sparkSession, TEXTS_AT_ONCE):
        once = cut_lineage(told.mapInArrow(cut, schema).withColumn("n", F.size("terms")))
    asks = F.array(*[F.struct(F.xxhash64("vehicle_id", "document_id", F.lit(pool)).alias("query_id"),
                              *[F.lit(pool).alias(c) if c == "scope" else F.col(c) for c in ASKED]) for pool in SCOPES])
    queries = spread(once.drop("terms", "n")).select("vehicle_id", "document_id", F.explode(asks).alias("q")).select("vehicle_id", "document_id", "q.*")
    return queries, once.select("vehicle_id", asks.alias("asks"), "terms"), once.select("n")


def not_askable(texts: DataFrame, settings: Settings) -> DataFrame:
    """``document_id`` of the texts that are no query under the settings."""
    checked = checked_queries(texts.select(
        "document_id", F.col("query_text").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("mode", "scope", "trims", "component")],
        F.lit(1).alias("limit"), *[F.lit(None).cast("date").alias(c) for c in ("filed_from", "filed_to")]), settings.max_length)
    return checked.where("problem IS NOT NULL").select("document_id")


def count_not_asked(cases: DataFrame, texts: DataFrame, settings: Settings) -> int:
    """Cases whose text is no query under the settings."""
    return _cases_of(cases.join(not_askable(texts, settings), "document_id"))


def _cases_of(rows: DataFrame) -> int:
    """How many cases these rows are: one each, or as many as ``cases`` says."""
    each = F.col("cases") if "cases" in rows.columns else F.lit(1)
    return rows.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]


def count_without_vector(cases: DataFrame, query_vectors: DataFrame | None) -> int:
    """Cases whose own text has no vector: their dense list is empty, their hybrid list the keyword one."""
    if query_vectors is None:
        return _cases_of(cases)
    known = query_vectors.where(F.col("embedding").isNotNull()).select("document_id")
    return _cases_of(cases.join(known, "document_id", "left_anti"))


def mode_rankings(merged: DataFrame, depth: int = RANKING_DEPTH) -> DataFrame:
    """From one merged rank list per query to the ordered list of each mode.

    Sparse and dense lists are ranked once; the hybrid list is their sum.
    """
    modes = F.array(
        F.when(F.col("sparse_rank").isNotNull(), F.lit("sparse")),
        F.when(F.col("dense_rank").isNotNull(), F.lit("dense")),
        F.lit("hybrid"),
    )
    scored = merged.select("*", F.explode(F.array_compact(modes)).alias("mode")).withColumn(
        "fused_score",
        F.when(F.col("mode") == "sparse", rrf_score(["sparse_rank"]))
        .when(F.col("mode") == "dense", rrf_score(["dense_rank"]))
        .otherwise(rrf_score(["dense_rank", "sparse_rank"])),
    )
    return fused_order(scored, ["query_id", "mode"]).where(F.col("position") <= depth)


def query_rankings(
    cases: DataFrame, texts: DataFrame, vehicles: DataFrame, corpus: DataFrame, query_vectors: DataFrame | None,
    tokens: DataFrame | None = None, analyzer: str = "simple", small: bool | None = None,
    settings: Settings = Settings(), blocks: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``query_id, mode, document_id, rank``, the queries, and the ``skips`` of modes that cannot run.

    ``cases`` are the ``vehicle_id, document_id`` to ask.
    """
    steady_unions(cases.sparkSession)
    of_blocks = tokens is None and analyzer == "simple"
    # Asked by both methods: checked and fitted once.
    if of_blocks:
        queries, lists, counts = cut_queries(cases, texts, vehicles, settings)
    else:
        queries = spread(cut_lineage(case_queries(cases, texts, vehicles, settings)))
        counts = query_terms(queries, analyzer=analyzer, max_terms=settings.max_terms).select(F.lit(1).alias("n"))
    # Broadcast only as many queries as have few terms: a whole text has thousands.
    fewest = is_small(queries) and (settings.max_terms is not None or counts.agg(
        F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (len(SCOPES) if of_blocks else 1) <= MAX_BROADCAST_QUERIES * MAX_TERMS)
    small = fewest if small is None else small
    hot = hot_or_none(corpus, small)
    if of_blocks:
        stored = cut_lineage(pack_blocks(corpus)) if blocks is None else blocks
        sparse = block_ranking(lists, stored, settings.window, max_terms=settings.max_terms, merged=True)
    else:
        tokens = tokens_of(corpus, analyzer) if tokens is None else tokens
        sparse = sparse_ranking(queries, tokens, hot, settings.window, analyzer, max_terms=settings.max_terms)
    pools = F.explode(F.array(F.lit("dense"), F.lit("hybrid"))).alias("mode")
    if query_vectors is None:
        merged = sparse.withColumn("dense_rank", F.lit(None).cast("int"))
        skips = cases.sparkSession.createDataFrame(
            [(s,) for s in SCOPES], "scope string"
        ).select("scope", pools, F.lit(NO_PROVIDER).alias("skipped_reason"))
    else:
        _, waiting = dense_ready(queries, corpus)
        skips = waiting.groupBy("scope").agg(F.first("problem").alias("skipped_reason")).select(
            "scope", pools, "skipped_reason"
        )
        dense = knn(queries.join(query_vectors, "document_id"), corpus, hot, settings.window)
        merged = merge_rankings((dense, "dense_rank"), (sparse, "sparse_rank"))
    positions = mode_rankings(merged, settings.depth)
    ids = corpus.select("chunk_id", "document_id")
    # Lists lie by query: ids of few chunks come to them.
    named = ids.join(F.broadcast(positions), "chunk_id") if small else positions.join(
        F.broadcast(ids) if is_small(ids, MAX_BROADCAST_IDS) else ids, "chunk_id")
    return evaluation_ranking(named, settings.depth, ["query_id", "mode"]), queries, skips


def case_rankings(
    cases: DataFrame, vehicles: DataFrame, corpus: DataFrame, query_vectors: DataFrame | None,
    tokens: DataFrame | None = None, analyzer: str = "simple", small: bool | None = None,
    settings: Settings = Settings(), texts: DataFrame | None = None, relevant: DataFrame | None = None,
    blocks: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``scope, mode, case_row, document_id, rank`` and the ``skips`` of modes that cannot run.

    ``query_vectors`` is ``document_id, embedding`` of the complaints asked; None
    means there is no provider, which skips the modes that need one.  ``texts`` are
    ``case_texts`` when the cases do not carry their own.  With ``relevant``, the
    ``link_id, document_id`` of each link, only the ranked documents that are relevant to
    their case are given, which is all that metrics look at: a list is then not repeated
    for each case that asks it.  Without stored ``tokens`` the keyword lists come from
    blocks, stored ones if given, so that a match is no row.
    """
    texts = case_texts(cases) if texts is None else texts
    ranked, queries, skips = query_rankings(cases, texts, vehicles, corpus, query_vectors, tokens, analyzer, small, settings, blocks)
    asking = queries.select("query_id", "scope", "vehicle_id", F.col("document_id").alias("asked"))
    of_cases = cases.select("case_row", "link_id", "vehicle_id", F.col("document_id").alias("asked"))
    if relevant is None:
        asked = asking.join(of_cases, ["vehicle_id", "asked"]).select("query_id", "scope", "case_row")
        ranked = ranked.join(asked, "query_id")
    else:
        found = ranked.join(relevant.select("link_id", "document_id"), "document_id").join(asking, "query_id")
        ranked = found.join(of_cases, ["link_id", "vehicle_id", "asked"])
    return ranked.select("scope", "mode", "case_row", "document_id", "rank"), skips


def window_scores(ranked: DataFrame, queries: DataFrame, windows: DataFrame, dated: DataFrame, relevant: DataFrame) -> DataFrame:
    """``per_case`` of every complaint in a link's window, from lists of queries and ``asked_in_windows``.

    A list meets the links that one of its documents is relevant to, and of these the ones whose window holds the
    complaint are its cases.  A case that is repeated counts as often in both tables that metrics join, and once for
    each row of its query.
    """
    asking = queries.groupBy("query_id", "scope", "vehicle_id", F.col("document_id").alias("asked")).agg(F.count(F.lit(1)).alias("times"))
    targets = relevant.select("link_id", "document_id").join(windows, "link_id").join(relevant_counts(relevant), "link_id")
    complaints = dated.select("vehicle_id", F.col("document_id").alias("asked"), "component", "filed_on", "weight")
    lists = keep_ids(ranked, relevant, "document_id").join(asking.join(complaints, ["vehicle_id", "asked"]), "query_id")
    found = lists.alias("c").join(targets.alias("w"), (F.col("c.document_id") == F.col("w.document_id")) & (
        F.col("c.vehicle_id") == F.col("w.vehicle_id")) & in_window("w", "c"))
    rows = F.col("c.weight") * F.col("w.weight")
    within = lambda k: F.sum(F.when(F.col("rank") <= k, rows).otherwise(F.lit(0)))
    cases = found.groupBy("scope", "mode", "link_id", "c.vehicle_id", "asked", "times", "relevant").agg(
        within(5).alias("found_5"), within(10).alias("found_10"), F.min("rank").alias("first"),
        (F.sum(rows) / F.size(F.collect_set("rank"))).alias("repeats"))
    recall = lambda name: F.col("times") * F.col(name) * F.col("repeats") / F.col("relevant")
    return cases.select("scope", "mode", "link_id", "asked", recall("found_5").alias("recall_at_5"), recall("found_10").alias("recall_at_10"),
                        (F.lit(1.0) / F.col("first")).alias("reciprocal_rank"))


def evaluate(
    links: DataFrame, documents: DataFrame, vehicles: DataFrame, corpus: DataFrame,
    query_vectors: DataFrame | None, tokens: DataFrame | None = None, analyzer: str = "simple",
    vehicle_id: int | None = None, small: bool | None = None, settings: Settings = Settings(),
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Six rows: each pool and mode with its averages, or why it was skipped, how many cases
    were ``not_asked`` or had ``no_vector`` of their own, and how many complaints of the links'
    windows were ``not_picked`` as cases.  ``blocks`` are ``pack_blocks`` of the corpus, packed
    when not given.  Without a limit of complaints a link, a case is no row."""
    bodies = documents.where(F.col("kind") == "complaint").select("document_id", F.col("body").alias("query_text"))
    if settings.per_link is None:
        asked, windows, dated, relevant = asked_in_windows(links, documents, vehicle_id, settings.prefix_len)
        cases, relevant = cut_lineage(asked), cut_lineage(relevant)
        texts = once_each(keep_ids(bodies, cases, "document_id"))
        ranked, queries, skips = query_rankings(cases, texts, vehicles, corpus, query_vectors, tokens, analyzer, small, settings, blocks)
        # Each link's own investigation is relevant to it, so every case is scored.
        every = F.coalesce(F.sum("cases"), F.lit(0))
        counts = cases.agg(every.alias("case_count"), every.alias("scored"), F.lit(0).cast("long").alias("skipped"))
        rows, not_picked = averages(window_scores(ranked, queries, windows, dated, relevant), counts, skips), 0
    else:
        cases, relevant = build_ground_truth(links, documents, vehicle_id, settings.per_link, settings.prefix_len)
        # Used by the rankings, the counts and the averages: written once, a complaint's text not for each of its links.
        cases = spread(cut_lineage(cases.drop("query_text")))
        texts = cut_lineage(case_texts(keep_ids(bodies, cases, "document_id")))
        relevant = cut_lineage(relevant)
        not_picked = count_matches(links, documents, vehicle_id, settings.prefix_len) - cases.count()
        ranked, skips = case_rankings(cases, vehicles, corpus, query_vectors, tokens, analyzer, small, settings, texts, relevant, blocks)
        rows = summarise(ranked, cases, relevant, skips)
    return rows.withColumns({
        "not_asked": F.lit(count_not_asked(cases, texts, settings)).cast("long"),
        "no_vector": F.lit(count_without_vector(cases, query_vectors)).cast("long"),
        "not_picked": F.lit(not_picked).cast("long"),
    })


def case_scores(ranked: DataFrame, cases: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per-case metrics of every pool and mode."""
    return per_case(ranked, cases, relevant, ["scope", "mode"])


def append_eval_run(
    results: DataFrame, path: str, run_id: int, vehicle_id: int | None, ran_at,
    results_path: str | None = None,
) -> None:
    """Append the run to the history, and write its rows as JSON when a path is given."""
    results = cut_lineage(results)
    append_log(eval_run(results, run_id, vehicle_id, ran_at), path)
    if results_path:
        results.coalesce(1).write.mode("overwrite").json(results_path)


def eval_run(results: DataFrame, run_id: int, vehicle_id: int | None, ran_at) -> DataFrame:
    """The row the run history keeps."""
    return metrics_json(results).select(
        F.lit(run_id).cast("long").alias("run_id"),
        F.lit(vehicle_id).cast("long").alias("vehicle_id"),
        F.lit(ran_at).cast("timestamp").alias("ran_at"),
        "case_count", "metrics",
    )
