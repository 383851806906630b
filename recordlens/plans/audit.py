"""Answer questions in batch and keep only what the records support."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.answers import build_contexts, merge_pools, parse_answers
from ..operators.filters import dense_ready, own_fit, reject_unknown_scope
from ..operators.grounding import check_citations, citation_accounting, ground_answers
from ..operators.hits import describe_hits
from ..operators.sizing import is_small, keep_ids, spread
from ..operators.validation import validate_queries
from ..session import cut_lineage
from ..sources.tables import append_log
from .search import DENSE_MODES, ranked_hits

# Records shown from each pool, and the reason given when there are none.
WIDE_RECORDS = 12
CAMPAIGN_RECORDS = 4
NO_RECORDS = "No records for this vehicle matched the question, so there is nothing to cite."


def pool_queries(questions: DataFrame, wide: int, campaigns: int) -> DataFrame:
    """Each question as a query of both pools; a question without a mode is hybrid."""
    blank = F.lit(None)
    pools = F.array(
        F.struct(F.lit("all").alias("scope"), F.lit(wide).alias("limit")),
        F.struct(F.lit("campaigns").alias("scope"), F.lit(campaigns).alias("limit")),
    )
    return questions.select(
        F.col("query_id").alias("question_id"), "vehicle_id", "text", "mode", "embedding",
        F.inline(pools),
    ).withColumns({
        "query_id": F.xxhash64("question_id", "scope"), "trims": F.lit("allTrims"),
        "component": blank.cast("string"), "filed_from": blank.cast("date"),
        "filed_to": blank.cast("date"),
    })


def with_fallback(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Queries that need vectors where there are none are asked by keyword instead."""
    dense = queries.where(F.col("mode").isin(DENSE_MODES))
    has_vector = F.col("embedding").isNotNull()
    ready, waiting = dense_ready(dense.where(has_vector), corpus)
    sparse = waiting.drop("problem").unionByName(dense.where(~has_vector)).withColumn(
        "mode", F.lit("sparse")
    )
    return queries.where(~F.col("mode").isin(DENSE_MODES)).unionByName(ready).unionByName(sparse)


def evidence_pools(
    questions: DataFrame, vehicles: DataFrame, corpus: DataFrame,
    wide: int = WIDE_RECORDS, campaigns: int = CAMPAIGN_RECORDS,
    tokens: DataFrame | None = None, small: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Hits of each question among all records, and among the official ones."""
    valid, _ = validate_queries(pool_queries(questions, wide, campaigns))
    known, _ = reject_unknown_scope(valid, vehicles)
    asked = spread(cut_lineage(with_fallback(own_fit(known, vehicles), corpus)))
    small = is_small(asked) if small is None else small
    found = describe_hits(ranked_hits(asked.drop("question_id"), corpus, small, tokens), corpus, small)
    # At most the two limits per question, read several times from here on.
    hits = cut_lineage(
        found.join(asked.select("query_id", "question_id", "scope"), "query_id")
        .withColumn("query_id", F.col("question_id")).drop("question_id")
    )
    pool = lambda scope: hits.where(F.col("scope") == scope).drop("scope")
    return pool("all"), pool("campaigns")


def shown_records(wide: DataFrame, campaigns: DataFrame, documents: DataFrame) -> DataFrame:
    """The records of both pools with their bodies, once per question."""
    shown = merge_pools(wide, campaigns)
    fields = documents.select("document_id", "kind", "external_id", "filed_on", "body")
    return shown.join(keep_ids(fields, shown, "document_id"), "document_id")


def question_contexts(
    questions: DataFrame, vehicles: DataFrame, shown: DataFrame
) -> DataFrame:
    """``query_id, context`` for the answering model."""
    named = questions.join(vehicles.select("vehicle_id", "display_name"), "vehicle_id")
    return build_contexts(named, shown)


def audit_answers(
    questions: DataFrame, shown: DataFrame, replies: DataFrame, documents: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Grounded answers, one per question, and the checked citations.

    ``replies`` is ``query_id, reply, refusal``.  Questions without records, with
    a refusal or with a reply that cannot be read are ungrounded, with the reason
    as their text.
    """
    # A few ids per question, asked for the evidence test and for every citation.
    evidence = cut_lineage(shown.select("query_id", "document_id"))
    has_evidence = evidence.select("query_id").distinct().withColumn("has_evidence", F.lit(True))
    asked = questions.select("query_id", "vehicle_id", F.col("text").alias("question")).join(
        has_evidence, "query_id", "left"
    ).join(replies.select("query_id", "reply", "refusal"), "query_id", "left")
    answered = asked.where(F.col("has_evidence") & F.col("refusal").isNull()).select(
        F.col("query_id").alias("answer_id"), "reply"
    )
    answers, citations, failures = parse_answers(answered)
    citations = cut_lineage(citations)
    named = citations.select(F.col("document_id").try_cast("long").alias("document_id"))
    checked = check_citations(
        citations, evidence.withColumnRenamed("query_id", "answer_id"),
        keep_ids(documents, named, "document_id"),
    )
    grounded = ground_answers(answers, citation_accounting(checked))
    outcome = (
        asked.withColumnRenamed("query_id", "answer_id")
        .join(grounded, "answer_id", "left").join(failures, "answer_id", "left")
    )
    none = F.lit(0).cast("long")
    return outcome.select(
        "answer_id", "vehicle_id", "question",
        F.when(F.col("has_evidence").isNull(), F.lit(NO_RECORDS))
        .otherwise(F.coalesce("refusal", "failure", "answer_text")).alias("answer_text"),
        F.coalesce("is_known_pattern", F.lit(False)).alias("is_known_pattern"),
        F.coalesce("is_grounded", F.lit(False)).alias("is_grounded"),
        F.coalesce("linked_campaigns", F.array().cast("array<string>")).alias("linked_campaigns"),
        F.coalesce("verified_citation_count", none).alias("verified_citation_count"),
        F.coalesce("dropped_citation_count", none).alias("dropped_citation_count"),
    ), checked


def append_answers(audited: DataFrame, path: str, created_at) -> None:
    """Append the answers to their log; rows are never rewritten."""
    append_log(answer_rows(audited, created_at), path)


def answer_rows(audited: DataFrame, created_at) -> DataFrame:
    """The rows the answer log keeps."""
    stored = F.to_json(F.struct(
        F.col("answer_text").alias("AnswerText"), F.col("is_known_pattern").alias("IsKnownPattern"),
        F.col("is_grounded").alias("IsGrounded"),
        F.col("dropped_citation_count").alias("DroppedCitationCount"),
        F.col("linked_campaigns").alias("LinkedCampaigns"),
    ))
    return audited.select(
        "answer_id", "vehicle_id", "question", stored.alias("answer_json"),
        "verified_citation_count", "dropped_citation_count",
        F.lit(created_at).cast("timestamp").alias("created_at"),
    )
