"""Recall at k and reciprocal rank, per case and averaged over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import result_key

SCOPES = ["all", "campaigns"]
MODES = ["sparse", "dense", "hybrid"]
NO_CASES = "No ground-truth cases exist yet. Load records first."


def relevant_counts(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("link_id").agg(F.count_distinct("document_id").alias("relevant"))


def relevant_retrieved(ranked: DataFrame, cases: DataFrame, qrels: DataFrame) -> DataFrame:
    """The ranked rows whose document is relevant to their case."""
    return ranked.join(cases.select("case_row", "link_id"), "case_row").join(
        qrels, ["link_id", "document_id"], "left_semi"
    )


def recall_at_k(found: DataFrame, qrels: DataFrame, group: list[str], k: int) -> DataFrame:
    """Per case: distinct relevant documents among the first ``k`` over all relevant ones."""
    if k <= 0:
        raise ValueError("k must be positive")
    hits = found.groupBy(*group, "link_id").agg(
        F.count_distinct(F.when(F.col("rank") <= k, F.col("document_id"))).alias("n")
    )
    return hits.join(relevant_counts(qrels), "link_id").select(
        *group, (F.col("n") / F.col("relevant")).alias("recall")
    )


def per_case(
    ranked: DataFrame, cases: DataFrame, qrels: DataFrame, group: list[str]
) -> DataFrame:
    """``group, case_row, recall_at_5, recall_at_10, reciprocal_rank`` of cases that found something.

    ``ranked`` has one row per (group, case, document), which makes counts distinct.
    """
    within = lambda k: F.count_if(F.col("rank") <= k) / F.first("relevant")
    found = relevant_retrieved(ranked, cases, qrels).join(relevant_counts(qrels), "link_id")
    return found.groupBy(*group, "case_row").agg(
        within(5).alias("recall_at_5"),
        within(10).alias("recall_at_10"),
        (F.lit(1.0) / F.min("rank")).alias("reciprocal_rank"),
    )


def case_counts(cases: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: all cases, those with a relevant set, those without."""
    has = cases.join(
        relevant_counts(qrels), "link_id", "left"
    ).select(F.col("relevant").isNotNull().alias("has"))
    return has.agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if("has").alias("scored"),
        F.count_if(~F.col("has")).alias("skipped"),
    )


def _average(total: str) -> Column:
    return F.when(
        F.col("scored") > 0, F.coalesce(F.col(total), F.lit(0.0)) / F.col("scored")
    ).otherwise(F.lit(0.0))


def summarise(
    ranked: DataFrame, cases: DataFrame, qrels: DataFrame, skips: DataFrame | None = None
) -> DataFrame:
    """One row per pool and mode: averages over the scored cases, or the reason for none.

    Cases without a ranking count as zero, so sums over what was found divided by
    the number of scored cases are the averages.  ``skips`` is
    ``scope, mode, skipped_reason`` of the combinations that could not run.
    """
    return averages(per_case(ranked, cases, qrels, ["scope", "mode"]), case_counts(cases, qrels), skips)


def averages(scores: DataFrame, counts: DataFrame, skips: DataFrame | None = None) -> DataFrame:
    """``summarise`` of metrics per case and of the one row of ``case_counts``."""
    totals = scores.groupBy("scope", "mode").agg(
        F.sum("recall_at_5").alias("t5"),
        F.sum("recall_at_10").alias("t10"),
        F.sum("reciprocal_rank").alias("trr"),
    )
    grid = F.array(*[
        F.struct(F.lit(s).alias("scope"), F.lit(m).alias("mode")) for s in SCOPES for m in MODES
    ])
    rows = counts.select("*", F.explode(grid).alias("g")).select("*", "g.*").drop("g")
    rows = rows.join(totals, ["scope", "mode"], "left")
    if skips is None:
        rows = rows.withColumn("skipped_reason", F.lit(None).cast("string"))
    else:
        rows = rows.join(skips, ["scope", "mode"], "left")
    reason = F.when(F.col("case_count") == 0, F.lit(NO_CASES)).otherwise(F.col("skipped_reason"))
    ran = lambda c: F.when(reason.isNull(), c)
    return rows.select(
        "scope", "mode", result_key(F.col("mode"), F.col("scope")).alias("key"),
        ran(_average("t5")).alias("recall_at_5"),
        ran(_average("t10")).alias("recall_at_10"),
        ran(_average("trr")).alias("mrr"),
        ran(F.col("scored")).alias("scored"),
        ran(F.col("skipped")).alias("skipped"),
        reason.alias("skipped_reason"),
        "case_count",
    )


def metrics_json(results: DataFrame) -> DataFrame:
    """One row, ``case_count, metrics``: the grid as one flat JSON object."""
    body = F.to_json(F.struct(
        F.col("recall_at_5").alias("recallAt5"), F.col("recall_at_10").alias("recallAt10"),
        F.col("mrr"), F.col("scored").alias("scoredCaseCount"),
        F.col("skipped").alias("skippedCaseCount"),
    ))
    order = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("scope")) * 10 + F.array_position(
        F.array(*[F.lit(m) for m in MODES]), F.col("mode")
    )
    entry = F.struct(
        order.alias("order"), F.col("key"),
        F.when(F.col("skipped_reason").isNull(), body).otherwise(F.lit("null")).alias("body"),
        F.col("skipped_reason").alias("reason"),
    )
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    grid = results.agg(
        F.max("case_count").alias("case_count"), F.array_sort(F.collect_list(entry)).alias("rows")
    )
    modes = F.transform("rows", lambda r: F.concat(quoted(r["key"]), F.lit(":"), r["body"]))
    reasons = F.transform(
        F.filter("rows", lambda r: r["reason"].isNotNull()),
        lambda r: F.concat(quoted(r["key"]), F.lit(":"), quoted(r["reason"])),
    )
    skipped = F.when(
        F.size(reasons) > 0, F.concat(F.lit(',"skipped":{'), F.array_join(reasons, ","), F.lit("}"))
    ).otherwise(F.lit(""))
    return grid.select(
        "case_count", F.concat(F.lit("{"), F.array_join(modes, ","), skipped, F.lit("}")).alias("metrics")
    )
