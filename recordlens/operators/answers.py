"""What an answering model is shown, and what its replies are read as."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsonfields import array_elements, object_fields
from ..functions.text import cited_id, is_blank, trim_ws

# Failure reasons.
MALFORMED_JSON = "The model's reply was not the JSON the schema asked for."
MISSING_ANSWER = "The model's reply carried no answer text."

Answerer = Callable[[list[str]], list[str]]


def merge_pools(wide: DataFrame, campaigns: DataFrame) -> DataFrame:
    """``query_id, document_id`` of both pools, each record once per question."""
    keys = ["query_id", "document_id"]
    return wide.select(*keys).unionByName(campaigns.select(*keys)).distinct()


def evidence_key() -> Column:
    """Order of evidence: numeric ids ascending, then the others by text."""
    text = F.col("document_id").cast("string")
    return F.struct(
        F.coalesce(text.try_cast("long"), F.lit(2**63 - 1)).alias("number"), text.alias("text")
    )


def evidence_order(records: DataFrame) -> DataFrame:
    """Add the 1-based ``pos`` of each record in its question's evidence."""
    from pyspark.sql import Window

    order = evidence_key()
    return records.withColumn(
        "pos", F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    )


def record_text() -> Column:
    """One record as the model reads it."""
    return F.concat(
        F.lit("RECORD "), F.col("document_id").cast("string"),
        F.lit("\nkind: "), F.lower("kind"),
        F.lit("\nnhtsa id: "), F.col("external_id"),
        F.lit("\nfiled: "), F.coalesce(F.date_format("filed_on", "yyyy-MM-dd"), F.lit("unknown")),
        F.lit("\ntext: "), F.col("body"),
    )


def build_contexts(questions: DataFrame, records: DataFrame) -> DataFrame:
    """``query_id, context``: the vehicle, its records in evidence order, then the question.

    A question holds at most the records of its two pools, so its list is short.
    """
    shown = records.select("query_id", F.struct(
        evidence_key().alias("order"), record_text().alias("text")
    ).alias("record")).groupBy("query_id").agg(F.array_sort(F.collect_list("record")).alias("records"))
    blocks = F.transform("records", lambda r: F.concat(F.lit("\n\n"), r["text"], F.lit("\n")))
    return questions.join(shown, "query_id").select(
        "query_id",
        F.concat(
            F.lit("Vehicle: "), F.col("display_name"), F.lit("\n\nRecords:\n"),
            F.array_join(blocks, ""), F.lit("\nQuestion: "), trim_ws(F.col("text")),
        ).alias("context"),
    )


def answer(contexts: DataFrame, answerer: Answerer, batch: int = 16) -> DataFrame:
    """``query_id, reply`` from a picklable callable that answers a batch of contexts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at:at + batch]
                replies = answerer(part["context"].tolist())
                if len(replies) != len(part):
                    raise ValueError(f"Asked {len(part)} questions and received {len(replies)} replies.")
                yield pd.DataFrame({"query_id": part["query_id"], "reply": replies})

    return contexts.select("query_id", "context").mapInPandas(run, "query_id long, reply string")


def _last(fields: Column, name: str, kind: str) -> Column:
    """The text of the last member of that name, if it has that type."""
    named = F.filter(fields, lambda f: f["name"] == name)
    last = F.try_element_at(named, F.lit(-1))
    return F.when(last["type"] == kind, last["text"])


def parse_answers(replies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read ``answer_id, reply`` into answers, citations and failures.

    Anything but an object with a non-blank ``answer`` text is a failure with its
    reason.  Of a repeated member the last counts.  Citations that are not objects
    are passed over; a missing id or quote reads as the empty text.
    """
    v = F.col("v")
    read = replies.withColumn("v", object_fields("reply")).withColumn(
        "failure",
        F.when(v.isNull(), F.lit(MALFORMED_JSON))
        .when(is_blank(F.coalesce(_last(v, "answer", "STRING"), F.lit(""))), F.lit(MISSING_ANSWER)),
    )
    good = read.where("failure IS NULL")
    texts = F.filter(
        F.from_json(_last(v, "linkedCampaigns", "ARRAY"), "array<variant>"), lambda c: F.schema_of_variant(c) == "STRING")
    campaigns = F.filter(F.transform(texts, lambda c: F.variant_get(c, "$", "string")), lambda c: ~is_blank(c))
    answers = good.select(
        "answer_id",
        _last(v, "answer", "STRING").alias("answer_text"),
        F.coalesce(_last(v, "isKnownPattern", "BOOLEAN") == "true", F.lit(False)).alias("is_known_pattern"),
        F.coalesce(campaigns, F.array().cast("array<string>")).alias("linked_campaigns"),
    )
    cited = good.select("answer_id", array_elements(_last(v, "citations", "ARRAY")).alias("items")).select(
        "answer_id", F.posexplode_outer("items").alias("pos", "item")
    ).select("answer_id", "pos", object_fields("item").alias("c"))
    c = F.col("c")
    citations = cited.where(c.isNotNull()).select(
        "answer_id", "pos",
        cited_id(F.coalesce(_last(c, "documentId", "STRING"), F.lit(""))).alias("document_id"),
        F.coalesce(_last(c, "quote", "STRING"), F.lit("")).alias("quote"),
    )
    return answers, citations, read.where("failure IS NOT NULL").select("answer_id", "failure")
