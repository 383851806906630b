"""Cut record text into retrievable passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import WS, is_blank, trim_ws

MAX_PASSAGE_CHARACTERS = 1500


def paragraphs(body: Column) -> Column:
    """Runs of non-blank lines, each line trimmed and the lines joined by a blank."""
    lines = F.transform(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n"), trim_ws)
    joined = F.trim(F.array_join(lines, "\n"), F.lit("\n"))
    return F.filter(
        F.transform(F.split(joined, "\n\n+"), lambda p: F.translate(p, "\n", " ")),
        lambda p: p != "",
    )


def sentence_pieces(paragraph: Column, limit: int) -> Column:
    """Sentences of a paragraph; one longer than the limit is cut at the limit."""
    sentences = F.filter(
        F.transform(F.split(paragraph, f"(?<=[.!?]){WS}"), trim_ws), lambda s: s != ""
    )
    cut = lambda s: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")),
        lambda i: F.substring(s, i * limit + 1, F.lit(limit)),
    )
    return F.flatten(F.transform(
        sentences, lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(cut(s))
    ))


def pack(units: Column, separator: str, limit: int) -> Column:
    """Join neighbours while the result stays within the limit, keeping their order."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("held")
    )
    gap = len(separator)

    def step(state: Column, unit: Column) -> Column:
        room = F.length(state["held"]) + gap + F.length(unit) <= limit
        return (
            F.when(state["held"] == "", F.struct(state["done"].alias("done"), unit.alias("held")))
            .when(room, F.struct(
                state["done"].alias("done"),
                F.concat(state["held"], F.lit(separator), unit).alias("held"),
            ))
            .otherwise(F.struct(
                F.concat(state["done"], F.array(state["held"])).alias("done"), unit.alias("held")
            ))
        )

    return F.aggregate(
        units, start, step,
        lambda s: F.when(s["held"] == "", s["done"]).otherwise(
            F.concat(s["done"], F.array(s["held"]))
        ),
    )


def passage_texts(body: Column, limit: int = MAX_PASSAGE_CHARACTERS) -> Column:
    """Greedy passages of at most ``limit`` characters, as an array of texts."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    units = F.flatten(F.transform(
        paragraphs(body),
        lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(
            pack(sentence_pieces(p, limit), " ", limit)
        ),
    ))
    return F.transform(pack(units, "\n\n", limit), trim_ws)


def numbered(texts: Column) -> Column:
    """``array<struct<ordinal, text>>`` from an array of texts."""
    return F.transform(texts, lambda t, i: F.struct(i.cast("int").alias("ordinal"), t.alias("text")))


def whole_passage_array(body: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("ordinal"), trim_ws(body).alias("text")))


def number_passages(documents: DataFrame, texts: str) -> DataFrame:
    """One row per passage of an array column, with its ordinal.

    The outer form keeps Spark from also computing the array in a filter of its
    own, once more and below any repartitioning.
    """
    return documents.select(
        "document_id", F.posexplode_outer(texts).alias("ordinal", "text")
    ).where(F.col("text").isNotNull())


def split_passages(documents: DataFrame, max_chars: int = MAX_PASSAGE_CHARACTERS) -> DataFrame:
    """``document_id, ordinal, text`` of the packed passages of every non-blank body."""
    return number_passages(
        documents.where(~is_blank(F.col("body"))).select(
            "document_id", passage_texts(F.col("body"), max_chars).alias("texts")
        ),
        "texts",
    )


def whole_passage(documents: DataFrame) -> DataFrame:
    """``document_id, ordinal, text`` with the trimmed body as the only passage."""
    return documents.where(~is_blank(F.col("body"))).select(
        "document_id", F.lit(0).alias("ordinal"), trim_ws(F.col("body")).alias("text")
    )
