"""Citations checked against the records they name, and what an answer may still claim."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import WS, collapse_ws, is_blank, quote_pattern
from ..schemas import CAMPAIGN_KINDS

# The reasons and the explanation shown in place of an answer.
EMPTY_QUOTE = "The citation carries no quoted text, so there is nothing to check."
NOT_FOUND = (
    "The quoted passage does not appear in the cited record. "
    "A claim that cannot be checked against the source is not evidence."
)
UNKNOWN_DOCUMENT = "The citation names a record that was not among those supplied to the model."
MISSING_DOCUMENT_ID = "The citation names no record at all."
NO_EVIDENCE = (
    "The answer to this question could not be supported. Every quote offered as evidence failed to "
    "match the record it named, so none of it is shown. The records themselves are still searchable."
)


PERCENT_DECIMALS = 1
# Quotes of one record that one pass over its body looks for.
QUOTES_A_PASS = 2_000
# Spans of white space that are more or other than one blank.
_GAP = re.compile(WS + "+")


def as_text(name: str) -> Column:
    """A record id as the text a citation names it by."""
    return F.col(name).cast("string").alias(name)


def _match(body: Column, quote: Column) -> Column:
    """Start and end of the first verbatim match in code points, or null."""
    pattern = quote_pattern(quote)
    found = F.regexp_substr(body, pattern)
    start = F.length(F.get(F.split(body, pattern, 2), F.lit(0)))
    return F.when(
        ~is_blank(quote) & found.isNotNull(),
        F.struct(start.alias("start_offset"), (start + F.length(found)).alias("end_offset")),
    )


def locate_quotes(cited: DataFrame) -> DataFrame:
    """Add ``start_offset, end_offset, reason`` to rows with a ``quote`` and a ``body``.

    White space runs match each other; everything else must be equal.  Offsets
    count code points of the body, so ``substring`` slices the quote back.
    """
    return (
        cited.withColumn("match", _match(F.col("body"), F.col("quote")))
        .withColumns({
            "start_offset": F.col("match.start_offset"),
            "end_offset": F.col("match.end_offset"),
            "reason": F.when(is_blank(F.col("quote")), F.lit(EMPTY_QUOTE))
            .when(F.col("match").isNull(), F.lit(NOT_FOUND)),
        })
        .drop("match")
    )


def first_spans(body: str, quotes: list[str]) -> list[tuple[int, int] | None]:
    """First place of each quote (white space collapsed, none blank) in one pass over the body."""
    gaps = [m.span() for m in _GAP.finditer(body) if m.end() - m.start() > 1]
    flat = _GAP.sub(" ", body)
    # Where the collapsed text resumes after each long gap, and how much it lacks from there on.
    lost = np.cumsum([end - start - 1 for start, end in gaps], dtype=np.int64)
    resumes = np.array([end for _, end in gaps], np.int64) - lost
    at = lambda place: place + int(np.append(0, lost)[np.searchsorted(resumes, place, "right")])
    words = ahocorasick.Automaton()
    for k, quote in enumerate(quotes):
        words.add_word(quote, (k, len(quote)))
    found: list[tuple[int, int] | None] = [None] * len(quotes)
    left = len(quotes)
    if left:
        words.make_automaton()
        for last, (k, length) in words.iter(flat):
            if found[k] is None:
                found[k] = (at(last + 1 - length), at(last) + 1)
                left -= 1
                if not left:
                    break
    return found


def locate_in_bodies(pairs: DataFrame, bodies: DataFrame, quotes_a_pass: int = QUOTES_A_PASS) -> DataFrame:
    """``document_id, quote, start_offset, end_offset, reason`` of distinct (record, quote) pairs, as ``locate_quotes`` has them.

    A record's quotes are looked for together, so its body is read once for every
    ``quotes_a_pass`` of them; a record with any number of quotes is many passes, not one task.
    A record without a body holds no quote.
    """
    wanted = pairs.where(~is_blank(F.col("quote"))).select("document_id", "quote", collapse_ws(F.col("quote")).alias("flat"))
    parts = wanted.groupBy("document_id").agg(F.ceil(F.count(F.lit(1)) / quotes_a_pass).cast("int").alias("parts"))
    grouped = wanted.join(parts, "document_id").groupBy(
        "document_id", F.pmod(F.xxhash64("quote"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("quote", "flat")).alias("quotes"))
    read = grouped.join(bodies.select(as_text("document_id"), "body"), "document_id").select("document_id", "quotes", "body")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, quotes, body = (column[row].as_py() for column in batch.columns)
                flats = list(dict.fromkeys(q["flat"] for q in quotes))  # quotes that differ in white space alone
                spans = dict(zip(flats, first_spans(body or "", flats), strict=True))
                hits = [(q["quote"], *spans[q["flat"]]) for q in quotes if spans[q["flat"]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(hits), pa.string()), pa.array([h[0] for h in hits], pa.string()),
                     *(pa.array([h[k] for h in hits], pa.int32()) for k in (1, 2))], ["document_id", "quote", "start_offset", "end_offset"])

    found = read.mapInArrow(work, "document_id string, quote string, start_offset int, end_offset int")
    return pairs.join(found, ["document_id", "quote"], "left").withColumn(
        "reason", F.when(is_blank(F.col("quote")), F.lit(EMPTY_QUOTE)).when(F.col("start_offset").isNull(), F.lit(NOT_FOUND)))


def attach_shown(citations: DataFrame, shown: DataFrame) -> DataFrame:
    """Citations with ``is_shown``: whether their answer was given that record."""
    known = shown.select("answer_id", as_text("document_id")).distinct().withColumn(
        "is_shown", F.lit(True)
    )
    return citations.join(known, ["answer_id", "document_id"], "left").withColumn(
        "is_shown", F.coalesce("is_shown", F.lit(False))
    )


def check_citations(citations: DataFrame, shown: DataFrame, bodies: DataFrame) -> DataFrame:
    """``answer_id, pos, document_id, quote, verified, reason, start_offset, end_offset``.

    Each distinct (record, quote) is looked up once, however many answers repeat
    it, and a record's body is read once for all its quotes.
    """
    tagged = attach_shown(citations, shown)
    pairs = tagged.where("is_shown").select("document_id", "quote").distinct()
    located = locate_in_bodies(pairs, bodies)
    return (
        tagged.join(located, ["document_id", "quote"], "left")
        .withColumn(
            "reason",
            F.when(is_blank(F.col("document_id")), F.lit(MISSING_DOCUMENT_ID))
            .when(~F.col("is_shown"), F.lit(UNKNOWN_DOCUMENT))
            .otherwise(F.col("reason")),
        )
        .select(
            "answer_id", "pos", "document_id", "quote", F.col("reason").isNull().alias("verified"),
            "reason",
            *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("start_offset", "end_offset")],
        )
    )


def citation_accounting(checked: DataFrame) -> DataFrame:
    """Per answer: emitted, verified and dropped citations, and whether any survived."""
    return checked.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("emitted"),
        F.count_if("verified").alias("verified"),
        F.count_if(~F.col("verified")).alias("dropped"),
    ).withColumn("is_grounded", F.col("verified") > 0)


def faithfulness(checked: DataFrame) -> DataFrame:
    """One row: verified over emitted citations, null when none was emitted."""
    counts = checked.agg(
        F.count_if("verified").alias("verified"), F.count(F.lit(1)).alias("emitted")
    )
    percent = F.format_number(F.col("verified") * 100 / F.col("emitted"), PERCENT_DECIMALS)
    return counts.select(
        "verified", "emitted",
        F.when(F.col("emitted") > 0, F.col("verified") / F.col("emitted")).alias("faithfulness"),
        F.when(
            F.col("emitted") > 0,
            F.concat_ws(" ", F.col("verified").cast("string"), F.lit("/"),
                        F.col("emitted").cast("string"), F.concat(F.lit("("), percent, F.lit("%)"))),
        ).otherwise(F.lit("no citations emitted")).alias("label"),
    )


def ground_answers(answers: DataFrame, accounting: DataFrame) -> DataFrame:
    """Answers with a surviving citation pass; the others keep only the fixed explanation."""
    counted = answers.join(accounting, "answer_id", "left")
    kept = F.coalesce(F.col("is_grounded"), F.lit(False))
    return counted.select(
        *[c for c in answers.columns if c not in ("answer_text", "is_known_pattern", "linked_campaigns")],
        F.when(kept, F.col("answer_text")).otherwise(F.lit(NO_EVIDENCE)).alias("answer_text"),
        (kept & F.col("is_known_pattern")).alias("is_known_pattern"),
        kept.alias("is_grounded"),
        F.when(kept, F.col("linked_campaigns")).otherwise(F.array().cast("array<string>"))
        .alias("linked_campaigns"),
        F.coalesce("verified", F.lit(0)).cast("long").alias("verified_citation_count"),
        F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped_citation_count"),
    )


def cited_records(checked: DataFrame, documents: DataFrame) -> DataFrame:
    """Official records an answer's verified citations name, once each, in citation order."""
    official = documents.where(F.col("kind").isin(CAMPAIGN_KINDS)).select(
        as_text("document_id"), "kind", "external_id"
    )
    return (
        checked.where("verified").join(official, "document_id")
        .groupBy("answer_id", "external_id")
        .agg(F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind"))
        .select("answer_id", "pos", "kind", "external_id")
    )


def uncited_matches(pool_hits: DataFrame, cited: DataFrame) -> DataFrame:
    """Campaign-pool hits whose record the answer did not cite."""
    return pool_hits.join(cited.select("answer_id", "external_id"), ["answer_id", "external_id"], "left_anti")


def citation_context(verified: DataFrame, bodies: DataFrame) -> DataFrame:
    """``before, highlighted, after`` around each citation; a bad range highlights nothing."""
    start, end, body = F.col("start_offset"), F.col("end_offset"), F.col("body")
    valid = F.coalesce((start >= 0) & (end <= F.length(body)) & (start < end), F.lit(False))
    return verified.join(bodies.select(as_text("document_id"), "body"), "document_id").select(
        "answer_id", "pos", "document_id",
        F.when(valid, F.substring(body, F.lit(1), start)).otherwise(body).alias("before"),
        F.when(valid, F.substring(body, start + 1, end - start)).otherwise(F.lit("")).alias("highlighted"),
        F.when(valid, F.substring(body, end + 1, F.length(body) - end)).otherwise(F.lit("")).alias("after"),
    )
