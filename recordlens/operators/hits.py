"""From ranked chunks to readable hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import fit_is_known, fit_label
from ..functions.text import snippet
from ..schemas import FIT_COLUMNS
from ..session import cut_lineage
from .ranking import found_by_both
from .sizing import keep_ids

SCORE_DECIMALS = 5
CORPUS_COLUMNS = [
    "chunk_id", "document_id", "text", "vehicle_id", "kind", "external_id", "title", "component",
    "filed_on", *FIT_COLUMNS,
]


def chunk_context(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the document columns that filters and hits need."""
    wanted = [c for c in CORPUS_COLUMNS if c not in ("chunk_id", "text")]
    return chunks.join(documents.select(*wanted), "document_id")


def attach_records(ranked: DataFrame, corpus: DataFrame, small: bool) -> DataFrame:
    """Ranked chunks with their stored fields; a chunk that is gone drops out.

    Few ranked rows are broadcast, so the corpus is scanned and not shuffled.
    Many are written first, and only the chunks they name are shuffled to them.
    """
    fields = corpus.select(*CORPUS_COLUMNS).drop("vehicle_id")
    if small:
        return fields.join(F.broadcast(ranked), "chunk_id")
    ranked = cut_lineage(ranked)
    return keep_ids(fields, ranked, "chunk_id").join(ranked, "chunk_id")


def rounded_score() -> Column:
    """The score scaled, rounded half to even, and scaled back."""
    scale = 10.0 ** SCORE_DECIMALS
    return F.rint(F.col("fused_score") * scale) / scale


def describe_hits(ranked: DataFrame, corpus: DataFrame, small: bool) -> DataFrame:
    """Hits as a reader sees them: fields, snippet, ranks, rounded score, fit label."""
    fit = [F.col(c) for c in ("trim", "engine_litres", "engine_cylinders")]
    return attach_records(ranked, corpus, small).select(
        "query_id", "position", "document_id", "chunk_id", "kind", "external_id", "title",
        "component", "filed_on", snippet(F.col("text")).alias("snippet"), "dense_rank",
        "sparse_rank", rounded_score().alias("fused_score"),
        found_by_both().alias("found_by_both"),
        F.when(fit_is_known(*fit), fit_label(*fit)).alias("trim"),
    )


def campaign_matches(hits: DataFrame) -> DataFrame:
    """The narrow form of campaign-pool hits."""
    return hits.select(
        "query_id", "position", "document_id", "kind", "external_id", "title", "component", "filed_on"
    )
