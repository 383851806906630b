"""Batch search: one plan for a table of queries in any mix of modes and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import block_ranking
from ..operators.filters import count_other_trims, dense_ready, own_fit, reject_unknown_scope
from ..functions.text import MAX_TERMS
from ..operators.hits import describe_hits
from ..operators.cells import cell_ranking
from ..operators.neighbours import knn
from ..operators.postings import match_terms, query_terms, sparse_scores, tokens_of
from ..operators.ranking import (
    CANDIDATE_WINDOW, fused_order, limit_per_query, rank_sparse, rrf,
)
from ..operators.sizing import CHUNKS_PER_SALT, hot_vehicles, is_small, spread
from ..operators.validation import validate_queries
from ..session import cut_lineage, steady_unions

DENSE_MODES = ["dense", "hybrid"]
SPARSE_MODES = ["sparse", "hybrid"]
NO_QUERY_VECTOR = "This mode needs the query's embedding, and it has none."


def accept(
    queries: DataFrame, vehicles: DataFrame, corpus: DataFrame, dense: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Queries that can be answered, with their vehicle's fit, and rejects with a reason.

    ``dense`` says whether the corpus has vectors at all; without it every query
    that needs one is set aside.
    """
    valid, malformed = validate_queries(queries)
    known, unknown = reject_unknown_scope(valid, vehicles)
    fitted = own_fit(known, vehicles)
    needs = F.col("mode").isin(DENSE_MODES)
    searched = corpus if dense else corpus.withColumn("embedding", F.lit(None).cast("array<float>"))
    asked = fitted.where(needs)
    rejects = [malformed, unknown]
    if "embedding" in queries.columns:
        rejects.append(asked.where(F.col("embedding").isNull()).withColumn("problem", F.lit(NO_QUERY_VECTOR)))
        asked = asked.where(F.col("embedding").isNotNull())
    ready, waiting = dense_ready(asked, searched)
    rejects.append(waiting)
    shape = ["query_id", "problem"]
    rejected = rejects[0].select(*shape)
    for more in rejects[1:]:
        rejected = rejected.unionByName(more.select(*shape))
    return fitted.where(~needs).unionByName(ready), rejected


def hot_or_none(corpus: DataFrame, small: bool, chunks_per_salt: int = CHUNKS_PER_SALT) -> DataFrame | None:
    """None for few queries, which are broadcast; else the vehicles to be salted."""
    return None if small else hot_vehicles(corpus, chunks_per_salt)


def sparse_ranking(
    queries: DataFrame, tokens: DataFrame, hot: DataFrame | None, k: int = CANDIDATE_WINDOW,
    analyzer: str = "simple", score: str = "occurrences", max_terms: int | None = MAX_TERMS,
) -> DataFrame:
    """Top ``k`` chunks of each query by keyword score."""
    terms = query_terms(queries.drop("embedding"), analyzer=analyzer, max_terms=max_terms)
    return rank_sparse(sparse_scores(match_terms(terms, tokens, hot), score), k)


def fused_ranking(
    queries: DataFrame, corpus: DataFrame, small: bool, tokens: DataFrame | None = None,
    analyzer: str = "simple", k: int = CANDIDATE_WINDOW, chunks_per_salt: int = CHUNKS_PER_SALT,
    max_terms: int | None = MAX_TERMS, blocks: DataFrame | None = None, cells: DataFrame | None = None,
) -> DataFrame:
    """Each query's candidates with their ranks, ``fused_score`` and ``position``.

    A query of one method has one list, so the same sum is its own score.
    """
    steady_unions(corpus.sparkSession)
    hot = hot_or_none(corpus, small, chunks_per_salt)
    worded = queries.where(F.col("mode").isin(SPARSE_MODES))
    if blocks is None:
        tokens = tokens_of(corpus, analyzer) if tokens is None else tokens
        sparse = sparse_ranking(worded, tokens, hot, k, analyzer, max_terms=max_terms)
    else:
        sparse = block_ranking(worded, blocks, k, analyzer=analyzer, max_terms=max_terms)
    vectors = queries.where(F.col("mode").isin(DENSE_MODES))
    dense = knn(vectors, corpus, hot, k) if cells is None else cell_ranking(vectors, cells, k)
    return fused_order(rrf((dense, "dense_rank"), (sparse, "sparse_rank")))


def ranked_hits(
    queries: DataFrame, corpus: DataFrame, small: bool, tokens: DataFrame | None = None,
    analyzer: str = "simple", k: int = CANDIDATE_WINDOW, max_terms: int | None = MAX_TERMS, blocks: DataFrame | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Fused candidates cut to each query's limit."""
    return limit_per_query(fused_ranking(queries, corpus, small, tokens, analyzer, k, max_terms=max_terms, blocks=blocks, cells=cells), queries)


def search(
    queries: DataFrame, vehicles: DataFrame, corpus: DataFrame, tokens: DataFrame | None = None,
    analyzer: str = "simple", small: bool | None = None, k: int = CANDIDATE_WINDOW,
    max_terms: int | None = MAX_TERMS, blocks: DataFrame | None = None, cells: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Hits of every valid query, and the rejects; each method offers ``k`` candidates.

    ``queries`` carry an ``embedding`` where their mode needs one; ``corpus`` is
    ``chunk_context`` with an ``embedding``; ``tokens`` are stored postings, cut
    from the corpus when not given; ``blocks`` are ``pack_blocks`` of the corpus, ranked
    without exchanging matches; ``cells`` are ``pack_cells`` of it, of which a query opens
    what can hold a neighbour.  A query asks its first ``max_terms`` distinct terms, or all with None.
    """
    accepted, rejected = accept(queries, vehicles, corpus)
    # Asked by both methods and the final limit: checked and fitted once.
    accepted = spread(cut_lineage(accepted))
    small = is_small(accepted) if small is None else small
    ranked = ranked_hits(accepted, corpus, small, tokens, analyzer, k, max_terms, blocks, cells)
    return describe_hits(ranked, corpus, small), rejected


def other_trims(queries: DataFrame, vehicles: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per valid query, how many chunks belong to another version of its vehicle."""
    valid, _ = validate_queries(queries)
    return count_other_trims(corpus, own_fit(valid, vehicles))
