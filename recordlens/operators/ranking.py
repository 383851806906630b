"""Rank lists, reciprocal rank fusion, limits and document order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# The fusion constant and the candidate window of each method.
RRF_K = 60
CANDIDATE_WINDOW = 50


def top_k(df: DataFrame, group: str | list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank.

    Spark limits each group inside every task before the shuffle, so a group of
    any size sends at most ``k`` rows per task.
    """
    keys = [group] if isinstance(group, str) else group
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def rank_sparse(scores: DataFrame, k: int = CANDIDATE_WINDOW) -> DataFrame:
    """``query_id, chunk_id, sparse_rank`` by score descending, chunk ascending."""
    return top_k(scores, "query_id", [F.desc("score"), F.asc("chunk_id")], k, "sparse_rank").select(
        "query_id", "chunk_id", "sparse_rank"
    )


def rank_dense(distances: DataFrame, k: int = CANDIDATE_WINDOW) -> DataFrame:
    """``query_id, chunk_id, dense_rank`` by distance ascending, chunk ascending."""
    return top_k(distances, "query_id", [F.asc_nulls_last("distance"), F.asc("chunk_id")], k, "dense_rank").select(
        "query_id", "chunk_id", "dense_rank"
    )


def merge_rankings(*ranked: tuple[DataFrame, str]) -> DataFrame:
    """One row per (query, chunk) with the best rank in each list, null where absent.

    Each argument is a ranked list and the name of its rank column.
    """
    names = [name for _, name in ranked]
    lists = [
        df.select("query_id", "chunk_id", *[
            (F.col(n) if n == name else F.lit(None)).cast("int").alias(n) for n in names
        ])
        for df, name in ranked
    ]
    # One shuffle by query serves the merge and what follows it within a query.
    together = reduce(DataFrame.unionByName, lists).repartition("query_id")
    return together.groupBy("query_id", "chunk_id").agg(*[F.min(n).alias(n) for n in names])


def rrf_score(ranks: list[str], k: int = RRF_K) -> Column:
    """The sum of 1/(k + rank) over the lists that hold the row."""
    if k <= 0:
        raise ValueError("k must be positive")
    return reduce(
        Column.__add__, [F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(r)), F.lit(0.0)) for r in ranks]
    )


def rrf(*ranked: tuple[DataFrame, str], k: int = RRF_K) -> DataFrame:
    """Merged rank lists with their ``fused_score``."""
    names = [name for _, name in ranked]
    return merge_rankings(*ranked).withColumn("fused_score", rrf_score(names, k))


def explain_single(ranked: DataFrame, method: str, k: int = RRF_K) -> DataFrame:
    """One method's list in the fused shape: the other rank is null."""
    if method not in ("dense", "sparse"):
        raise ValueError("Hybrid ranks come from fusion, not from a single method.")
    mine, other = f"{method}_rank", "sparse_rank" if method == "dense" else "dense_rank"
    return ranked.withColumn(other, F.lit(None).cast("int")).withColumn(
        "fused_score", F.lit(1.0) / (F.lit(k) + F.col(mine))
    ).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "fused_score")


def found_by_both() -> Column:
    return F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull()


def fused_order(fused: DataFrame, group: str | list[str] = "query_id") -> DataFrame:
    """Add ``position`` by score descending, chunk ascending."""
    keys = [group] if isinstance(group, str) else group
    window = Window.partitionBy(*keys).orderBy(F.desc("fused_score"), F.asc("chunk_id"))
    return fused.withColumn("position", F.row_number().over(window))


def limit_per_query(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Keep each query's first ``limit`` positions."""
    return hits.join(queries.select("query_id", "limit"), "query_id").where(
        F.col("position") <= F.col("limit")
    ).drop("limit")


def document_order(hits: DataFrame, group: str | list[str] = "query_id") -> DataFrame:
    """Distinct documents in order of their best position, renumbered as ``rank``."""
    keys = [group] if isinstance(group, str) else group
    best = hits.groupBy(*keys, "document_id").agg(F.min("position").alias("best"))
    window = Window.partitionBy(*keys).orderBy("best", "document_id")
    return best.select(*keys, "document_id", F.row_number().over(window).alias("rank"))


def evaluation_ranking(hits: DataFrame, depth: int = 10, group: str | list[str] = "query_id") -> DataFrame:
    """Documents among the first ``depth`` chunks, in order."""
    return document_order(hits.where(F.col("position") <= depth), group)


def distinct_ids(hits: DataFrame, group: str = "query_id") -> DataFrame:
    """Each query's distinct document ids in rank order, as an array of at most the hit limit."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "document_id")))
    return document_order(hits, group).groupBy(group).agg(
        F.transform(ordered, lambda r: r["document_id"]).alias("document_ids")
    )
