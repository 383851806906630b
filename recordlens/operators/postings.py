"""Keyword matching: analysed text, postings, and scores per query and chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.english import STOP_WORDS, stem
from ..functions.text import MAX_TERMS, lexemes, query_term_array, raw_words
from .filters import RECORD_COLUMNS, passes
from .sizing import replicated, salted

# Characters of text that one task cuts into postings, whose counts it holds.
CHARS_PER_TASK = 8 << 20
# Distinct terms of a query that one mask tells apart.
TERMS_A_MASK = 63


def _english(tokens: DataFrame) -> DataFrame:
    """Drop stop words and stem; each distinct word is stemmed once."""
    kept = tokens.where(~F.col("lexeme").isin(STOP_WORDS))
    vocabulary = kept.select(F.col("lexeme").alias("word")).distinct().select(
        "word", stem(F.col("word")).alias("stemmed")
    )
    return (
        kept.join(vocabulary, kept["lexeme"] == vocabulary["word"])
        .withColumn("lexeme", F.col("stemmed")).drop("word", "stemmed")
    )


def analyzed(tokens: DataFrame, analyzer: str) -> DataFrame:
    """Tokens as an analyzer leaves them: as they are, or English stems without stop words."""
    if analyzer == "simple":
        return tokens
    if analyzer == "english":
        return _english(tokens)
    raise ValueError(f"unknown analyzer {analyzer!r}")


def analyze(df: DataFrame, text: str, analyzer: str = "simple") -> DataFrame:
    """One row per token: the other columns, ``position`` and ``lexeme``."""
    others = [c for c in df.columns if c != text]
    tokens = df.select(*others, F.posexplode_outer(lexemes(F.col(text))).alias("position", "lexeme")).where(
        F.col("lexeme").isNotNull()
    )
    return analyzed(tokens, analyzer)


def query_terms(
    queries: DataFrame, text: str = "text", analyzer: str = "simple", max_terms: int | None = MAX_TERMS,
) -> DataFrame:
    """``query_id, pos, term, lexeme`` and the other query columns; none for no usable term."""
    others = [c for c in queries.columns if c != text]
    terms = queries.select(
        *others, F.posexplode_outer(query_term_array(F.col(text), max_terms)).alias("pos", "t")
    ).where(F.col("t").isNotNull()).select(*others, "pos", "t.term", "t.lexeme")
    if analyzer == "english":
        # Two words of one stem count once: the earliest stays.
        return _english(terms).groupBy(*others, "lexeme").agg(
            F.min("pos").alias("pos"), F.min_by("term", "pos").alias("term")
        ).select(*others, "pos", "term", "lexeme")
    return terms


def tokens_of(corpus: DataFrame, analyzer: str = "simple") -> DataFrame:
    """Token occurrences of a corpus with the columns filters look at; ``tf`` is one.

    The outer form keeps Spark from cutting each text a second time in a filter
    of its own; empty words and texts drop out after.
    """
    tokens = corpus.select(
        "chunk_id", *RECORD_COLUMNS, F.explode_outer(raw_words(F.lower("text"))).alias("lexeme")
    ).where(F.col("lexeme") != "")
    if analyzer != "simple":
        tokens = analyzed(tokens, analyzer)
    return tokens.withColumn("tf", F.lit(1))


def build_postings(corpus: DataFrame, analyzer: str = "simple", partitions: int | None = None) -> DataFrame:
    """``chunk_id, <record columns>, lexeme, tf``.

    Texts are partitioned by chunk before they are cut, so the count per chunk
    and lexeme needs no second shuffle, and texts are smaller than their tokens.
    Without ``partitions`` there are as many as the texts' lengths ask for, so a
    task's counts stay within what it can hold, however large the corpus is.
    """
    if partitions is None:
        chars = corpus.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        partitions = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-chars // CHARS_PER_TASK))
    by_chunk = corpus.repartition(partitions, "chunk_id")
    return tokens_of(by_chunk, analyzer).groupBy("chunk_id", *RECORD_COLUMNS, "lexeme").agg(
        F.sum("tf").cast("int").alias("tf")
    )


def save_postings(corpus: DataFrame, table: str, buckets: int, analyzer: str = "simple") -> None:
    """Keep the postings as a table bucketed by chunk and sorted by lexeme.

    A scoring job over it sums per (query, chunk) without a shuffle, and a few
    query terms skip most row groups.
    """
    (
        build_postings(corpus, analyzer, buckets)
        .write.mode("overwrite").bucketBy(buckets, "chunk_id").sortBy("lexeme").saveAsTable(table)
    )


def match_terms(terms: DataFrame, postings: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Query terms × postings of the same vehicle and lexeme that pass the query's filters.

    With few queries (``hot`` is None) the terms are broadcast and the postings
    stay where they are.  With many, both sides are shuffled by vehicle and
    lexeme, and the vehicles in ``hot`` also by a salt, so that a frequent word
    of a large vehicle is many tasks.
    """
    # A number of the lexeme within its query: distinct terms are counted by a mask of them.
    terms = terms.withColumn("number", F.dense_rank().over(Window.partitionBy("query_id").orderBy("lexeme")) - 1)
    same = (F.col("p.vehicle_id") == F.col("t.vehicle_id")) & (F.col("p.lexeme") == F.col("t.lexeme"))
    if hot is None:
        left, right = postings, F.broadcast(terms)
    else:
        left, right = salted(postings, F.col("chunk_id"), hot), replicated(terms, hot)
        same = same & (F.col("p.salt") == F.col("t.salt"))
    return left.alias("p").join(right.alias("t"), same & passes("p", "t")).select(
        "t.query_id", "p.chunk_id", "p.lexeme", "p.tf", "t.number"
    )


def sparse_scores(matches: DataFrame, score: str = "occurrences") -> DataFrame:
    """``query_id, chunk_id, score``: matching occurrences, or distinct matching terms."""
    if score == "occurrences":
        return matches.groupBy("query_id", "chunk_id").agg(F.sum("tf").alias("score"))
    if score == "distinct":
        # One row per query and chunk, not one for each of its terms.
        masks = matches.groupBy("query_id", "chunk_id", F.floor(F.col("number") / TERMS_A_MASK).alias("part")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, CAST(number % {TERMS_A_MASK} AS INT))")).alias("mask"))
        return masks.groupBy("query_id", "chunk_id").agg(F.sum(F.bit_count("mask")).alias("score"))
    raise ValueError(f"unknown score {score!r}")
