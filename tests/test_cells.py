"""Nearest neighbours from cells: the answer of the plain kNN, from fewer blocks."""

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F
from test_search import random_corpus

from recordlens.operators import cells, neighbours
from recordlens.plans import search as plan
from recordlens.session import cut_lineage


@pytest.fixture(scope="module")
def drawn(spark):
    corpus, queries, own = random_corpus(spark, seed=9)
    accepted, _ = plan.accept(queries, own, corpus)
    return corpus, cut_lineage(accepted.where(F.col("mode") != "sparse"))


def plain(df):
    return df.select("query_id", "chunk_id", F.round("distance", 9).alias("distance"), "dense_rank")


def clustered(spark, clusters=24, a_cluster=50, queries=30, dim=24, vehicles=2):
    """Tight clusters of vectors, each in one vehicle, and queries that lie near some of their vehicle's."""
    draw = np.random.default_rng(17)
    middles = draw.normal(size=(clusters, dim))
    held = [(i, 1 + i % vehicles, (middles[i % clusters] + 0.05 * draw.normal(size=dim)).tolist())
            for i in range(clusters * a_cluster)]
    asked = [(i, 1 + i % vehicles, (middles[draw.integers(clusters // vehicles) * vehicles + i % vehicles] + 0.05 * draw.normal(size=dim)).tolist()) for i in range(queries)]
    unknown = {"trim_key": "string", "engine_litres": "decimal(4,1)", "engine_cylinders": "int"}
    chunks = spark.createDataFrame(held, "chunk_id long, vehicle_id long, embedding array<float>").withColumns({
        "kind": F.lit("complaint"), "component": F.lit(None).cast("string"), "filed_on": F.lit(None).cast("date"),
        **{n: F.lit(None).cast(c) for n, c in unknown.items()}})
    q = spark.createDataFrame(asked, "query_id long, vehicle_id long, embedding array<float>").withColumns({
        "scope": F.lit("all"), "trims": F.lit("allTrims"), "component": F.lit(None).cast("string"),
        "filed_from": F.lit(None).cast("date"), "filed_to": F.lit(None).cast("date"),
        **{f"own_{n}": F.lit(None).cast(c) for n, c in unknown.items()}})
    return chunks, q


@pytest.mark.parametrize(("centres", "size", "k", "first"), [(16, 8, 50, 2), (3, 1000, 4, 1), (1, 5, 7, 3)])
def test_cells_give_the_plain_answer_under_every_filter(spark, drawn, centres, size, k, first):
    corpus, dense = drawn
    stored = cut_lineage(cells.pack_cells(corpus, centres, size))
    assert stored.agg(F.sum("rows")).first()[0] == corpus.where("embedding IS NOT NULL").count()
    got = cells.cell_ranking(dense, stored, k, first)
    assert rows(plain(got)) == rows(plain(neighbours.knn(dense, corpus, None, k)))


def test_clustered_vectors_leave_most_blocks_shut(spark, monkeypatch):
    chunks, asked = clustered(spark)
    stored = cut_lineage(cells.pack_cells(chunks, 48, 16))
    want = rows(plain(neighbours.knn(asked, chunks, None, 10)))
    ranked, opened = cells.open_cells(asked, stored, 10)
    assert rows(plain(ranked)) == want
    all_meetings = asked.join(stored.select("vehicle_id"), "vehicle_id").count()
    met = opened.count()
    assert met == opened.distinct().count() and 6 * met < all_meetings, (met, all_meetings)
    # A hot vehicle and a hot block are spread, and packs of any size are one answer.
    monkeypatch.setattr(cells, "BLOCKS_PER_SALT", 5)
    monkeypatch.setattr(cells, "ASKERS_PER_SALT", 2)
    monkeypatch.setattr(cells, "DIRECTORY_BYTES", 4 * 24 * 3)
    monkeypatch.setattr(cells, "QUERY_BLOCK_BYTES", 4 * 24 * 2)
    assert rows(plain(cells.cell_ranking(asked, stored, 10))) == want


def test_vectors_of_no_direction_come_last(spark):
    chunks, asked = clustered(spark, clusters=4, a_cluster=10, queries=6, vehicles=1)
    nothing = F.array_repeat(F.lit(0.0).cast("float"), 24)
    chunks = chunks.withColumn("embedding", F.when(F.col("chunk_id") % 8 == 3, nothing).otherwise(F.col("embedding")))
    asked = asked.withColumn("embedding", F.when(F.col("query_id") == 2, nothing).otherwise(F.col("embedding")))
    stored = cut_lineage(cells.pack_cells(chunks, 6, 4))
    for k in (10, 38):
        assert rows(plain(cells.cell_ranking(asked, stored, k))) == rows(plain(neighbours.knn(asked, chunks, None, k)))


def test_empty_tables(spark):
    chunks, asked = clustered(spark, clusters=2, a_cluster=3, queries=2)
    none = cut_lineage(cells.pack_cells(chunks.limit(0)))
    assert cells.cell_ranking(asked, none).count() == 0
    stored = cut_lineage(cells.pack_cells(chunks))
    assert cells.cell_ranking(asked.limit(0), stored).count() == 0
    without = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert cells.pack_cells(without).count() == 0


def test_search_takes_cells(spark, drawn):
    corpus, queries, own = random_corpus(spark, seed=9)
    hits, _ = plan.search(queries, own, corpus)
    from_cells, _ = plan.search(queries, own, corpus, cells=cut_lineage(cells.pack_cells(corpus, 16, 8)))
    assert rows(from_cells, "query_id", "chunk_id", "position") == rows(hits, "query_id", "chunk_id", "position")
