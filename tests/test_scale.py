"""What round 3 found to grow faster than its input: plans and files, on rows of the test's own."""

import pytest
from pyspark.sql import functions as F

from recordlens.functions import jsonfields
from recordlens.operators.blocks import block_scores, pack_blocks
from recordlens.suite import answers, reports


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def folder(spark, tmp_path):
    """Documents and benchmark texts, a few of them repeated."""
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("brake noise number "), F.col("id").cast("string"), F.lit(" heard again")).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"), F.concat(F.lit("src"), F.pmod("id", F.lit(3)).cast("string")).alias("source"),
        F.lit(30).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"brake noise number {k * 20}") for k in range(20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def chunks(spark):
    return spark.range(60).select(
        F.col("id").alias("chunk_id"), F.when(F.col("id") % 7 != 0, F.pmod("id", F.lit(2))).cast("long").alias("vehicle_id"), F.lit("complaint").alias("kind"),
        F.lit("A").alias("component"), F.lit("2024-01-01").cast("date").alias("filed_on"), F.lit(None).cast("string").alias("trim_key"),
        F.lit(None).cast("decimal(4,1)").alias("engine_litres"), F.lit(None).cast("int").alias("engine_cylinders"), F.lit("brake noise").alias("text"))


def test_texts_meet_the_numbers_of_blocks_without_a_shuffle(spark, shuffled):
    corpus = chunks(spark)
    packed = pack_blocks(corpus, chunks_a_block=10)
    assert "SortMergeJoin" not in plan_of(packed)
    held = packed.select("vehicle_id", F.explode("records.chunk_id").alias("chunk_id"))
    assert sorted(map(tuple, held.collect())) == sorted((k % 2, k) for k in range(60) if k % 7)
    assert packed.groupBy("vehicle_id").count().where("count > 1").count() == 2


def test_stored_blocks_move_to_their_group_alone(spark, shuffled, tmp_path):
    pack_blocks(chunks(spark), chunks_a_block=10).write.parquet(f"{tmp_path}/blocks")
    queries = spark.createDataFrame([(1, 0, "brake noise"), (2, 1, "the"), (3, 9, "brake")], "query_id long, vehicle_id long, text string").select(
        "*", F.lit("all").alias("scope"), F.lit("allTrims").alias("trims"), F.lit(None).cast("string").alias("component"),
        *[F.lit(None).cast("date").alias(c) for c in ("filed_from", "filed_to")], F.lit(None).cast("string").alias("own_trim_key"),
        F.lit(None).cast("decimal(4,1)").alias("own_engine_litres"), F.lit(None).cast("int").alias("own_engine_cylinders"))
    scores = block_scores(queries, spark.read.parquet(f"{tmp_path}/blocks"), 100)
    # Only the queries, without texts of records, meet the list of groups by a shuffle.
    assert plan_of(scores).count("SortMergeJoin") == 1
    assert sorted((r["query_id"], r["chunk_id"], r["score"]) for r in scores.collect()) == [(1, k, 2) for k in range(0, 60, 2) if k % 7]


class Whole(str):
    def __iter__(self):
        raise AssertionError("read character by character")


def test_half_surrogates_are_found_without_reading_characters():
    assert jsonfields._clean(Whole("plain")) == "plain" and jsonfields._clean(Whole("naïve 😀")) == "naïve 😀"
    assert jsonfields._clean("a\ud800b") == "a�b" and jsonfields._clean("😀") == "😀"


def test_enrichment_chain_lands_files_by_their_rows(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "ROWS_A_FILE", 50)
    monkeypatch.setattr(reports, "scratch_folder", lambda spark: f"{tmp_path}/made")
    assert tuple(reports.enrichment_chain(spark, folder).first()) == (400, 400, 3, 1)
    assert len(list((tmp_path / "made" / "landed").glob("part-*"))) == 9


def test_citations_are_ranked_once(spark, folder, monkeypatch):
    found = spark.createDataFrame([(q, c, 1) for q in range(4) for c in range(60)], "query_id long, chunk_id long, tf int")
    monkeypatch.setattr(answers, "_open_matches", lambda spark, d: found)
    cited, shown = answers._citations(spark, folder)
    assert "Window" not in plan_of(shown) and "Window" not in plan_of(cited)
    assert cited.count() == 200 and shown.count() == 160
