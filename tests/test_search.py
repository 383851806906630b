import random
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from recordlens.functions import text, wordlists
from recordlens.operators import blocks, filters, neighbours, postings, ranking, validation
from recordlens.operators.sizing import hot_vehicles, is_small
from recordlens.plans import search as plan
from recordlens.plans.embed import hash_embedded
from recordlens.session import cut_lineage

CORPUS = ("chunk_id long, document_id long, vehicle_id long, kind string, external_id string, title string, component string, "
          "filed_on date, text string, trim string, trim_key string, engine_litres decimal(4,1), engine_cylinders int")
QUERY = ("query_id long, vehicle_id long, text string, mode string, scope string, trims string, component string, "
         "filed_from date, filed_to date, `limit` int")
VEHICLE = "vehicle_id long, trim_key string, engine_litres decimal(4,1), engine_cylinders int"


def record(i, vehicle, ext, component, filed, text, kind="complaint", fit=(None, None, None)):
    key = fit[0] and fit[0].lower().replace("-", "")
    return (i, i, vehicle, kind, ext, ext, component, filed, text, fit[0], key, fit[1], fit[2])


def ask(i, text, mode="sparse", vehicle=1, **o):
    return (i, vehicle, text, mode, o.get("scope"), o.get("trims"), o.get("component"), o.get("start"), o.get("end"), o.get("limit"))


KINDS = ["complaint", "recall", "complaint", "investigation"]


def made_records(count=40):
    """Record ``i`` names the lamp ``i % 5`` times; every seventh has no date."""
    return [record(i, 1 + i % 3, f"n{i}", ["WIRING", "LENS"][i % 2], None if i % 7 == 0 else date(2011, 1, 1) + timedelta(days=17 * i),
                   " ".join(["lamp"] * (i % 5) + [f"part{i}", "fitted"]), KINDS[i % 4]) for i in range(count)]


def lit(vehicle, keep=lambda r: True):
    """Ids of the records that name the lamp, those that name it most first."""
    found = [r for r in made_records() if r[2] == vehicle and "lamp" in r[8] and keep(r)]
    return [r[4] for r in sorted(found, key=lambda r: (-r[8].count("lamp"), r[0]))]


@pytest.fixture(scope="module")
def corpus(spark):
    plain = spark.createDataFrame(made_records(), CORPUS)
    return plain.join(hash_embedded(plain, 64), "chunk_id")


@pytest.fixture(scope="module")
def vehicles(spark):
    return spark.createDataFrame([(1, None, None, None), (2, None, None, None), (3, None, None, None)], VEHICLE)


def run(spark, corpus, vehicles, *asked, **options):
    q = spark.createDataFrame(list(asked), QUERY)
    q = q.join(hash_embedded(q, 64, key="query_id"), "query_id")
    return plan.search(q, vehicles, corpus, **options)


def names(hits):
    return [r["external_id"] for r in hits.orderBy("query_id", "position").collect()]


def test_sparse(spark, corpus, vehicles):
    hits, rejects = run(spark, corpus, vehicles, ask(1, "the lamp", limit=50))
    got = hits.orderBy("position").collect()
    assert [r["external_id"] for r in got] == lit(1) and len(got) > 8
    assert [r["sparse_rank"] for r in got] == list(range(1, len(got) + 1)) and all(r["dense_rank"] is None for r in got)
    assert [r["fused_score"] for r in got] == [round(1 / (60 + k), 5) for k in range(1, len(got) + 1)] and rejects.count() == 0


def test_dense_and_hybrid(spark, corpus, vehicles):
    hits, _ = run(spark, corpus, vehicles, ask(1, "lamp", "dense", limit=50), ask(2, "lamp", None, limit=50))
    dense = hits.where("query_id = 1").orderBy("position").collect()
    assert {r["external_id"] for r in dense} == {r[4] for r in made_records() if r[2] == 1} and all(r["sparse_rank"] is None for r in dense)
    hybrid = hits.where("query_id = 2").orderBy("position").collect()
    assert {r["external_id"] for r in hybrid if r["found_by_both"]} == set(lit(1))
    assert [r["fused_score"] for r in hybrid] == sorted((r["fused_score"] for r in hybrid), reverse=True)


def test_filters(spark, corpus, vehicles):
    early, late = date(2011, 5, 1), date(2012, 3, 1)
    keeps = {
        1: (dict(start=early, end=late), lambda r: r[7] and early <= r[7] <= late), 2: (dict(end=late), lambda r: r[7] and r[7] <= late),
        3: (dict(component=" wiring "), lambda r: r[6] == "WIRING"), 4: (dict(scope="CAMPAIGNS"), lambda r: r[3] != "complaint"),
        5: (dict(scope="campaigns", start=early), lambda r: r[3] != "complaint" and r[7] and r[7] >= early),
    }
    asked = [ask(i, "lamp", limit=50, vehicle=2, **given) for i, (given, _) in keeps.items()]
    hits, _ = run(spark, corpus, vehicles, *asked, ask(9, "lamp", limit=3), ask(10, "lamp", "dense", limit=50, vehicle=2, end=late))
    by = lambda q: [r["external_id"] for r in hits.where(f"query_id = {q}").orderBy("position").collect()]
    for i, (_, keep) in keeps.items():
        assert by(i) == lit(2, keep) and by(i)
    assert by(9) == lit(1)[:3]
    assert set(by(10)) == {r[4] for r in made_records() if r[2] == 2 and r[7] and r[7] <= late}


def test_rejects(spark, corpus, vehicles):
    bare = corpus.withColumn("embedding", F.when(F.col("vehicle_id") != 2, F.col("embedding")))
    _, rejects = run(
        spark, bare, vehicles, ask(1, "x"), ask(2, "noise", vehicle=9), ask(3, "noise", "hybrid", vehicle=2),
        ask(4, "noise", "sparse", vehicle=2), ask(5, "noise", "magic"),
    )
    assert rows(rejects) == [
        (1, validation.QUERY_LENGTH_PROBLEM), (2, "No vehicle with id 9 is registered."),
        (3, filters.NOT_EMBEDDED), (5, "Unknown mode 'magic'. Use dense, sparse, or hybrid.")]


@pytest.mark.parametrize("bad, problem", [
    (dict(text=" a "), validation.QUERY_LENGTH_PROBLEM), (dict(text="x" * 501), validation.QUERY_LENGTH_PROBLEM),
    (dict(text=None), validation.QUERY_LENGTH_PROBLEM),
    (dict(limit=0), validation.LIMIT_PROBLEM), (dict(limit=51), validation.LIMIT_PROBLEM),
    (dict(start=date(2020, 1, 2), end=date(2020, 1, 1)), validation.DATES_PROBLEM),
    (dict(scope="recalls"), "Unknown scope 'recalls'. Use all or campaigns."),
    (dict(trims="1"), "Unknown trims '1'. Use thisTrim or allTrims."),
    (dict(scope="1", limit=0), "Unknown scope '1'. Use all or campaigns."),
])
def test_validation_problems(spark, bad, problem):
    bad = dict(bad)
    q = spark.createDataFrame([ask(1, bad.pop("text", "noise"), None, **bad)], QUERY)
    valid, rejects = validation.validate_queries(q)
    assert valid.count() == 0 and rejects.first()["problem"] == problem


def test_validation_defaults(spark):
    q = spark.createDataFrame([ask(1, "  noise ", None, component=" structure ", limit=50), ask(2, "x" * 500, " Dense ")], QUERY)
    a, b = validation.validate_queries(q)[0].orderBy("query_id").collect()
    assert (a["text"], a["mode"], a["scope"], a["trims"], a["component"], a["limit"]) == ("noise", "hybrid", "all", "allTrims", "STRUCTURE", 50)
    assert b["mode"] == "dense" and b["limit"] == 10 and b["component"] is None


LONG = ("Harbour-Long", Decimal("1.6"), 3)


def test_fit_scope(spark):
    text = "A pump hums at idle."
    plain = spark.createDataFrame([
        record(1, 1, "mine", "T", None, text, fit=LONG), record(2, 1, "other-engine", "T", None, text, fit=("Harbour", Decimal("1.2"), 4)),
        record(3, 1, "same-trim-other-engine", "T", None, text, fit=("Harbour-Long", Decimal("2.1"), 4)),
        record(4, 1, "undecoded", "T", None, text), record(5, 2, "anything", "T", None, text, fit=LONG),
    ], CORPUS)
    corpus = plain.join(hash_embedded(plain, 64), "chunk_id")
    owned = spark.createDataFrame([(1, "harbourlong", Decimal("1.6"), 3), (2, None, None, None)], VEHICLE)
    asked = [ask(1, "pump hums idle", trims="thisTrim"), ask(2, "pump hums idle", "dense", trims="thistrim"),
             ask(3, "pump hums idle"), ask(4, "pump hums idle", vehicle=2, trims="thisTrim")]
    hits, _ = run(spark, corpus, owned, *asked)
    by = lambda q: sorted(r["external_id"] for r in hits.where(f"query_id = {q}").collect())
    assert by(1) == by(2) == ["mine", "undecoded"] and len(by(3)) == 4 and by(4) == ["anything"]
    q = spark.createDataFrame(asked, QUERY)
    assert rows(plan.other_trims(q, owned, corpus)) == [(1, 2), (2, 2), (3, 2), (4, 0)]
    assert rows(filters.within_fit(corpus, owned), "external_id") == [("anything",), ("mine",), ("undecoded",)]
    label = hits.where("external_id = 'mine' and query_id = 1").first()["trim"]
    assert label == "Harbour-Long · 1.6L · 3 cyl"
    assert hits.where("external_id = 'undecoded'").first()["trim"] is None


def random_corpus(spark, n=300, seed=1):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(30)]
    fits = [("base", Decimal("2.0"), 4), ("sport", Decimal("3.5"), 6), (None, None, None)]
    # Vehicle 1 holds most of the records.
    plain = spark.createDataFrame([
        record(i, r.choice([1, 1, 1, 2, 3]), f"e{i}", r.choice(["A", "B"]),
               r.choice([None, date(2024, 1, 1 + i % 28)]), " ".join(r.choices(words, k=r.randint(1, 20))),
               r.choice(["complaint", "recall", "investigation"]), r.choice(fits)) for i in range(n)], CORPUS)
    # Few distinct vectors, so that distances tie.
    vectors = plain.select("chunk_id", F.pmod("chunk_id", F.lit(40)).cast("string").alias("text"))
    embedded = hash_embedded(vectors, 16).where(F.pmod("chunk_id", F.lit(7)) != 0)
    q = [ask(i, " ".join(r.choices(words, k=3)), r.choice(["sparse", "dense", "hybrid"]), r.choice([1, 1, 2, 3]),
             scope=r.choice(["all", "campaigns"]), trims=r.choice(["thisTrim", "allTrims"]),
             component=r.choice([None, "A"]), start=r.choice([None, date(2024, 1, 5)]),
             end=r.choice([None, date(2024, 1, 20)]), limit=r.choice([3, 50])) for i in range(40)]
    own = spark.createDataFrame([(1, "base", Decimal("2.0"), 4), (2, None, Decimal("3.5"), None), (3, None, None, None)], VEHICLE)
    queries = spark.createDataFrame(q, QUERY)
    return plain.join(embedded, "chunk_id", "left"), queries.join(hash_embedded(queries, 16, key="query_id"), "query_id"), own


def brute_force(corpus, queries, own):
    """Rank every record of a query's vehicle, one query at a time."""
    c = [r.asDict() for r in corpus.collect()]
    fit = {r["vehicle_id"]: r for r in own.collect()}
    out = {}
    for q in queries.collect():
        def ok(r):
            o = fit[q["vehicle_id"]]
            agree = all(r[k] is None or o[k] is None or r[k] == o[k] for k in ("trim_key", "engine_litres", "engine_cylinders"))
            return (r["vehicle_id"] == q["vehicle_id"] and (q["scope"] == "all" or r["kind"] != "complaint")
                    and (q["component"] in (None, r["component"])) and (q["trims"] == "allTrims" or agree)
                    and (q["filed_from"] is None or (r["filed_on"] and r["filed_on"] >= q["filed_from"]))
                    and (q["filed_to"] is None or (r["filed_on"] and r["filed_on"] <= q["filed_to"])))
        pool = [r for r in c if ok(r)]
        terms = set(q["text"].split())
        sparse, dense = {}, {}
        if q["mode"] != "dense":
            scored = [(sum(w in terms for w in r["text"].split()), r["chunk_id"]) for r in pool]
            for rank, (_, i) in enumerate(sorted((-s, i) for s, i in scored if s)[:50], 1):
                sparse[i] = rank
        if q["mode"] != "sparse":
            near = []
            for r in pool:
                if r["embedding"] is not None:
                    a, b = np.array(q["embedding"], float), np.array(r["embedding"], float)
                    near.append((round(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 9), r["chunk_id"]))
            if not near:
                continue
            for rank, (_, i) in enumerate(sorted(near)[:50], 1):
                dense[i] = rank
        fused = sorted((-(1 / (60 + dense[i]) if i in dense else 0) - (1 / (60 + sparse[i]) if i in sparse else 0), i)
                       for i in dense.keys() | sparse.keys())
        for position, (_, i) in enumerate(fused[:q["limit"]], 1):
            out[q["query_id"], position] = (i, dense.get(i), sparse.get(i))
    return out


def test_search_equals_brute_force_by_every_path(spark):
    corpus, queries, own = random_corpus(spark)
    want = brute_force(corpus, queries, own)
    accepted, _ = plan.accept(queries, own, corpus)
    stored = postings.build_postings(corpus, partitions=3)
    for small, tokens, per_salt in [(True, None, 10), (True, stored, 10), (False, None, 10**6), (False, stored, 25)]:
        fused = plan.fused_ranking(accepted, corpus, small, tokens, chunks_per_salt=per_salt)
        hits = ranking.limit_per_query(fused, accepted)
        got = {(r["query_id"], r["position"]): (r["chunk_id"], r["dense_rank"], r["sparse_rank"]) for r in hits.collect()}
        assert got == want, (small, per_salt)


def test_hot_vehicles_are_the_large_ones(spark):
    corpus, _, _ = random_corpus(spark)
    hot = {r["vehicle_id"]: r["salts"] for r in hot_vehicles(corpus, 100).collect()}
    size = corpus.where("vehicle_id = 1").count()
    assert hot == {1: -(-size // 100)}


def test_blocks_of_any_size_give_one_answer(spark, monkeypatch):
    corpus, queries, own = random_corpus(spark, seed=3)
    accepted, _ = plan.accept(queries, own, corpus)
    dense = accepted.where(F.col("mode") != "sparse")
    whole = rows(neighbours.knn(dense, corpus, None))
    monkeypatch.setattr(neighbours, "RECORD_BLOCK_BYTES", 4 * 16 * 7)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK_BYTES", 4 * 16 * 3)
    monkeypatch.setattr(neighbours, "HELD_ENTRIES", 50)
    assert rows(neighbours.knn(dense, corpus, None)) == whole
    few = neighbours.knn(dense, corpus, None, k=4)
    assert rows(few, "query_id", "chunk_id", "dense_rank") == sorted(
        [(r[0], r[1], r[3]) for r in whole if r[3] <= 4], key=lambda r: tuple((True, str(v)) for v in r))


def test_zero_vectors_come_last(spark):
    corpus, queries, own = random_corpus(spark, 20, seed=5)
    zero = corpus.withColumn("embedding", F.when(F.col("chunk_id") == 3, F.array_repeat(F.lit(0.0).cast("float"), 16)).otherwise(
        F.coalesce("embedding", F.array_repeat(F.lit(1.0).cast("float"), 16)))).withColumn("vehicle_id", F.lit(1).cast("long"))
    q = queries.withColumns({"vehicle_id": F.lit(1).cast("long"), "scope": F.lit("all"), "trims": F.lit("allTrims"),
                             **{c: F.lit(None).cast(t) for c, t in (("component", "string"), ("filed_from", "date"), ("filed_to", "date"))}})
    got = neighbours.knn(filters.own_fit(q, own), zero, None)
    assert all(r["chunk_id"] == 3 for r in got.where("dense_rank = 20").collect()) and got.where("dense_rank = 20").count() == 40


def test_postings_table_is_scored_without_a_shuffle(spark):
    corpus, queries, own = random_corpus(spark)
    postings.save_postings(corpus, "kept_postings", 3)
    accepted, _ = plan.accept(queries.withColumn("mode", F.lit("sparse")), own, corpus)
    terms = cut_lineage(postings.query_terms(accepted.drop("embedding")))
    scores = postings.sparse_scores(postings.match_terms(terms, spark.table("kept_postings"), None))
    assert "Exchange hashpartitioning" not in scores._jdf.queryExecution().executedPlan().toString()
    direct = postings.sparse_scores(postings.match_terms(terms, postings.tokens_of(corpus), None))
    assert rows(scores) == rows(direct)
    spark.sql("drop table kept_postings")


def ranked(spark, ids, name):
    return spark.createDataFrame([(1, i, n) for n, i in enumerate(ids, 1)], f"query_id long, chunk_id long, {name} int")


@pytest.mark.parametrize("dense, sparse, want", [
    ([7, 8], [7, 9], [(7, 1, 1, 2 / 61), (8, 2, None, 1 / 62), (9, None, 2, 1 / 62)]),
    ([5, 6], [9, 6], [(6, 2, 2, 2 / 62), (5, 1, None, 1 / 61), (9, None, 1, 1 / 61)]),
    ([42], [17], [(17, None, 1, 1 / 61), (42, 1, None, 1 / 61)]), ([], [], []), ([3, 3], [], [(3, 1, None, 1 / 61)]),
])
def test_fusion(spark, dense, sparse, want):
    lists = (ranked(spark, dense, "dense_rank"), "dense_rank"), (ranked(spark, sparse, "sparse_rank"), "sparse_rank")
    for order in (lists, lists[::-1]):
        got = ranking.fused_order(ranking.rrf(*order)).orderBy("position").collect()
        assert [(r["chunk_id"], r["dense_rank"], r["sparse_rank"]) for r in got] == [w[:3] for w in want]
        assert [r["fused_score"] for r in got] == pytest.approx([w[3] for w in want])
    with pytest.raises(ValueError):
        ranking.rrf(*lists, k=0)


def test_single_method_lists(spark):
    got = ranking.explain_single(ranked(spark, [4, 2], "dense_rank"), "dense").orderBy("dense_rank").collect()
    assert [(r["chunk_id"], r["sparse_rank"], r["fused_score"]) for r in got] == [(4, None, 1 / 61), (2, None, 1 / 62)]
    with pytest.raises(ValueError):
        ranking.explain_single(ranked(spark, [4], "dense_rank"), "hybrid")


def test_document_order(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 10, 3), (1, 30, 4), (1, 40, 11)], "query_id long, document_id long, position int")
    assert rows(ranking.document_order(hits)) == [(1, 10, 1), (1, 20, 2), (1, 30, 3), (1, 40, 4)]
    assert rows(ranking.evaluation_ranking(hits), "document_id") == [(10,), (20,), (30,)]
    assert ranking.distinct_ids(hits).first()["document_ids"] == [10, 20, 30, 40]


def test_window_of_fifty(spark):
    scores = spark.range(200).select(F.floor(F.col("id") / 1000).alias("query_id"), F.col("id").alias("chunk_id"), (F.col("id") % 3).alias("score"))
    top = ranking.rank_sparse(scores)
    assert top.count() == 50 and top.orderBy("sparse_rank").first()["chunk_id"] == 2
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_size_check(spark):
    assert is_small(spark.range(5), 5) and not is_small(spark.range(6), 5)


def test_blocks_rank_as_the_full_sum_does(spark):
    corpus, queries, own = random_corpus(spark, 200, 3)
    asked = filters.own_fit(validation.validate_queries(queries.drop("embedding"))[0], own)
    tokens = postings.tokens_of(corpus)
    stored = cut_lineage(blocks.pack_blocks(corpus, chunks_a_block=8))
    for score in ("occurrences", "distinct"):
        full = plan.sparse_ranking(asked, tokens, hot_vehicles(corpus), 5, score=score)
        assert rows(blocks.block_ranking(asked, stored, 5, score=score)) == rows(full)
    hits, _ = plan.search(queries, own, corpus)
    again, _ = plan.search(queries, own, corpus, blocks=stored)
    assert rows(again) == rows(hits)


def test_blocks_that_cannot_matter_stay_shut(spark):
    """One chunk in fifty names the word often; the blocks without such a chunk are not opened."""
    plain = spark.createDataFrame([record(i, 1, f"n{i}", "A", None, "lamp " * (30 if i % 50 == 0 else 1) + "glass") for i in range(600)], CORPUS)
    one = spark.createDataFrame([(1, None, None, None)], VEHICLE)
    asked = filters.own_fit(validation.validate_queries(spark.createDataFrame([ask(1, "lamp"), ask(2, "unheard of")], QUERY))[0], one)
    stored = cut_lineage(blocks.pack_blocks(plain, chunks_a_block=6))
    found = cut_lineage(blocks.block_scores(asked, stored, 3))
    picked = [r["chunk_id"] for r in blocks.rank_sparse(found.where("chunk_id IS NOT NULL"), 3).orderBy("sparse_rank").collect()]
    assert picked == [0, 50, 100]
    share = {r["query_id"]: (r["opened"], r["held"]) for r in blocks.opened_share(found).collect()}
    assert share[1][0] <= 24 < share[1][1] and share[2][0] == 0
    assert "query_id, chunk_id" not in blocks.block_scores(asked, stored)._jdf.queryExecution().toString()


def test_a_search_may_ask_every_term(spark, corpus, vehicles):
    words = " ".join(f"w{k}" for k in range(10, 40)) + " part4"  # thirty terms of three letters come first
    assert names(run(spark, corpus, vehicles, ask(1, words, vehicle=2))[0]) == []
    stored = cut_lineage(blocks.pack_blocks(corpus))
    assert names(run(spark, corpus, vehicles, ask(1, words, vehicle=2), max_terms=None)[0]) == ["n4"]
    assert names(run(spark, corpus, vehicles, ask(1, words, vehicle=2), max_terms=None, blocks=stored)[0]) == ["n4"]


def test_rows_of_one_chunk_are_one_chunk_of_merged_blocks(spark):
    corpus, queries, own = random_corpus(spark, 60, 3)
    twice = corpus.unionByName(corpus.where("chunk_id % 3 = 0"))
    asked = filters.own_fit(validation.validate_queries(queries.drop("embedding"))[0], own)
    full = plan.sparse_ranking(asked, postings.tokens_of(twice), hot_vehicles(twice), 5)
    stored = cut_lineage(blocks.pack_blocks(twice, chunks_a_block=8))
    assert rows(blocks.block_ranking(asked, stored, 5, merged=True)) == rows(full)


def test_query_blocks_follow_no_more_salts_than_cores_use(spark, monkeypatch):
    corpus, queries, own = random_corpus(spark, 200, seed=3)
    dense = plan.accept(queries, own, corpus)[0].where(F.col("mode") != "sparse")
    seen, real = [], neighbours.replicated
    monkeypatch.setattr(neighbours, "replicated", lambda df, hot: seen.append(hot.agg(F.max("salts")).first()[0]) or real(df, hot))
    got = rows(neighbours.knn(dense, corpus, hot_vehicles(corpus, 1)))
    cores = spark.sparkContext.defaultParallelism
    assert hot_vehicles(corpus, 1).agg(F.max("salts")).first()[0] > 2 * cores >= seen[0]
    assert got == rows(neighbours.knn(dense, corpus, None))


def test_tasks_of_postings_follow_the_length_of_the_texts(spark, monkeypatch):
    corpus, _, _ = random_corpus(spark, 200, 3)
    whole = rows(postings.build_postings(corpus))
    monkeypatch.setattr(postings, "CHARS_PER_TASK", 100)
    many = postings.build_postings(corpus)
    chars = corpus.agg(F.sum(F.length("text"))).first()[0]
    assert many.rdd.getNumPartitions() == -(-chars // 100) > 4
    assert rows(many) == whole


def test_distinct_terms_are_counted_without_a_row_for_each(spark):
    words = [f"word{k}" for k in range(150)]
    plain = spark.createDataFrame([record(i, 1, f"n{i}", "A", None, " ".join(words[:i] * 2)) for i in (3, 63, 64, 150)], CORPUS)
    one = spark.createDataFrame([(1, None, None, None)], VEHICLE)
    asked = spark.createDataFrame([ask(1, " ".join(words), scope="all", trims="allTrims")], QUERY)
    terms = postings.query_terms(filters.own_fit(asked, one), max_terms=None)
    scores = postings.sparse_scores(postings.match_terms(terms, postings.tokens_of(plain), None), "distinct")
    assert rows(scores) == [(1, 150, 150), (1, 3, 3), (1, 63, 63), (1, 64, 64)]
    plan_ = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan_ and "Aggregate [query_id#" in plan_ and not any("lexeme#" in line for line in plan_.splitlines() if "Aggregate" in line)


def test_a_block_of_short_texts_stays_shut_whatever_its_words(spark):
    """Each block holds every word; only long texts hold them all."""
    words = [f"word{k}" for k in range(40)]
    plain = spark.createDataFrame([record(i, 1, f"n{i}", "A", None, " ".join(words if i >= 590 else (words * 2)[i % 40:i % 40 + 2]))
                                   for i in range(600)], CORPUS)
    one = spark.createDataFrame([(1, None, None, None)], VEHICLE)
    asked = filters.own_fit(validation.validate_queries(spark.createDataFrame([ask(1, " ".join(words))], QUERY), None)[0], one)
    stored = cut_lineage(blocks.pack_blocks(plain, chunks_a_block=60))
    found = cut_lineage(blocks.block_scores(asked, stored, 3, max_terms=None))
    assert rows(blocks.rank_sparse(found, 3)) == rows(plan.sparse_ranking(asked, postings.tokens_of(plain), None, 3, max_terms=None))
    share = blocks.opened_share(found).first()
    assert share["opened"] <= 2 < 10 <= share["held"]


def test_blocks_of_one_pool_stay_shut_for_the_other(spark):
    corpus = spark.createDataFrame([record(i, 1, f"n{i}", "A", None, "lamp " * (1 + i % 7), kind="complaint" if i % 4 else "recall") for i in range(200)], CORPUS)
    one = spark.createDataFrame([(1, None, None, None)], VEHICLE)
    asked = filters.own_fit(validation.validate_queries(spark.createDataFrame([ask(1, "lamp", scope="campaigns")], QUERY))[0], one)
    stored = cut_lineage(blocks.pack_blocks(corpus, chunks_a_block=5))
    found = cut_lineage(blocks.block_scores(asked, stored, 200))
    assert found.count() == 50 and blocks.opened_share(found).first()["opened"] <= 12


def test_long_texts_are_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CHARS_A_BLOCK", 1000)
    corpus = spark.createDataFrame([record(i, 1, f"n{i}", "A", None, "lamp " * (100 if i < 20 else 1)) for i in range(60)], CORPUS)
    held = blocks.pack_blocks(corpus).select(F.explode("records.chunk_id").alias("chunk_id"), "block").collect()
    assert sorted(r["chunk_id"] for r in held) == list(range(60))
    assert len({r["block"] for r in held if r["chunk_id"] < 20}) >= 5


def test_words_cut_in_python_are_those_cut_by_spark(spark):
    draw = random.Random(4)
    plain = [chr(c) for part in wordlists._PLAIN for c in part if c]
    texts = [None, "", " \t", "It's İstanbul ABC The the été ß ÀÉ x", "Σίσυφος word", "日本"] + [
        "".join(draw.choice(plain) if draw.random() < 0.3 else draw.choice("abc DEF gh12 \t\n-\x85") for _ in range(draw.randrange(200))) for _ in range(300)]
    told = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", text.lexemes(F.col("t")).alias("all"), text.query_lexeme_array(F.col("t"), None).alias("asked"),
        F.transform(text.query_term_array(F.col("t"), None), lambda w: w["lexeme"]).alias("terms"), wordlists.is_plain(F.col("t")).alias("plain")).collect()
    assert sum(bool(r["plain"]) for r in told) == len(texts) - 3
    for r in told:
        assert r["asked"] == r["terms"]
        if r["plain"]:
            assert (wordlists.plain_lexemes(r["t"]), wordlists.plain_query_lexemes(r["t"])) == (r["all"], r["asked"])
