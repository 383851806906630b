import json
import random
from datetime import date, datetime, timedelta

import pytest
from frames import rows
from pyspark.sql import Window, functions as F

from recordlens.operators import catalog, ground_truth, metrics
from recordlens.operators.hits import chunk_context
from recordlens.operators.ranking import top_k
from recordlens.plans import evaluate as plan
from recordlens.plans.embed import hash_embedded
from recordlens.schemas import FIT
from recordlens.session import cut_lineage

DOCUMENT = ("document_id long, vehicle_id long, kind string, external_id string, component string, filed_on date, "
            f"title string, body string, {FIT}")
LINK = "investigation_document_id long, campaign_number string, component string, opened_on date, closed_on date"
PARTS = ["HOIST", "HOIST DRUM", "HOIST DRUM BRAKE", "HOIST DRUM BRAKE SHOE", "CABIN DOOR SENSOR LOOM", "CABIN", " CABIN", "hoist drum"]


def doc(i, kind, ext, component, filed, body="", vehicle=1):
    return (i, vehicle, kind, ext, component, filed, ext, body, None, None, None, None)


def drawn_day(draw, spread=900):
    return date(1990, 1, 1) + timedelta(days=draw.randrange(spread))


def drawn_records(seed, complaints=150, vehicles=3, investigations=12):
    """Documents and links drawn at random: undated ones, repeated and reversed windows, campaigns nobody stored."""
    draw = random.Random(seed)
    documents = [doc(k, "complaint", f"n{draw.randrange(10 ** 6)}", draw.choice(PARTS), draw.choice([None, *[drawn_day(draw)] * 9]),
                     vehicle=draw.randint(1, vehicles)) for k in range(complaints)]
    documents += [doc(1000 + k, "recall", f"r{k}", draw.choice(PARTS), drawn_day(draw), vehicle=draw.randint(1, vehicles)) for k in range(9)]
    documents += [doc(2000 + k, "investigation", f"i{draw.randrange(50)}", "", None, vehicle=draw.randint(1, vehicles)) for k in range(investigations)]
    links = {(2000 + draw.randrange(investigations), draw.choice(["", "gone", *[f"r{k}" for k in range(9)]]), draw.choice([*PARTS, " ", "H", "CAB "]),
              draw.choice([None, *[drawn_day(draw)] * 9]), draw.choice([None, drawn_day(draw), drawn_day(draw)])) for _ in range(60)}
    # One link of a key: its window is part of the link, not of the key.
    return documents, sorted({link[:3]: link for link in links}.values(), key=str)


def expected_truth(documents, links, per_link, prefix_len):
    """The rules as loops: the cases, and the relevant documents of each link."""
    by_id = {d[0]: d for d in documents}
    cases, relevant, matches = [], set(), 0
    for head, campaign, component, opened, closed in links:
        if not campaign:
            continue
        _, vehicle, _, name, *_ = by_id[head]
        relevant.add((head, campaign, component, head))
        relevant |= {(head, campaign, component, d[0]) for d in documents if d[1:4] == (vehicle, "recall", campaign)}
        prefix = component.strip()[:prefix_len]
        inside = sorted((d[3], d[0]) for d in documents if d[2] == "complaint" and d[1] == vehicle and prefix and d[4].startswith(prefix)
                        and opened and d[5] and opened <= d[5] and (closed is None or d[5] <= closed))
        matches += len(inside)
        cases += [(f"{name}:{ext}", head, campaign, component, i) for ext, i in inside[:per_link]]
    return sorted(cases), relevant, matches


def frames(spark, documents, links):
    return spark.createDataFrame(list(links), LINK), spark.createDataFrame(documents, DOCUMENT)


@pytest.mark.parametrize(("seed", "per_link", "prefix_len"), [(1, 20, 12), (2, 3, 40), (3, None, 5), (4, 1, 1)])
def test_ground_truth_equals_its_rules(spark, seed, per_link, prefix_len):
    documents, links = drawn_records(seed)
    l, d = frames(spark, documents, links)
    cases, relevant = ground_truth.build_ground_truth(l, d, per_link=per_link, prefix_len=prefix_len)
    named = ground_truth.scoped_links(l, d).select("link_id", "investigation_document_id", "campaign_number", "component")
    wanted, wanted_relevant, matches = expected_truth(documents, links, per_link, prefix_len)
    got = cases.join(named, "link_id").select("case_id", "investigation_document_id", "campaign_number", "component", "document_id")
    assert sorted(map(tuple, got.collect())) == wanted and wanted
    assert cases.select("case_row").distinct().count() == len(wanted)
    got = relevant.join(named, "link_id").select("investigation_document_id", "campaign_number", "component", "document_id")
    assert set(map(tuple, got.collect())) == wanted_relevant
    assert ground_truth.count_matches(l, d, prefix_len=prefix_len) == matches


def test_one_vehicle_alone(spark):
    documents, links = drawn_records(5)
    l, d = frames(spark, documents, links)
    mine = [x for x in links if next(d for d in documents if d[0] == x[0])[1] == 2]
    cases, _ = ground_truth.build_ground_truth(l, d, vehicle_id=2)
    assert sorted(r["case_id"] for r in cases.collect()) == [c[0] for c in expected_truth(documents, mine, 20, 12)[0]]
    assert ground_truth.count_matches(l, d, vehicle_id=2, prefix_len=12) == expected_truth(documents, mine, 20, 12)[2]


def window_tables(spark, complaints, links, seed=6):
    draw = random.Random(seed)
    found = [(draw.randint(1, 2), "PART", k, f"x{draw.randrange(10 ** 4)}", drawn_day(draw, 60)) for k in range(complaints)]
    asked = [(k, draw.randint(1, 2), "PART", drawn_day(draw, 60), draw.choice([None, drawn_day(draw, 80)])) for k in range(links)]
    return (spark.createDataFrame(asked, "link_id long, vehicle_id long, component string, opened_on date, closed_on date"),
            spark.createDataFrame(found, "vehicle_id long, component string, document_id long, external_id string, filed_on date"), asked, found)


def test_first_of_a_window_without_its_matches(spark, monkeypatch):
    """Ten times the complaints: more matches, but no more rows that meet the windows than days hold."""
    met = {}
    for size in (3_000, 30_000):
        links, complaints, asked, found = window_tables(spark, size, 80)
        wanted = sorted((k, i, e) for k, v, _, a, b in asked for e, i in sorted(
            (e, i) for u, _, i, e, day in found if u == v and a <= day and (b is None or day <= b))[:7])
        picked = ground_truth.first_in_window(links, complaints, 7)
        assert rows(picked, "link_id", "document_id", "external_id") == sorted(wanted, key=lambda r: tuple((True, str(v)) for v in r))
        met[size] = top_k(complaints, ["vehicle_id", "filed_on"], [F.asc("external_id")], 7, "pick").count()
        counted = dict(map(tuple, ground_truth.count_in_window(links, complaints).collect()))
        assert counted == {k: sum(u == v and a <= day and (b is None or day <= b) for u, _, _, _, day in found) for k, v, _, a, b in asked}
    assert met[30_000] <= 2 * 60 * 7 and met[3_000] <= met[30_000]
    # A vehicle with many links is spread over salts.
    monkeypatch.setattr(ground_truth, "LINKS_PER_SALT", 5)
    assert rows(ground_truth.first_in_window(links, complaints, 7)) == rows(picked)


@pytest.mark.parametrize("seed", [5, 6])
def test_whole_windows_are_counted_and_scored_without_a_row_a_case(spark, seed):
    """Repeated links and complaints too: as often as rows of cases would be."""
    documents, links = drawn_records(seed)
    documents += [d for d in documents if d[2] == "complaint"][:20]
    links += links[:4]
    l, d = frames(spark, documents, links)
    cases, relevant = ground_truth.build_ground_truth(l, d, per_link=None)
    asked, windows, dated, found = ground_truth.asked_in_windows(l, d)
    assert rows(found) == rows(relevant)
    assert rows(asked, "vehicle_id", "document_id", "cases") == rows(cases.groupBy("vehicle_id", "document_id").agg(F.count(F.lit(1)).alias("cases")))
    # Lists of documents drawn at random, of which some are relevant.
    queries = asked.select(F.col("document_id").alias("query_id"), F.lit("all").alias("scope"), "vehicle_id", "document_id")
    ids = relevant.select("document_id").distinct()
    ranked = cut_lineage(queries.select("query_id").crossJoin(ids).where("abs(hash(query_id, document_id)) % 3 = 0").select(
        "query_id", F.lit("sparse").alias("mode"), "document_id",
        F.row_number().over(Window.partitionBy("query_id").orderBy(F.hash("document_id", "query_id"), "document_id")).alias("rank")).where("rank <= 10"))
    of_cases = cases.select("case_row", "link_id", F.col("document_id").alias("query_id"))
    lists = ranked.join(relevant, "document_id").join(of_cases, ["link_id", "query_id"]).select(F.lit("all").alias("scope"), "mode", "case_row", "document_id", "rank")
    numbers = [F.round(c, 9).alias(c) for c in ("recall_at_5", "recall_at_10", "reciprocal_rank")]
    wanted = rows(metrics.per_case(lists, cases, relevant, ["scope", "mode"]), *numbers)
    got = plan.window_scores(ranked, queries, windows, dated, relevant)
    assert len(wanted) > 20 and rows(got, *numbers) == wanted
    assert got.select("link_id", "asked").distinct().count() == got.count()


def test_a_whole_evaluation_makes_no_row_a_case(spark, monkeypatch):
    monkeypatch.setattr(plan, "build_ground_truth", None)
    monkeypatch.setattr(plan, "case_rankings", None)
    assert all(r["scored"] == 6 for r in grid(spark).collect())


def test_ties_of_a_day_go_by_id(spark):
    complaints = spark.createDataFrame([(1, "P", k, "same", date(2001, 2, 3)) for k in range(9)],
                                       "vehicle_id long, component string, document_id long, external_id string, filed_on date")
    links = spark.createDataFrame([(5, 1, "P", date(2001, 2, 3), date(2001, 2, 3))],
                                  "link_id long, vehicle_id long, component string, opened_on date, closed_on date")
    assert rows(ground_truth.first_in_window(links, complaints, 3), "document_id", "pick") == [(0, 1), (1, 2), (2, 3)]
    assert ground_truth.first_in_window(links, complaints.where("false"), 3).count() == 0
    assert ground_truth.first_in_window(links.where("false"), complaints, 3).count() == 0


def test_links_in_order(spark):
    documents, links = drawn_records(7)
    names = {d[0]: (d[3], d[1]) for d in documents}
    got = ground_truth.ordered_links(*frames(spark, documents, links)).orderBy("pos").collect()
    wanted = sorted((names[i][0], part, campaign, names[i][1], i) for i, campaign, part, *_ in links if campaign)
    assert [(r["investigation_external_id"], r["component"], r["campaign_number"], r["vehicle_id"], r["investigation_document_id"]) for r in got] == wanted


def scored(spark, cases, relevant, rankings):
    """Averages of one mode, from lists."""
    c = spark.createDataFrame([(i, i) for i, _ in enumerate(cases)], "case_row long, link_id long")
    q = spark.createDataFrame([(i, d) for i, ds in enumerate(relevant) for d in ds], "link_id long, document_id long")
    seen, data = set(), []
    for i, ds in enumerate(rankings):
        rank = 0
        for d in ds:
            if (i, d) not in seen:
                seen.add((i, d))
                rank += 1
                data.append(("all", "sparse", i, d, rank))
    r = spark.createDataFrame(data, "scope string, mode string, case_row long, document_id long, rank int")
    row = metrics.summarise(r, c, q).where("key = 'sparse'").first()
    return row["recall_at_5"], row["recall_at_10"], row["mrr"], row["scored"], row["skipped"]


def test_metrics(spark):
    one = lambda found, relevant: scored(spark, ["a"], [relevant], [found])
    assert one([1, 2, 3, 4, 5, 6], [2, 6, 99])[:2] == pytest.approx((1 / 3, 2 / 3))
    assert one([2, 2, 2], [2, 3])[0] == 0.5
    assert one([10, 20, 30, 40], [30, 40])[2] == pytest.approx(1 / 3)
    assert one([], [1]) == (0, 0, 0, 1, 0)
    assert one([1, 2], []) == (0, 0, 0, 0, 1)
    got = scored(spark, "abc", [[1], [2, 3], []], [[9, 1], [2, 8, 18, 28, 38, 48, 58, 68, 78, 3], [5]])
    assert got == pytest.approx((0.75, 1.0, 0.75, 2, 1))


def test_recall_needs_a_positive_cutoff(spark):
    empty = spark.createDataFrame([], "case_row long, link_id long, document_id long, rank int")
    with pytest.raises(ValueError):
        metrics.recall_at_k(empty, empty, ["case_row"], 0)
    found = spark.createDataFrame([(1, 1, 7, 2), (1, 1, 8, 6)], "case_row long, link_id long, document_id long, rank int")
    relevant = spark.createDataFrame([(1, 7), (1, 8), (1, 9)], "link_id long, document_id long")
    assert rows(metrics.recall_at_k(found, relevant, ["case_row"], 5)) == [(1, pytest.approx(1 / 3))]


TOOTH = "GEAR TRAIN, SECOND STAGE"
SPAN = (date(1994, 3, 5), date(1994, 11, 20))
HEADS = [doc(1, "investigation", "i-1", TOOTH, SPAN[0], "A tooth of the second gear broke under load."),
         doc(2, "recall", "r-1", TOOTH, SPAN[1], "A tooth of the second gear may break under load.")]
ONE_LINK = ((1, "r-1", TOOTH, *SPAN),)


def alike(count, body):
    """The two heads, and complaints of the link's window."""
    return HEADS + [doc(50 + k, "complaint", f"n{k:03}", TOOTH, SPAN[0] + timedelta(days=3 * k), body(k)) for k in range(count)]


SIMILAR = alike(6, lambda k: f"A tooth of the gear broke under load {k}.")


def grid(spark, documents=SIMILAR, links=ONE_LINK, vectors=True, **options):
    l, d = frames(spark, documents, links)
    chunks = d.select(F.col("document_id").alias("chunk_id"), "document_id", F.col("body").alias("text"))
    corpus = chunk_context(chunks, d)
    vehicles = spark.createDataFrame([(1, None, None, None), (2, None, None, None)],
                                     "vehicle_id long, trim_key string, engine_litres decimal(4,1), engine_cylinders int")
    made = hash_embedded(chunks, 32)
    corpus = corpus.join(made, "chunk_id") if vectors else corpus.withColumn("embedding", F.lit(None).cast("array<float>"))
    asked = made.withColumnRenamed("chunk_id", "document_id") if vectors != "none" else None
    return plan.evaluate(l, d, vehicles, corpus, asked, **options)


def test_grid(spark):
    got = {r["key"]: r for r in grid(spark).collect()}
    assert set(got) == {"sparse", "dense", "hybrid", "campaignsSparse", "campaignsDense", "campaignsHybrid"}
    assert all(r["scored"] == 6 and r["skipped"] == 0 for r in got.values())
    for mode in ("Sparse", "Dense", "Hybrid"):
        assert got["campaigns" + mode]["recall_at_10"] == 1.0 >= got[mode.lower()]["recall_at_10"]
    assert rows(grid(spark)) == rows(grid(spark, small=False))


def test_grid_without_cases_or_vectors(spark):
    empty = grid(spark, links=[(1, "", TOOTH, *SPAN)]).collect()
    assert len(empty) == 6 and {r["skipped_reason"] for r in empty} == {metrics.NO_CASES}
    assert all(r["recall_at_5"] is None and r["scored"] is None for r in empty)
    for vectors, reason in ((False, "No chunk for this vehicle"), ("none", "No embedding provider")):
        got = {r["key"]: r for r in grid(spark, vectors=vectors).collect()}
        assert got["sparse"]["skipped_reason"] is None and got["sparse"]["scored"] == 6
        assert all(got[k]["skipped_reason"].startswith(reason) for k in ("dense", "hybrid", "campaignsDense"))


def test_long_cases_are_asked_unless_the_published_limit_holds(spark):
    long = [d[:7] + (d[7] + " gear" * 120,) + d[8:] if d[2] == "complaint" else d for d in SIMILAR]
    published = grid(spark, documents=long, settings=plan.PUBLISHED).collect()
    assert all(r["scored"] == r["not_asked"] == 6 and r["mrr"] == 0 for r in published)
    whole = {r["key"]: r for r in grid(spark, documents=long).collect()}
    assert all(r["not_asked"] == 0 for r in whole.values()) and whole["campaignsSparse"]["mrr"] > 0


def test_lists_are_kept_to_what_is_relevant_before_they_meet_the_cases(spark):
    l, d = frames(spark, SIMILAR, ONE_LINK)
    corpus = chunk_context(d.select(F.col("document_id").alias("chunk_id"), "document_id", F.col("body").alias("text")), d)
    vehicles = spark.createDataFrame([(1, None, None, None)], "vehicle_id long, trim_key string, engine_litres decimal(4,1), engine_cylinders int")
    cases, relevant = ground_truth.build_ground_truth(l, d)
    whole, _ = plan.case_rankings(cases, vehicles, corpus, None)
    kept, _ = plan.case_rankings(cases, vehicles, corpus, None, relevant=relevant)
    assert rows(kept) == rows(metrics.relevant_retrieved(whole, cases, relevant), *kept.columns) and whole.count() > kept.count() > 0
    # A match of a word is no row.
    assert "lexeme#" not in kept._jdf.queryExecution().executedPlan().toString()


def test_settings_reach_the_cases(spark):
    l, d = frames(spark, SIMILAR, ONE_LINK)
    assert ground_truth.build_ground_truth(l, d, per_link=2)[0].count() == 2
    assert ground_truth.build_ground_truth(l, d, per_link=None)[0].count() == 6
    assert ground_truth.build_ground_truth(l, d, prefix_len=40)[0].count() == 6


def test_an_evaluation_asks_every_complaint_with_all_its_terms(spark):
    filler = " ".join(f"filler{k}" for k in range(30))
    many = alike(25, lambda k: f"{filler} lastword")
    many[0], many[1] = (h[:7] + (text,) + h[8:] for h, text in zip(HEADS, ("Nothing of it.", "A lastword here.")))
    whole = {r["key"]: r for r in grid(spark, documents=many).collect()}
    assert all(r["scored"] == 25 and r["not_picked"] == 0 for r in whole.values())
    assert whole["campaignsSparse"]["mrr"] == 1.0  # the 31st term alone finds the recall
    capped = {r["key"]: r for r in grid(spark, documents=many, settings=plan.CAPPED).collect()}
    assert all(r["scored"] == 20 and r["not_picked"] == 5 for r in capped.values())
    assert capped["campaignsSparse"]["mrr"] == 0.0
    assert rows(grid(spark, documents=many)) == rows(grid(spark, documents=many, small=False))


def test_cases_without_a_vector_are_counted(spark):
    l, d = frames(spark, SIMILAR, ONE_LINK)
    cases, _ = ground_truth.build_ground_truth(l, d)
    some = spark.createDataFrame([(50, [1.0])], "document_id long, embedding array<float>")
    assert plan.count_without_vector(cases, some) == 5 and plan.count_without_vector(cases, None) == 6


def test_run_history(spark, tmp_path):
    results = grid(spark, vectors="none")
    run = plan.eval_run(results, 2, None, datetime(2026, 9, 6, 10)).collect()[0]
    stored = json.loads(run["metrics"])
    assert list(stored) == ["sparse", "dense", "hybrid", "campaignsSparse", "campaignsDense", "campaignsHybrid", "skipped"]
    assert stored["dense"] is None and stored["skipped"]["dense"] == plan.NO_PROVIDER
    assert stored["campaignsSparse"]["recallAt10"] == 1.0 and stored["sparse"]["scoredCaseCount"] == 6
    plan.append_eval_run(results, str(tmp_path / "runs"), 7, 1, datetime(2026, 9, 6), str(tmp_path / "results"))
    plan.append_eval_run(results, str(tmp_path / "runs"), 8, None, datetime(2026, 9, 7))
    assert rows(spark.read.parquet(str(tmp_path / "runs")), "run_id", "case_count") == [(7, 6), (8, 6)]
    assert spark.read.json(str(tmp_path / "results")).count() == 6
    history = spark.createDataFrame([(1, datetime(2026, 9, 5), "oops"), (2, datetime(2026, 9, 6), run["metrics"]),
                                     (3, datetime(2026, 9, 4), "{}")], "run_id long, ran_at timestamp, metrics string")
    got = catalog.latest_and_history(history, 2).orderBy(F.desc("ran_at")).collect()
    assert [(r["run_id"], r["is_latest"]) for r in got] == [(2, True), (1, False)]
    read = catalog.read_metrics(history).select("run_id", F.to_json("metrics").alias("m")).orderBy("run_id").collect()
    assert read[0]["m"] == "{}" and "campaignsSparse" in read[1]["m"]
