import json
import random
import zipfile
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from frames import rows
from pyspark.sql import functions as F

from recordlens.functions.vectors import hash_embed
from recordlens.operators import catalog, names
from recordlens.plans import decode, embed, load
from recordlens.schemas import FIT_COLUMNS, VEHICLES, VIN_DECODES
from recordlens.sources import feeds, flatfile, tables
from recordlens.streaming import landing

_draw = random.Random(41)
MAKE, MODEL, YEAR = "ACME", "ROVER", 1971
COMPLAINTS = [(str(_draw.randrange(14)), _draw.choice(["HOSE", "SEAT"]), _draw.choice(["", f"Report {k}."])) for k in range(30)]
RECALLS = [(f"c{k}", f"0{1 + k}/15/1975") for k in range(4)]
# Lines of other models and makes, repeated actions, actions with and without campaigns.
LINES = ["\t".join([f"a{_draw.randrange(6)}", make, model, str(year), part, make, "19740301", _draw.choice(["", "19750909"]), campaign, f"Subject {k}", f"Text {k}."])
         for k, (make, model, year, part, campaign) in enumerate(
             (_draw.choice([MAKE, MAKE, MAKE, "OTHER"]), _draw.choice([MODEL, MODEL, "K-2"]), _draw.choice([YEAR, YEAR, 1972]),
              _draw.choice(["HOSE", "SEAT", "HOSE:CLAMP"]), _draw.choice(["", "c1", "c2"])) for _ in range(40))]
OWN_LINES = [x.split("\t") for x in LINES if x.split("\t")[1:4] == [MAKE, MODEL, str(YEAR)]]
NEW_COMPLAINTS = {i for i, _, text in COMPLAINTS if text}
ACTIONS = {x[0] for x in OWN_LINES}
LINKS = {(x[0], x[8], x[4]) for x in OWN_LINES if x[8]}


def fine(spark):
    return spark.createDataFrame([("p", "rows")], "path string, outcome string")


def vehicle(i, model, year, vin=None):
    return (i, MAKE, model, None, year, f"{year} {model}", vin, None, None, None, None)


@pytest.fixture
def feed(spark, tmp_path):
    folder = tmp_path / "feeds"
    (folder / "c").mkdir(parents=True)
    (folder / "r").mkdir()
    (folder / "c" / "a.json").write_text(json.dumps({"results": [
        {"odiNumber": i, "components": c, "summary": s, "dateComplaintFiled": "02/13/2003"} for i, c, s in COMPLAINTS]}))
    (folder / "r" / "a.json").write_text(json.dumps({"results": [
        {"NHTSACampaignNumber": n, "Component": "X", "Summary": "S.", "ReportReceivedDate": d} for n, d in RECALLS]}))
    with zipfile.ZipFile(folder / "inv.zip", "w") as z:
        z.writestr("FLAT_INV.txt", "\r\n".join(LINES))
    own = lambda df: df.withColumn("vehicle_id", F.lit(1).cast("long"))
    return (own(feeds.read_complaints(spark, str(folder / "c"))), own(feeds.read_recalls(spark, str(folder / "r"))),
            flatfile.read_investigations(spark, str(folder / "inv.zip")))


def report(df):
    r = df.first()
    return ((r["complaints_fetched"], r["complaints_new"], r["complaints_unchanged"]),
            (r["recalls_fetched"], r["recalls_new"], r["recalls_unchanged"]),
            (r["investigation_rows"], r["investigations_new"], r["links_created"]), r["chunks_created"])


def test_a_second_load_adds_nothing(spark, tmp_path, feed):
    vehicles = spark.createDataFrame([vehicle(1, MODEL, YEAR)], VEHICLES)
    root = str(tmp_path / "store")
    fetched, own = (len(COMPLAINTS), len(RECALLS), len(OWN_LINES)), (len(NEW_COMPLAINTS), len(RECALLS), len(ACTIONS), len(LINKS))
    everything = own[0] + own[1] + own[2]
    first = report(load.load_records(spark, root, "one", vehicles, *feed, outcomes=fine(spark)))
    assert first == ((fetched[0], own[0], 0), (fetched[1], own[1], 0), (fetched[2], own[2], own[3]), everything)
    second = report(load.load_records(spark, root, "two", vehicles, *feed, outcomes=fine(spark)))
    assert second == ((fetched[0], 0, own[0]), (fetched[1], 0, own[1]), (fetched[2], 0, 0), 0)
    # The first load again replaces itself.
    again = report(load.load_records(spark, root, "one", vehicles, *feed, outcomes=fine(spark)))
    assert again == first
    stored = load.stored_tables(spark, root)
    assert {k: v.count() for k, v in stored.items()} == {"documents": everything, "chunks": everything, "links": own[3]}
    assert tables.colliding_ids(stored["documents"], "document_id").count() == 0
    heads = {r["external_id"]: r["component"] for r in stored["documents"].where("kind = 'investigation'").collect()}
    assert heads == {a: "; ".join(dict.fromkeys(x[4] for x in OWN_LINES if x[0] == a)) for a in ACTIONS}
    named = stored["documents"].select(F.col("document_id").alias("investigation_document_id"), "external_id")
    links = stored["links"].join(named, "investigation_document_id").collect()
    assert {(r["external_id"], r["campaign_number"], r["component"]) for r in links} == LINKS and {r["opened_on"] for r in links} == {date(1974, 3, 1)}
    lines = tables.read_table(spark, root, "investigation_lines", "document_id long, raw_line string")
    assert sorted(r["raw_line"] for r in lines.collect()) == sorted("\t".join(x) for x in OWN_LINES)


def test_a_failed_feed_stores_nothing(spark, tmp_path, feed):
    vehicles = spark.createDataFrame([vehicle(1, MODEL, YEAR)], VEHICLES)
    root = str(tmp_path / "store")
    bad = spark.createDataFrame([("r/a.json", "failed"), ("c/a.json", "rows")], "path string, outcome string")
    with pytest.raises(load.FeedFailed, match="r/a.json"):
        load.load_records(spark, root, "one", vehicles, *feed, outcomes=bad)
    assert load.stored_tables(spark, root)["documents"].count() == 0


def test_ids_that_collide_stop_the_load(spark):
    schema = "document_id long, external_id string"
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema)
    tables.require_own_ids(new, spark.createDataFrame([(9, "z")], schema), "document_id")
    with pytest.raises(tables.IdsCollide, match="2"):
        tables.require_own_ids(new, spark.createDataFrame([(2, "z")], schema), "document_id")
    with pytest.raises(tables.IdsCollide, match="3"):
        tables.require_own_ids(new.union(spark.createDataFrame([(3, "d")], schema)), new.limit(0), "document_id")


def test_a_load_writes_bodies_once(spark, tmp_path, feed, monkeypatch):
    """Only the documents' own folder receives the complaint texts, and a repeated load writes none."""
    vehicles = spark.createDataFrame([vehicle(1, MODEL, YEAR)], VEHICLES)
    root, written = str(tmp_path / "store"), []
    keep = load.cut_lineage
    monkeypatch.setattr(load, "cut_lineage", lambda df: written.append(df.columns) or keep(df))
    load.load_records(spark, root, "one", vehicles, *feed, outcomes=fine(spark))
    # Beside the flat file's matched rows only keys are set down.
    assert [c for c in written if "raw_line" not in c] == [["vehicle_id", "kind", "external_id", "is_empty"]]
    load.load_records(spark, root, "two", vehicles, *feed, outcomes=fine(spark))
    assert spark.read.parquet(f"{root}/documents/load_id=two").count() == 0


def test_unlisted_models_are_left_out(spark, tmp_path, feed):
    vehicles = spark.createDataFrame([vehicle(1, MODEL, YEAR), vehicle(2, "ROAMER", YEAR)], VEHICLES)
    listed = spark.createDataFrame([(MAKE, YEAR, "rover"), (MAKE, YEAR, "OX")], "make string, model_year int, model string")
    known, unknown = names.split_known(vehicles, listed)
    assert known.first()["vehicle_id"] == 1 and unknown.first()["vehicle_id"] == 2
    load.load_records(spark, str(tmp_path / "s"), "one", vehicles, *feed, outcomes=fine(spark), model_names=listed)
    assert rows(load.stored_tables(spark, str(tmp_path / "s"))["documents"].select("vehicle_id").distinct()) == [(1,)]
    assert rows(names.suggestions(unknown, listed), "rank", "name") == [(1, "OX"), (2, "rover")]


CANDIDATES = ["MUSTANG", "MUSTANG MACH-E BEV BEV", "MUSTANG GTD", "BRONCO 2DR ICE", "BRONCO 4DR ICE", "BRONCO SPORT ICE", "F-150",
              "EXPLORER", "  ", "explorer"]


@pytest.mark.parametrize("typed, limit, want", [
    ("2026 Ford Mustang Mach-E GT", 1, ["MUSTANG MACH-E BEV BEV"]),
    ("Bronco", 3, ["BRONCO 2DR ICE", "BRONCO 4DR ICE", "BRONCO SPORT ICE"]),
    ("zzzzzz", 4, ["BRONCO 2DR ICE", "BRONCO 4DR ICE", "BRONCO SPORT ICE", "EXPLORER"]), ("", 2, ["BRONCO 2DR ICE", "BRONCO 4DR ICE"]),
    ("f_150", 5, ["F-150"]),
])
def test_suggestions(spark, typed, limit, want):
    t = spark.createDataFrame([("k", typed)], "scope string, typed string")
    c = spark.createDataFrame([("k", n) for n in CANDIDATES] + [("other", "ZZZZZZ")], "scope string, name string")
    got = names.suggest_names(t, c, ["scope"], limit).orderBy("rank").collect()
    assert [r["name"] for r in got] == want and all(r["more"] == 8 - len(want) for r in got)


def test_registrations(spark):
    from recordlens.operators import validation as v

    schema = "make string, model string, recall_model string, model_year int, display_name string, vin string"
    given = [(" ford ", "explorer", " ", 2013, " Sport ", "1ftfw1rj0pfb00000"), (" ", "x", None, 2013, "d", None),
             ("f", None, None, 2013, "d", None), ("f", "x", None, 2013, "", None), ("f", "x", None, 2013, "d", "short"),
             ("f", "x", None, 1948, "d", None), ("f", "x", None, 2028, "d", ""), ("f", "x", None, None, "d", "")]
    valid, rejects = v.validate_registrations(spark.createDataFrame(given, schema), 2026)
    assert rows(valid) == [("FORD", "EXPLORER", None, 2013, "Sport", "1FTFW1RJ0PFB00000")]
    year = v.YEAR_PROBLEM % (1949, 2027)
    assert sorted(r["problem"] for r in rejects.collect()) == sorted(
        [v.MAKE_PROBLEM, v.MODEL_PROBLEM, v.NAME_PROBLEM, v.VIN_PROBLEM, year, year, year])


def test_decoding(spark):
    raw = ['{"vin": "1FM5K8D80DGA"}', '{"VIN": " 1fm5k8d85DG "}', '{"vin": ""}', "oops", '{"vin": "2FM5K8D80D"}']
    docs = spark.createDataFrame([(i, 1, "complaint", r) for i, r in enumerate(raw)] + [(9, 1, "recall", raw[0])],
                                 "document_id long, vehicle_id long, kind string, raw_payload string")
    vehicles = spark.createDataFrame([vehicle(1, "EXPLORER", 2013, "1FM5K8D80DGA00000"), vehicle(2, "EDGE", 2014)], VEHICLES)
    known = spark.createDataFrame([("1FM5K8D8", 2013, "Sport", "sport", Decimal("3.5"), 6)], VIN_DECODES)
    records = decode.described(docs, vehicles)
    assert rows(decode.descriptor_worklist(records, known)) == [("2FM5K8D8", 2013)]
    fitted = decode.with_fit(docs, vehicles, known)
    assert rows(fitted.where("trim is not null"), "document_id", "engine_cylinders") == [(0, 6), (1, 6)] and fitted.count() == 6
    own = spark.createDataFrame([(1, "Sport", "sport", Decimal("3.5"), 6), (2, "X", "x", None, None)],
                                "vehicle_id long, trim string, trim_key string, engine_litres decimal(4,1), engine_cylinders int")
    done = decode.decode_vehicles(vehicles, own)
    assert rows(done, "vehicle_id", "trim", "was_decoded") == [(1, "Sport", True), (2, None, False)]
    assert rows(decode.decode_report(records, done)) == [(2, 1, 3, 2)]
    assert rows(decode.decode_vehicles(done.drop("was_decoded"), own), "vehicle_id", "was_decoded") == [(1, False), (2, False)]


def test_decoding_asks_once(spark, tmp_path):
    raw = ['{"vin": "1FM5K8D80DGA"}', '{"vin": "1FM5K8D85DG"}', '{"vin": ""}', '{"vin": "2FM5K8D80D"}']
    docs = spark.createDataFrame([(i, 1, "complaint", r) for i, r in enumerate(raw)],
                                 "document_id long, vehicle_id long, kind string, raw_payload string")
    vehicles = spark.createDataFrame([vehicle(1, "EXPLORER", 2013)], VEHICLES)
    decoder = lambda asked: [("Sport", 3.5, 6) if d[0] == "1" else (" ", None, 0) for d, _ in asked]
    path = str(tmp_path / "decodes")
    fitted, report = decode.decode_records(docs, vehicles, path, decoder)
    assert rows(fitted, "document_id", "trim", "engine_litres") == [
        (0, "Sport", Decimal("3.5")), (1, "Sport", Decimal("3.5")), (2, None, None), (3, None, None)]
    assert rows(report) == [(1, 0, 3, 1)]
    assert spark.read.parquet(path).count() == 2
    decode.decode_records(docs, vehicles, path, lambda asked: 1 / 0 if asked else [])
    assert spark.read.parquet(path).count() == 2, "empty answers are remembered too"


def test_overlapping_decodes_are_one_answer(spark, tmp_path):
    """Two runs that asked at the same time, and one that is run again, repeat no record and no answer."""
    docs = spark.createDataFrame([(i, 1, "complaint", f'{{"vin": "{i % 2 + 1}FM5K8D80DGA"}}') for i in range(6)],
                                 "document_id long, vehicle_id long, kind string, raw_payload string")
    vehicles = spark.createDataFrame([vehicle(1, "EXPLORER", 2013)], VEHICLES)
    path = str(tmp_path / "decodes")
    decoder = lambda asked: [("Sport", 3.5, 6) for _ in asked]
    decode.decode_records(docs, vehicles, path, decoder, "b")
    spark.read.parquet(f"{path}/run_id=b").write.parquet(f"{path}/run_id=a")  # as if it had overlapped
    assert spark.read.parquet(path).count() == 4 and decode.read_decodes(spark, path).count() == 2
    fitted, _ = decode.decode_records(docs, vehicles, path, lambda asked: 1 / 0 if asked else [], "c")
    assert rows(fitted, "document_id", "trim") == [(i, "Sport") for i in range(6)]
    again, _ = decode.decode_records(docs, vehicles, path, decoder, "b")
    assert again.count() == 6 and decode.read_decodes(spark, path).count() == 2


def test_feed_rows_find_the_vehicle_that_asked(spark):
    vehicles = spark.createDataFrame([(1, "FORD", "F-150 SUPER CREW", "F-150", 2014), (2, "FORD", "EDGE", None, 2014)],
                                     "vehicle_id long, make string, model string, recall_model string, model_year int")
    feed = spark.createDataFrame([("FORD", "F-150", 2014, "a"), ("FORD", "EDGE", 2014, "b")],
                                 "make string, model string, model_year int, raw string")
    assert rows(load.for_vehicles(feed, vehicles, "recall_model"), "vehicle_id", "raw") == [(1, "a"), (2, "b")]
    assert rows(load.for_vehicles(feed, vehicles), "vehicle_id", "raw") == [(2, "b")]


eight = lambda texts: hash_embed(texts, 8)  # noqa: E731 - a lambda travels to the tasks by value


def test_backfill_resumes(spark, tmp_path):
    path = str(tmp_path / "vectors")
    chunks = spark.createDataFrame([(i, 1 + i % 2, f"text {i}") for i in range(140)], "chunk_id long, vehicle_id long, text string")
    vehicles = spark.createDataFrame([(1, "one"), (2, "two")], "vehicle_id long, display_name string")
    go = lambda run, name=None: rows(embed.backfill_embeddings(chunks, path, run, eight, vehicles, name, dim=8))[0]
    assert go("a", " one ") == (70, 0)
    assert go("b", "one") == (0, 0)
    assert go("c") == (70, 0)
    assert go("a", "one") == (70, 0), "a run again finds its own work"
    stored = spark.read.parquet(path)
    assert stored.count() == 140 and stored.select("chunk_id").distinct().count() == 140
    text = {r["chunk_id"]: r["embedding"] for r in stored.collect()}[7]
    assert text == pytest.approx(list(map(float, eight(["text 7"])[0])))


def test_backfill_resumes_at_the_slice_that_failed(spark, tmp_path):
    """The provider gives out at one text; the second start asks for no slice that was done, and for all others."""
    path, asked = str(tmp_path / "vectors"), spark.sparkContext.accumulator(0)
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "chunk_id long, text string")

    def broken(texts):
        if "text 150" in texts:
            raise RuntimeError("gave out")
        return eight(texts)

    def counting(texts):
        asked.add(len(texts))
        return eight(texts)

    with pytest.raises(Exception, match="gave out"):
        embed.backfill_embeddings(chunks, path, "r", broken, dim=8, slice_chunks=20)
    done = embed.committed_vectors(spark, path, "r").count()
    assert 0 < done < 200
    # More chunks have come in: the run's slices stay as they were dealt.
    more = chunks.unionByName(spark.createDataFrame([(500 + i, f"new {i}") for i in range(60)], "chunk_id long, text string"))
    embedded, remaining = rows(embed.backfill_embeddings(more, path, "r", counting, dim=8, slice_chunks=20))[0]
    assert asked.value == embedded - done and embedded + remaining == 260 and embedded >= 200
    assert rows(embed.backfill_embeddings(more, path, "s", counting, dim=8))[0] == (remaining, 0)
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("chunk_id").distinct().count() == 260


def test_providers_are_checked(spark):
    df = spark.createDataFrame([(i, "x") for i in range(5)], "chunk_id long, text string")
    with pytest.raises(ValueError, match="No embedding provider"):
        embed.embed(df, None)
    for bad in (lambda t: eight(t)[:-1], lambda t: hash_embed(t, 9)):
        with pytest.raises(Exception, match="misalign"):
            embed.embed(df, bad, 8).collect()
    sizes = embed.embed(spark.range(300).selectExpr("id as chunk_id", "'x' as text").coalesce(1),
                        lambda t: [[float(len(t))] * 8] * len(t), 8)
    assert sorted({r["embedding"][0] for r in sizes.collect()}) == [44.0, 128.0]
    with pytest.raises(Exception, match="expected width 9"):
        embed.check_vectors(embed.embed(df, eight, 8), 9).collect()


JOB = "job_id long, vehicle_id long, display_name string, state string, queued_at timestamp, finished_at timestamp"
NOW = datetime(2026, 9, 6, 12)


def job(i, v, state, hours):
    at = NOW - timedelta(hours=hours)
    return (i, v, f"vehicle {v}", state, at, at if state in ("succeeded", "failed") else None)


def test_staleness_and_reports(spark):
    vehicles = spark.createDataFrame([(i, f"vehicle {i}") for i in range(1, 7)], "vehicle_id long, display_name string")
    jobs = spark.createDataFrame([
        job(1, 2, "succeeded", 1), job(2, 3, "succeeded", 25), job(3, 4, "succeeded", 30), job(4, 4, "queued", 1),
        job(5, 5, "failed", 1), job(6, 6, "succeeded", 24), job(7, 6, "succeeded", 40), job(8, 2, "failed", 1)], JOB)
    stale = catalog.stale_scopes(vehicles, jobs, F.lit(NOW).cast("timestamp"))
    assert rows(stale, "vehicle_id") == [(1,), (3,), (5,), (6,)]
    assert rows(catalog.latest_load(jobs).where("vehicle_id = 2"), "job_id") == [(8,)]
    assert [r["job_id"] for r in catalog.recent_loads(jobs, 3).collect()] == [8, 5, 4]
    kept, outcome = catalog.dismiss(jobs, spark.createDataFrame([(1,), (4,), (99,), (1,)], "job_id long"))
    assert rows(outcome) == [(1, "dismissed"), (4, "still_running"), (99, "not_found")] and kept.count() == 7


def folded(events):
    """Apply events in order, refusing the backward ones."""
    level, state = 0, None
    for _, _, s, _ in sorted(events, key=lambda e: (e[3], e[1])):
        if catalog.STATE_LEVEL[s] > level:
            level, state = catalog.STATE_LEVEL[s], s
    return state


def test_states_never_go_back(spark, tmp_path):
    import random

    r = random.Random(2)
    states = ["queued", "running", "succeeded", "failed"]
    events = [(j, 10 * j + n, r.choice(states), datetime(2026, 1, 1, r.randrange(24))) for j in range(40) for n in range(r.randint(1, 6))]
    schema = "job_id long, event_id long, state string, at timestamp"
    want = sorted((j, folded([e for e in events if e[0] == j])) for j in range(40))
    df = spark.createDataFrame(events, schema)
    assert sorted(tuple(x) for x in catalog.load_state(df).select("job_id", "state").collect()) == want
    for part in range(4):
        df.where(F.pmod("event_id", F.lit(4)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = landing.read_landing(spark, str(tmp_path / "in"), schema, 1)
    landing.stream_state(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = landing.current_state(spark, str(tmp_path / "out")).select("job_id", "state").collect()
    assert sorted(tuple(x) for x in got) == want


def test_moves_from_a_state_that_ends(spark, tmp_path):
    """Thirty days of jobs, a file a day; events repeat, come late or move back, and silent jobs leave the state."""
    import random

    r = random.Random(8)
    states = ["queued", "running", "succeeded", "failed"]
    days = [[(d * 10 + j, 100 * d + 10 * j + n, r.choice(states), datetime(2026, 1, 1 + d, 2 + 4 * n + j % 3)) for j in range(10) for n in range(4)]
            for d in range(28)]
    for d in range(1, 28):
        late = [e for e in days[d - 1] if e[3].hour > 13]
        back = [(j, i + 50_000, "queued", at.replace(day=1 + d, hour=1)) for j, i, _, at in r.sample(days[max(0, d - 9)], 3)]
        days[d] += r.sample(late, 5) + back  # repeats of the day before, and moves back of jobs long gone
    events = [e for day in days for e in day] + [(999, 1, "no such state", datetime(2026, 1, 20))]
    schema = "job_id long, event_id long, state string, at timestamp"
    for day in days:
        spark.createDataFrame(day, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = landing.read_landing(spark, str(tmp_path / "in"), schema, 1)
    run = landing.stream_moves(stream, str(tmp_path / "out"), str(tmp_path / "ck"), keep="3 days", delay="1 day")
    run.awaitTermination()
    want = catalog.load_state(spark.createDataFrame(events, schema))
    assert rows(landing.reached_state(spark, str(tmp_path / "out")), "job_id", "state") == rows(want, "job_id", "state")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert held[-1] <= 75 < want.count() == 280 and max(held) <= 90, held  # three days and the delay of 13 jobs a day
    # Nothing new: a restart goes on from the checkpoint and changes nothing.
    landing.stream_moves(landing.read_landing(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out"), str(tmp_path / "ck"),
                         keep="3 days", delay="1 day").awaitTermination()
    assert rows(landing.reached_state(spark, str(tmp_path / "out")), "job_id", "state") == rows(want, "job_id", "state")


def test_landing_keeps_each_key_once(spark, tmp_path):
    schema = "external_id string, seq long, body string"
    put = lambda *found: spark.createDataFrame([(f"e{i}", s, f"{i}/{s}") for i, s in found], schema).coalesce(1).write.mode(
        "append").parquet(str(tmp_path / "in"))
    go = lambda: landing.stream_landing(
        spark, str(tmp_path / "in"), schema, str(tmp_path / "t"), ["external_id"], "seq", str(tmp_path / "ck"), 1).awaitTermination()
    put((0, 1), (1, 5), (1, 2))
    put((1, 0), (2, 3))
    go()
    put((0, 0), (3, 9))
    go()
    go()
    assert rows(spark.read.parquet(str(tmp_path / "t")), "external_id").__len__() == 4
    # A batch that is run again writes the same rows over itself.
    batch = spark.createDataFrame([("e0", 1, "0/1"), ("e9", 1, "9/1")], schema)
    write = landing.insert_if_absent(str(tmp_path / "t"), ["external_id"], "seq")
    write(batch, 77)
    write(batch, 77)
    assert spark.read.parquet(str(tmp_path / "t")).where("external_id = 'e9'").count() == 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_enrichment_failure_keeps_the_load(spark):
    done, said = [], []

    def broken(batch, batch_id):
        raise RuntimeError("decoder down")

    write = landing.enrich_batch(lambda b, i: done.append("load"), broken, lambda b, i: done.append("embed"), on_failure=said.append)
    write(spark.range(1), 3)
    assert done == ["load", "embed"] and said == ["batch 3: broken: decoder down"]
    with pytest.raises(RuntimeError):
        landing.enrich_batch(broken)(spark.range(1), 4)


def test_a_failed_enrichment_is_run_again_alone(spark, tmp_path):
    ledger = landing.Ledger(spark, str(tmp_path / "ledger"))
    calls, said = [], []

    def decode_rows(batch, batch_id):
        calls.append(("decode", batch_id, batch.count()))
        if len(calls) in (1, 3):  # batch 0 twice
            raise RuntimeError("decoder down")

    def embed_rows(batch, batch_id):
        calls.append(("embed", batch_id, batch.count()))

    write = landing.enrich_batch(lambda b, i: calls.append(("load", i, 0)) if i > 9 else None, decode_rows, embed_rows,
                                 on_failure=said.append, ledger=ledger, reload=lambda i: spark.range(10 + i))
    for batch_id in range(3):
        write(spark.range(3), batch_id)
    assert calls == [("decode", 0, 3), ("embed", 0, 3), ("decode", 0, 10), ("decode", 1, 3), ("embed", 1, 3),
                     ("decode", 0, 10), ("decode", 2, 3), ("embed", 2, 3)]
    assert rows(ledger.outcomes(), "batch_id", "stage", "outcome", "tries") == [
        (b, s, "done", 3 if (b, s) == (0, "decode_rows") else 1) for b in range(3) for s in ("decode_rows", "embed_rows")]
    assert len(said) == 2 and ledger.due() == []


def test_vehicle_list(spark):
    vehicles = spark.createDataFrame([vehicle(1, "EXPLORER", 2013), vehicle(2, "EDGE", 2012), vehicle(3, "BRONCO", 2013)], VEHICLES)
    docs = spark.createDataFrame([(1, "complaint"), (1, "complaint"), (1, "recall"), (2, "investigation")], "vehicle_id long, kind string")
    got = catalog.vehicle_list(vehicles, docs).collect()
    assert [(r["vehicle_id"], r["complaint"], r["recall"], r["investigation"]) for r in got] == [(2, 0, 0, 1), (3, 0, 0, 0), (1, 2, 1, 0)]
    assert set(FIT_COLUMNS) <= set(vehicles.columns)
