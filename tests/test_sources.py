import json
import zipfile
from datetime import date
from decimal import Decimal

import pytest
from frames import rows
from pyspark.sql import functions as F

from recordlens.functions.jsonfields import object_fields, read_text
from recordlens.sources import feeds, flatfile, tables

COMPLAINTS = [
    {"odiNumber": 700 + k % 5, "components": f"PART {k}", "summary": f"Text {k}\nof two lines.", "dateComplaintFiled": day, "vin": " V1" * (k % 2), "crash": False}
    for k, day in enumerate(["02/13/2003", "13/02/2003", "12/31/1999", "31/12/1999", "", "02/13/2003"])
]
COMPLAINTS[1]["odiNumber"] = "701"
FILED = [date(2003, 2, 13), date(2003, 2, 13), date(1999, 12, 31), date(1999, 12, 31), None, date(2003, 2, 13)]


def land(folder, name, payload):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(payload if isinstance(payload, str) else json.dumps(payload))
    return str(folder)


def test_tolerant_fields(spark):
    df = spark.createDataFrame(
        [('{"A": 1.5, "b": true, "C": "x", "d": [1], "e": null, "F": {"q": 1}, "g": "true"}',), ("nope",), ("[1]",)], "j string")
    read = df.select(*[read_text(object_fields(F.col("j")), n).alias(n) for n in "abcdefgh"]).collect()
    assert tuple(read[0]) == ("1.5", "True", "x", "", "", "", "true", "")
    assert tuple(read[1]) == tuple(read[2]) == ("",) * 8


def test_complaints(spark, tmp_path):
    path = land(tmp_path / "c", "a.json", {"count": 3, "results": COMPLAINTS})
    land(tmp_path / "c", "b.json", {"count": 0, "RESULTS": "none"})
    got = feeds.read_complaints(spark, path).orderBy("feed_order").collect()
    assert [(r["odi_number"], r["filed_on"]) for r in got] == [(str(c["odiNumber"]), day) for c, day in zip(COMPLAINTS, FILED, strict=True)]
    assert [r["summary"] for r in got] == [c["summary"] for c in COMPLAINTS] and [json.loads(r["raw"]) for r in got] == COMPLAINTS
    assert feeds.read_envelopes(spark, path).count() == 2


def test_recalls(spark, tmp_path):
    found = [{"NHTSACampaignNumber": f"n{k}", "ReportReceivedDate": day, "Component": "PART", "Summary": "What.", **more}
             for k, (day, more) in enumerate([("05/04/2001", {"Consequence": "So.", "Remedy": "Thus.", "parkIt": True}), ("23/05/2001", {}), ("05/23/2001", {"Remedy": ""})])]
    path = land(tmp_path / "r", "a.json", {"Count": 3, "results": found})
    assert rows(feeds.read_recalls(spark, path), "campaign_number", "received_on", "remedy") == [
        ("n0", date(2001, 5, 4), "Thus."), ("n1", date(2001, 5, 23), ""), ("n2", date(2001, 5, 23), "")]


@pytest.mark.parametrize("status, body, outcome", [
    (400, '{"results": []}', "empty"), (200, '{"Results": []}', "empty"), (400, None, "failed"), (400, "  ", "failed"),
    (400, "<html>", "failed"), (400, '{"results": [{"a": 1}]}', "failed"), (400, "[]", "failed"), (400, '{"a": 1}', "failed"),
    (400, '{"results": null}', "failed"), (200, '{"results": [{"a": 1}]}', "rows"), (200, "<html>", "failed"),
])
def test_envelope_outcomes(spark, status, body, outcome):
    df = spark.createDataFrame([("p", status, body)], "path string, status int, body string")
    assert feeds.classify_envelopes(df).first()["outcome"] == outcome


def test_model_names(spark, tmp_path):
    path = land(tmp_path / "m", "a.json", {"results": [
        {"modelYear": str(y), "make": m, "model": n} for y, m, n in [(1971, "ACME", "ROVER"), (1971, "ACME", " rover"), (1972, "ACME", "K 2"), (1971, "ACME", " "), (1971, "ACME", "OX")]]})
    assert rows(feeds.read_model_names(spark, path)) == [("ACME", 1971, "OX"), ("ACME", 1971, "ROVER"), ("ACME", 1972, "K 2")]


def test_vin_decodes(spark, tmp_path):
    answers = {f"D{k}": [{"Trim": trim, "DisplacementL": litres, "EngineCylinders": cylinders, "ErrorCode": "0"}] * many
               for k, (trim, litres, cylinders, many) in enumerate([("Harbour-Long", "1.6", "3", 2), ("  ", "2.25", "6", 1), ("Short", "none", "", 1), ("x", "1", "2", 0)])}
    for key, found in answers.items():
        land(tmp_path / "v" / f"descriptor={key}" / "model_year=1971", "a.json", {"Count": len(found), "Results": found})
    got = feeds.read_vin_decodes(spark, str(tmp_path / "v"))
    assert rows(got, "descriptor", "model_year", "trim", "engine_litres", "engine_cylinders") == [
        ("D0", 1971, "Harbour-Long", Decimal("1.6"), 3), ("D1", 1971, None, Decimal("2.3"), 6), ("D2", 1971, "Short", None, None), ("D3", 1971, None, None, None)]


def test_registry(spark, tmp_path):
    path = land(tmp_path / "s", "settings.json", {"Registry": {"Vehicles": [
        {"Make": "Acme", "NhtsaModel": "Rover", "ModelYear": 1971, "DisplayName": "The first", "Vin": None},
        {"Make": "acme", "Model": "k 2 long", "RecallModel": "K 2", "ModelYear": 1972, "DisplayName": "\tThe second "}]}})
    got = feeds.read_registry(spark, path)
    assert rows(got, "make", "model", "recall_model", "model_year", "display_name", "vin") == [
        ("ACME", "K 2 LONG", "K 2", 1972, "The second", None), ("ACME", "ROVER", None, 1971, "The first", None)]
    assert feeds.find_by_display_name(got, "  the SECOND ").first()["model_year"] == 1972


GOOD = [(f"a{k}", f"PART {k}", closed, campaign, text) for k, (closed, campaign, text) in enumerate(
    [("", "", "plain"), ("19760229", "c1", "with é and\ta tab"), ("19761231", " ", "blank at its end ")])]
LINES = ["\t".join([action, "ACME", "ROVER", "1971", part, "ACME", "19740301", closed, campaign, "Subject", text]) for action, part, closed, campaign, text in GOOD]
LINES[1:1] = ["only\ttwo", "", "\t".join(["a9", "ACME", "ROVER", "no year", "PART", "ACME", "", "", "", "S", "T"])]


def check_rows(df):
    got = df.orderBy("feed_order").collect()
    assert [(r["action_number"], r["summary"], r["campaign_number"]) for r in got] == [(a, text.strip(), c.strip()) for a, _, _, c, text in GOOD]
    assert [r["raw_line"] for r in got] == [LINES[0], *LINES[4:]]
    assert [r["closed_on"] for r in got] == [None, date(1976, 2, 29), date(1976, 12, 31)]


def test_flat_file_plain_and_zipped(spark, tmp_path):
    content = "\r\n".join(LINES).encode("latin-1")
    (tmp_path / "inv.txt").write_bytes(content)
    with zipfile.ZipFile(tmp_path / "inv.zip", "w") as z:
        z.writestr("FLAT_INV.txt", content)
        z.writestr("second.txt", "EA1\tFORD\tX\t2012\tA\tB\t\t\t\tS\tT")
    check_rows(flatfile.read_investigations(spark, str(tmp_path / "inv.txt")))
    check_rows(flatfile.read_investigations(spark, str(tmp_path / "inv.zip")))


def test_flat_file_order_over_splits(spark, tmp_path):
    lines = [f"A{i}\tM\tX\t2012\tC\tF\t\t\t\tS\t{'t' * 200}" for i in range(5000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = flatfile.read_investigations(spark, str(tmp_path / "big.txt"))
        assert got.rdd.getNumPartitions() > 4
        assert [r["action_number"] for r in got.orderBy("feed_order").collect()] == [f"A{i}" for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_zip_without_entries_fails(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    with pytest.raises(Exception, match="no entries"):
        flatfile.read_zip_lines(spark, str(tmp_path / "none.zip")).collect()


def test_loads_are_seen_whole(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "id long"
    assert tables.read_table(spark, root, "docs", schema).count() == 0
    first = spark.range(3)
    first.write.parquet(f"{root}/docs/load_id=a")
    assert tables.read_table(spark, root, "docs", schema).count() == 0, "no commit row yet"
    tables.write_load({"docs": first}, root, "a")
    tables.write_load({"docs": spark.range(3, 5)}, root, "b")
    tables.write_load({"docs": first}, root, "a")
    assert sorted(r["id"] for r in tables.read_table(spark, root, "docs", schema).collect()) == [0, 1, 2, 3, 4]
    assert tables.read_table(spark, root, "docs", schema, without="b").count() == 3


def test_upsert_registry_fills_a_missing_vin(spark):
    schema = "make string, model string, model_year int, display_name string, vin string"
    old = spark.createDataFrame([("F", "X", 2013, "old", None), ("F", "Y", 2013, "y", "V0")], schema)
    new = spark.createDataFrame([("F", "X", 2013, "new", "V1"), ("F", "Y", 2013, "n", "V2"), ("F", "Z", 2013, "z", None)], schema)
    assert rows(tables.upsert_registry(old, new), "model", "display_name", "vin") == [
        ("X", "old", "V1"), ("Y", "y", "V0"), ("Z", "z", None)]


def test_colliding_ids_are_reported(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "document_id long, k string")
    assert rows(tables.colliding_ids(df, "document_id")) == [(1, 2)]


def test_a_repeated_key_loses_nothing(spark):
    body = '{"results": [{"odiNumber": 1.50, "summary": "one", "summary": "two"}, {"odiNumber": 2, "summary": "x"}], "results": []}'
    got = feeds.complaints_from(spark.createDataFrame([("p", body)], "path string, body string")).orderBy("feed_order").collect()
    assert [(r["odi_number"], r["summary"]) for r in got] == [("1.50", "one"), ("2", "x")]
    assert got[0]["raw"] == '{"odiNumber": 1.50, "summary": "one", "summary": "two"}'


def test_a_large_response_is_read_whole(spark):
    one = '{"odiNumber": 7, "summary": "' + "s" * 100_000 + '"}'
    df = spark.createDataFrame([("p", "{\"results\": [" + ",".join([one] * 60) + "]}")], "path string, body string")
    assert feeds.complaints_from(df).where("length(summary) = 100000").count() == 60


def test_rejected_envelopes(spark):
    df = spark.createDataFrame([("a", '{"results": []}'), ("b", "<html>"), ("c", '{"results": 5}'), ("d", None), ("e", "[1, 2")],
                               "path string, body string")
    assert rows(feeds.rejected_envelopes(df)) == [
        ("b", feeds.NOT_JSON), ("c", feeds.NO_RESULTS), ("d", feeds.NOT_JSON), ("e", feeds.NOT_JSON)]


def test_any_byte_may_be_in_a_line(spark, tmp_path):
    (tmp_path / "odd.txt").write_bytes(b"A1\tM\tX\t2012\tC\tF\t\t\t\tS\ttwo\x01three \xe9 \xff\n")
    assert flatfile.read_investigations(spark, str(tmp_path / "odd.txt")).first()["summary"] == "two\x01three \xe9 \xff"


def test_elements_leave_the_worker_as_they_are_cut(spark):
    """A response is no row of all its elements: what a batch of responses holds is never made at once."""
    body = '{"results": [' + ", ".join(f'{{"odiNumber": {k}, "summary": "{"x" * 3000}"}}' for k in range(900)) + "]}"
    landed = spark.createDataFrame([("a", body), ("b", '{"results": 3}'), ("c", None), ("d", '{"Results": [7]}')], "path string, body string")
    found = feeds.record_fields(landed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Generate" not in plan
    seqs = sorted((r["p"], r["s"]) for r in found.select(F.col("feed_order.path").alias("p"), F.col("feed_order.seq").alias("s")).collect())
    assert seqs == [*(("a", k) for k in range(900)), ("d", 0)]
    assert found.where("raw = '7'").first()["fields"] is None
