import base64
import glob
import hashlib
import io
import random

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from recordlens.llm import warc
from recordlens.llm.suite import op11_warc_bundles
from recordlens.session import scratch_folder

SCHEMA = "page_id long, url string, html string, payload string, key string, head string, record_type string"


def pages(count=300, seed=3):
    draw = random.Random(seed)
    bodies = ["", "<p>twice</p>", "é 日本 \r\n\r\n WARC/1.1 \x8f \x00", "x" * 40_000]
    rows = [(i, f"http://h{i % 7}.example/{i}", draw.choice([*bodies, *[f"<b>{draw.random()}</b>" * draw.randint(1, 90)] * 6]), *["clash"] * 4)
            for i in draw.sample(range(-20, 10_000), count)]
    return rows + [(10_001, None, None, *["clash"] * 4), (10_002, "http://a b\r\nX: y\x7f", None, *["clash"] * 4),
                   (None, "http://none", "<p>twice</p>", *["clash"] * 4), (None, None, "of null ids alone", *["clash"] * 4),
                   (None, "http://two", "of null ids alone", *["clash"] * 4), (10_003, "http://e", "", *["clash"] * 4),
                   *[(10_004, "http://same", "repeated row", *["clash"] * 4)] * 3, (10_005, "u", "y" * 3_000_000, *["clash"] * 4)]


def brute(rows, least=0):
    heads = {}
    for i, _, html, *_ in rows:
        heads.setdefault(html or "", []).append(i)
    out = []
    for i, _, html, *_ in rows:
        data, ids = (html or "").encode(), heads[html or ""]
        head = min((x for x in ids if x is not None), default=None)
        copy = len(data) >= least and i != head
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if copy else "response", head if copy else None))
    return sorted(out, key=str)


def read(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize(("least", "hot"), [(0, 100_000), (13, 100_000), (0, 3), (50_000, 1)])
def test_round_trip(spark, monkeypatch, least, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    monkeypatch.setattr(warc, "FRAME_BYTES", 9_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 20_000)
    rows = pages()
    path = scratch_folder(spark)
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4), path, least=least)
    back = warc.read_archives(spark, path)
    assert read(back) == brute(rows, least)
    held = [bytes(r["payload"]) for r in back.where("record_type = 'response'").collect()]
    kinds = [r[3] for r in brute(rows, least)]
    assert len(held) == kinds.count("response")
    assert set(held) == {(r[2] or "").encode() for r in rows}
    assert len(glob.glob(f"{path.removeprefix('file:')}/part-*")) > 2


def test_any_zstandard_reader_reads_a_bundle(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 5_000)
    rows = pages(60)
    path = scratch_folder(spark)
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    seen = 0
    for name in glob.glob(f"{path.removeprefix('file:')}/part-*"):
        data = open(name, "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        at = 0
        while at < len(whole):
            headers, block, at = warc.parse(whole, at)
            seen += headers["warc-type"] != "warcinfo"
            assert "\r" not in "".join(headers.values())
        frames = warc.frames_of(data)
        assert len(frames) > 3 and sum(size for _, size, _, _ in frames) + 8 + 12 * len(frames) + 9 == len(data)
    assert seen == len(rows)


def test_records_are_found_by_their_identifiers(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 9_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 30_000)
    rows = pages(200, 5)
    path = scratch_folder(spark)
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    places, back = warc.record_places(spark, path), warc.read_archives(spark, path)
    names = {r["record_id"] for r in back.collect()}
    assert {r["record_id"] for r in places.collect()} == names and places.count() == len(rows)
    some = sorted(names)[::9]
    wanted = places.where(F.col("record_id").isin(some))
    found = sorted(map(str, warc.read_records(spark, path, wanted).distinct().collect()))
    assert found == sorted(map(str, back.where(F.col("record_id").isin(some)).distinct().collect()))
    files = [r["file"] for r in wanted.where(F.col("record_id") == some[0]).select("file").distinct().collect()]
    assert warc.read_records(spark, files, wanted.where(F.col("record_id") == some[0])).count() == 1
    # Every revisit names the record that it refers to.
    refers = {warc._urn(warc.record_id(r["refers_to"], r["payload_digest"])) for r in back.where("record_type = 'revisit'").collect()}
    assert refers <= {r["record_id"] for r in back.where("record_type = 'response'").collect()} and refers


def test_damage_is_noticed():
    bundle = warc.Bundle(b"x" * 16, "1970-01-01T00:00:00Z")
    bundle.add(*warc.page_record(1, "u", b"payload", False, None, "1970-01-01T00:00:00Z"))
    data = bundle.close()
    start, size, length, checksum = warc.frames_of(data)[0]
    assert b"payload" in warc.content_of(data[start:start + size], length, checksum)
    with pytest.raises(ValueError):
        warc.content_of(data[start:start + size], length, checksum ^ 1)
    with pytest.raises(ValueError):
        warc.frames_of(data[:-1])
    _, record = warc.page_record(1, "u", b"payload", False, None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc._page(*warc.parse(record.replace(b"payload\r\n", b"dayloap\r\n"))[:2])


def test_empty_table(spark):
    path = scratch_folder(spark)
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).count() == 0 == warc.record_places(spark, path).count()


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    cursor = con.execute(warc.ORACLE)
    got = op11_warc_bundles(spark, "/root/testdata/sf0.001")
    assert got.columns == [c[0] for c in cursor.description]
    assert read(got) == sorted(cursor.fetchall(), key=str)
