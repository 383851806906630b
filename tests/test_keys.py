"""Lookups of stored keys, against a set, and the files they open."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recordlens.sources import keys as stored_keys
from recordlens.sources.keys import StoredKeys
from recordlens.streaming import landing
from recordlens.suite import reports

SCHEMA = "vehicle long, external string"


def found(df):
    return sorted(((r["vehicle"], r["external"]) for r in df.collect()), key=str)


def files(path):
    return sum(1 for _ in Path(path).rglob("*.parquet"))


def test_lookups_equal_a_set(spark, tmp_path):
    keys = StoredKeys(spark, str(tmp_path / "k"), ["vehicle", "external"], SCHEMA, width=3, keys_a_file=16)
    held, draw = set(), lambda n, m: (n * 37 + m * 11) % 150
    for batch in range(7):
        rows = [(draw(batch, i) % 4 or None, None if i % 9 == 0 else f"x{draw(batch, i)}") for i in range(30)]
        asked = spark.createDataFrame(rows + rows[:5], SCHEMA)
        keys.merge(before=batch)
        assert found(keys.stored(asked)) == sorted(held & set(rows), key=str), batch
        new = set(rows) - held
        keys.add(spark.createDataFrame(sorted(new, key=str), SCHEMA), batch)
        keys.add(spark.createDataFrame(sorted(new, key=str), SCHEMA), batch)  # run again
        held |= new
        assert sum(r.keys for r in keys.runs()) == len(held)
    assert max(r.level for r in keys.runs()) == 1 and len(keys.runs()) < 5
    # A batch that is run again does not see itself.
    own = [r for r in keys.runs() if r.last == 6][0]
    assert keys.stored(spark.createDataFrame(sorted(held, key=str), SCHEMA), without=6).count() == len(held) - own.keys


def test_no_run_and_no_rows(spark, tmp_path):
    keys = StoredKeys(spark, str(tmp_path / "k"), ["vehicle", "external"], SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    assert keys.stored(none).count() == 0
    keys.add(none, 0)
    assert keys.stored(spark.createDataFrame([(1, "a")], SCHEMA)).count() == 0 and keys.opened == 0


def test_a_lookup_opens_few_files(spark, tmp_path):
    """A thousand new keys against a million: one in a thousand opens a file in vain."""
    keys = StoredKeys(spark, str(tmp_path / "k"), ["id"], "id long", keys_a_file=1 << 13)
    keys.add(spark.range(1_000_000), 0)
    assert keys.stored(spark.range(5_000_000, 5_001_000)).count() == 0
    assert keys.files == 128 and keys.opened <= 10, keys.opened
    # What is stored is found, and only its files are opened.
    assert keys.stored(spark.range(999_990, 1_000_010)).count() == 10
    assert keys.opened <= 11


def test_files_stay_few_over_many_batches(spark, tmp_path):
    keys = StoredKeys(spark, str(tmp_path / "k"), ["id"], "id long", width=3)
    for batch in range(10):
        keys.merge(before=batch)
        keys.add(spark.range(batch * 10, batch * 10 + 10), batch)
    assert len(keys.runs()) <= 2 + 2 + 1 and keys.stored(spark.range(200)).count() == 100
    assert keys.files == len([r for r in keys.runs() if r.keys])


def test_null_keys_land_once(spark, tmp_path):
    write = landing.insert_if_absent(str(tmp_path / "t"), ["k"], "seq")
    for batch in (0, 1):
        write(spark.createDataFrame([(None, batch), ("a", batch), ("a", batch + 1)], "k string, seq long"), batch)
    got = spark.read.parquet(str(tmp_path / "t")).select("k", "seq").orderBy(F.col("k").asc_nulls_first()).collect()
    assert [tuple(r) for r in got] == [(None, 0), ("a", 0)]


def test_small_files_of_keys_share_a_file_of_bitmaps(spark, tmp_path):
    keys = StoredKeys(spark, str(tmp_path / "k"), ["id"], "id long", width=2, keys_a_file=50)
    for batch in range(3):
        keys.merge(before=batch)
        keys.add(spark.range(batch * 3000, batch * 3000 + 3000), batch)
    assert files(tmp_path / "k" / "keys") > 3 * 60 and files(tmp_path / "k" / "bits") == 4  # three batches and a merge
    assert keys.stored(spark.range(2990, 9010)).count() == 6010


def test_a_lookup_lists_no_merged_runs(spark, tmp_path):
    keys = StoredKeys(spark, str(tmp_path / "k"), ["id"], "id long", width=2)
    for batch in range(2):
        keys.add(spark.range(batch * 10, batch * 10 + 10), batch)
    keys.merge(before=2)
    read = keys._read("keys", keys.runs(), "id long, digest long")
    assert [f for f in read.inputFiles() if "run=b" in f] == [] and read.count() == 20


def test_runs_of_the_earlier_layout_are_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "k")
    with monkeypatch.context() as m:
        m.setattr(stored_keys, "KEYS_A_FILE", 50)  # as many files of bitmaps as of keys
        StoredKeys(spark, path, ["id"], "id long", keys_a_file=50).add(spark.range(3000), 0)
    made = spark.read.parquet(f"{path}/_made").drop("of", "part_bits").collect()
    spark.createDataFrame(made, "name string, level int, first long, last long, keys long, block_bits int, file_bits int").write.mode(
        "overwrite").parquet(f"{path}/_made/of=b0")
    keys = StoredKeys(spark, path, ["id"], "id long", keys_a_file=50)
    assert keys.stored(spark.range(2000, 4000)).count() == 1000


def test_a_slice_lands_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """Each batch is still one slice, so later slices find what earlier ones hold."""
    rows = [(n, n % 7 or None, "ab"[n % 2]) for n in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr(
        "event_id", "TIMESTAMP_NTZ '2024-01-01' AS ts", "user_id", "event_type", "0.5D AS value", "'{}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    seen, real = [], landing.stream_landing

    def watched(spark, in_dir, *args, files_per_batch, **options):
        seen.append((files_per_batch, files(in_dir.removeprefix("file:"))))
        return real(spark, in_dir, *args, files_per_batch=files_per_batch, **options)

    monkeypatch.setattr(landing, "stream_landing", watched)
    monkeypatch.setattr(reports, "EVENTS_A_FILE", 20, raising=False)
    got = sorted(tuple(r) for r in reports.stream_landing_merged(spark, str(tmp_path)).collect() if r["user_id"] is not None)
    assert got == sorted({(u, e): (u, e, n) for n, u, e in reversed(rows) if u is not None}.values())
    (a_batch, landed), = seen
    assert a_batch == 1 + 480 // 120 and landed == 7 * a_batch
