"""Which natural keys a growing table holds, without reading the table.

Beside the table lies a folder of *runs*: the keys of a batch, sorted by their hash in
files of a bounded number of keys, and bitmaps that say which hashes a run may hold, in files
of ``KEYS_A_FILE`` keys however few the others hold.  A lookup reads the bitmaps of its own hashes' blocks and then opens only the files in which
a bitmap found something.  Runs of one level are merged when there are ``width`` of them,
so there are fewer than ``width`` runs a level, and a key is written again once a level.

A run counts once a row under ``_made`` says so; a merged run stands for all runs of lower
levels whose batches it covers, so a merge that fails half way changes nothing.
"""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .tables import read_or_empty

KEYS_A_FILE = 1 << 20
# Hashes of one bitmap block: two bitmaps of 32,768 bits, so an absent key is met in both for one in a thousand.
KEYS_A_BLOCK = 1 << 10
RUNS_A_LEVEL = 8
# File numbers named in a plan; a lookup that needs more reads all files of its runs.
MOST_NAMED = 10_000
_MADE = "name string, level int, first long, last long, keys long, block_bits int, file_bits int, part_bits int"


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    first: int
    last: int
    keys: int
    block_bits: int
    file_bits: int
    part_bits: int  # of the files of bitmaps


def _top(digest: Column, bits: int) -> Column:
    """The highest bits of a hash, as a number."""
    return F.shiftrightunsigned(digest, 64 - bits) if bits else F.lit(0).cast("long")


def _bit_is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


class StoredKeys:
    """The keys of one table, by runs under ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str,
                 width: int = RUNS_A_LEVEL, keys_a_file: int = KEYS_A_FILE):
        self.spark, self.path, self.keys, self.schema = spark, path, keys, schema
        self.width, self.keys_a_file = width, keys_a_file
        self.opened = self.files = 0  # of the last lookup

    def runs(self, without: int | None = None) -> list[Run]:
        """The runs that count, a few for each level; ``without`` leaves out a batch's own."""
        # Earlier runs have a file of bitmaps for each file of keys.
        made = {Run(**r.asDict()) for r in read_or_empty(self.spark, f"{self.path}/_made", _MADE).drop("of").withColumn(
            "part_bits", F.coalesce("part_bits", "file_bits")).collect()}
        live = [r for r in made if not any(
            o.level > r.level and o.first <= r.first and r.last <= o.last for o in made)]
        return sorted((r for r in live if without is None or r.first != without or r.last != without), key=lambda r: r.first)

    def stored(self, asked: DataFrame, without: int | None = None) -> DataFrame:
        """The asked keys that a run holds, each once; null keys are equal to each other."""
        runs = [r for r in self.runs(without) if r.keys]
        self.files, self.opened = sum(1 << r.file_bits for r in runs), 0
        hashed = asked.select(*self.keys).distinct().withColumn("digest", F.xxhash64(*self.keys))
        if not runs:
            return hashed.limit(0).select(*self.keys)
        hashed = cut_lineage(hashed)  # a batch is read once, not for each use of its keys
        places = F.array(*[F.struct(F.lit(r.name).alias("run"), _top(F.col("digest"), r.block_bits).alias("block"),
                                    _top(F.col("digest"), r.part_bits).cast("int").alias("part"),
                                    _top(F.col("digest"), r.file_bits).cast("int").alias("file")) for r in runs])
        probes = hashed.select(*self.keys, "digest", F.explode(places).alias("p")).select(*self.keys, "digest", "p.*")
        _, touched = self._named(probes.select("run", F.col("part").alias("file")))
        bitmaps = self._read("bits", runs, "block long, low binary, high binary").where(touched).withColumnRenamed("file", "part")
        met = cut_lineage(probes.join(bitmaps, ["run", "part", "block"]).where(
            _bit_is_set(F.col("low"), F.col("digest").bitwiseAND(32767))
            & _bit_is_set(F.col("high"), F.shiftright("digest", 15).bitwiseAND(32767))
        ).select("run", "file", "digest", *self.keys))
        count, wanted = self._named(met)
        if not count:
            return hashed.limit(0).select(*self.keys)
        rows = self._read("keys", runs, f"{self.schema}, digest long").where(wanted)
        self.opened = min(count, self.files)
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.keys]
        on = (F.col("a.run") == F.col("b.run")) & (F.col("a.digest") == F.col("b.digest"))
        for one in same:
            on = on & one
        return met.alias("a").join(rows.alias("b"), on, "left_semi").select(*self.keys).distinct()

    def add(self, new: DataFrame, batch_id: int) -> None:
        """Enter the keys of a batch; entered again they replace themselves."""
        rows = new.select(*self.keys).withColumn("digest", F.xxhash64(*self.keys))
        self._write(rows, rows.count(), f"b{batch_id}", 0, batch_id, batch_id)

    def merge(self, before: int) -> None:
        """Merge the levels that are full, looking only at batches before ``before``."""
        level = 0
        while True:
            runs = [r for r in self.runs() if r.last < before]
            if level > max((r.level for r in runs), default=-1):
                return
            full = [r for r in runs if r.level == level]
            if len(full) >= self.width:
                first, last = full[0].first, full[-1].last
                rows = self._read("keys", full, f"{self.schema}, digest long").select(*self.keys, "digest")
                self._write(rows, sum(r.keys for r in full), f"m{level + 1}-{first}-{last}", level + 1, first, last)
            level += 1

    def _named(self, probes: DataFrame) -> tuple[int, Column]:
        """How many files the probes fall into, and the condition that reads no others; beyond ``MOST_NAMED`` it reads all."""
        named = probes.select("run", "file").distinct().limit(MOST_NAMED + 1).collect()
        if len(named) > MOST_NAMED:
            return self.files, F.lit(True)
        by_run: dict[str, list[int]] = {}
        for r in named:
            by_run.setdefault(r["run"], []).append(r["file"])
        wanted = F.lit(False)
        for run, files in sorted(by_run.items()):
            wanted = wanted | ((F.col("run") == run) & F.col("file").isin(files))
        return len(named), wanted

    def _read(self, part: str, runs: list[Run], schema: str) -> DataFrame:
        """What these runs hold; the folders of others are not even listed."""
        schema = f"{schema}, run string, file int"
        held = [f"{self.path}/{part}/run={r.name}" for r in runs if r.keys]
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*held)

    def _write(self, rows: DataFrame, count: int, name: str, level: int, first: int, last: int) -> None:
        bits = lambda size: max(0, math.ceil(math.log2(max(1, count / size))))
        run = Run(name, level, first, last, count, bits(KEYS_A_BLOCK), bits(self.keys_a_file), bits(KEYS_A_FILE))
        placed = rows.withColumn("file", _top(F.col("digest"), run.file_bits).cast("int"))
        placed.repartition("file").sortWithinPartitions("file", "digest").write.mode("overwrite").partitionBy("file").parquet(
            f"{self.path}/keys/run={name}")
        bitmaps = rows.groupBy(_top(F.col("digest"), run.part_bits).cast("int").alias("file"), _top(F.col("digest"), run.block_bits).alias("block")).agg(
            F.bitmap_construct_agg(F.col("digest").bitwiseAND(32767)).alias("low"),
            F.bitmap_construct_agg(F.shiftright("digest", 15).bitwiseAND(32767)).alias("high"))
        bitmaps.repartition("file").sortWithinPartitions("file", "block").write.mode("overwrite").partitionBy("file").parquet(
            f"{self.path}/bits/run={name}")
        self.spark.createDataFrame([astuple(run)], _MADE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_made/of={name}")
