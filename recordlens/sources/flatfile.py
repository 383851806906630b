"""Scan of the investigations flat file, plain or zipped."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import compact_date
from ..functions.text import is_blank, trim_ws

COLUMN_COUNT = 11
ENCODING = "ISO-8859-1"
_BATCH = 20_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``feed_order, line`` of plain Latin-1 files; a large file is split among tasks.

    Each split starts at its own offset and numbers its lines upwards, so the
    offset and that number order the lines as the file does.
    """
    raw = spark.read.text(path)
    return raw.select(
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("feed_order"),
        F.decode(F.col("value").cast("binary"), ENCODING).alias("line"),  # the bytes as they are in the file
    )


def read_zip_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """``feed_order, line`` of the first entry of each archive, streamed out in batches.

    One archive is one task, because deflate cannot be entered in the middle;
    the lines are then spread over the cluster.
    """
    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    entries = archive.infolist()
                    if not entries:
                        raise ValueError(f"The archive {name} contains no entries.")
                    with archive.open(entries[0]) as entry:
                        text = io.TextIOWrapper(entry, encoding=ENCODING, newline=None)
                        held: list[str] = []
                        start = 0
                        for line in text:
                            held.append(line.rstrip("\n"))
                            if len(held) == _BATCH:
                                yield _lines(name, start, held)
                                start, held = start + len(held), []
                        if held:
                            yield _lines(name, start, held)

    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    lines = archives.mapInPandas(unzip, "path string, seq long, line string")
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(width).select(
        F.struct("path", F.lit(0).cast("long").alias("block"), "seq").alias("feed_order"), "line"
    )


def _lines(path: str, start: int, lines: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"path": path, "seq": range(start, start + len(lines)), "line": lines})


def parse_investigations(lines: DataFrame) -> DataFrame:
    """Eleven tab-separated columns; tabs past the eleventh belong to the summary."""
    col = lambda i: F.get(F.col("columns"), F.lit(i))
    return (
        lines.where(~is_blank(F.col("line")))
        .withColumn("columns", F.split("line", "\t", COLUMN_COUNT))
        .where((F.size("columns") == COLUMN_COUNT) & trim_ws(col(3)).try_cast("int").isNotNull())
        .select(
            "feed_order",
            trim_ws(col(0)).alias("action_number"),
            trim_ws(col(1)).alias("make"),
            trim_ws(col(2)).alias("model"),
            trim_ws(col(3)).try_cast("int").alias("model_year"),
            trim_ws(col(4)).alias("component"),
            trim_ws(col(5)).alias("manufacturer"),
            compact_date(col(6)).alias("opened_on"),
            compact_date(col(7)).alias("closed_on"),
            trim_ws(col(8)).alias("campaign_number"),
            trim_ws(col(9)).alias("subject"),
            trim_ws(col(10)).alias("summary"),
            F.col("line").alias("raw_line"),
        )
    )


def read_investigations(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the flat file; a path ending in ``.zip`` is read from the archive."""
    lines = read_zip_lines(spark, path) if path.endswith(".zip") else read_lines(spark, path)
    return parse_investigations(lines)
