"""What the corpus operators share: reading tables, Arrow passes over texts, the fold of a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text that a Python worker takes apart at once.
BYTES_AT_ONCE = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of crc32(doc_id as text); a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def over_batches(df: DataFrame, schema: str | T.StructType, work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                 size: int = BYTES_AT_ONCE) -> DataFrame:
    """``mapInArrow`` over slices of about ``size`` bytes, so a worker's memory follows the slice and not the batch.

    Slices differ in rows only: every row is in one slice, a row larger than ``size`` is a slice of its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in slices(batch, size):
                out = work(batch.slice(start, rows))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each slice; the last column is taken to be the large one."""
    n = batch.num_rows
    if not n or batch.nbytes <= size:
        yield 0, n
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths + 32)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
        yield start, stop - start
        start = stop


def kept_columns(df: DataFrame, made: list[str]) -> list[str]:
    """The input columns that an output column does not replace."""
    taken = {name.lower() for name in made}
    return [name for name in df.columns if name.lower() not in taken]


def fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[name] for name in names]


def one_text_each(docs: DataFrame, ids: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``_hash, _id, text`` of each sampled id that has a document; ``ids`` is ``_id, _hash``, bounded, and broadcast."""
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_read")).join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    return rows.groupBy("_hash", "_id").agg(F.min("_read").alias("text"))
