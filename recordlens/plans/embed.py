"""Give vectors to chunks that have none, through a provider callable."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vectors import EMBEDDING_DIMENSIONS, hash_embed
from ..operators.sizing import spread
from ..schemas import EMBEDDINGS
from ..session import scratch_folder
from ..sources.tables import read_or_empty

# A picklable function from texts to one row of floats per text, in order.
Provider = Callable[[list[str]], np.ndarray]
MAX_BATCH = 128
# Chunks of a slice, which is what a failed run loses at most, and the most slices of a run.
SLICE_CHUNKS = 200_000
MOST_SLICES = 1_000


def require_provider(provider: Provider | None) -> Provider:
    if provider is None:
        from .evaluate import NO_PROVIDER

        raise ValueError(NO_PROVIDER)
    return provider


def embed(
    texts: DataFrame, provider: Provider | None, dim: int = EMBEDDING_DIMENSIONS,
    batch: int = MAX_BATCH, key: str = "chunk_id",
) -> DataFrame:
    """``<key>, embedding`` for ``<key>, text``; at most ``batch`` texts per request.

    The count and the width of what comes back are checked before it is used.
    """
    provider = require_provider(provider)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at:at + batch]
                vectors = np.asarray(provider(part["text"].tolist()), dtype=np.float32)
                if vectors.shape != (len(part), dim):
                    raise ValueError(
                        f"Asked for {len(part)} embeddings of width {dim} and received "
                        f"{vectors.shape}; storing them would misalign vectors and text."
                    )
                yield pd.DataFrame({key: part[key], "embedding": list(vectors)})

    return texts.select(key, "text").mapInPandas(run, f"{key} long, embedding array<float>")


def hash_embedded(texts: DataFrame, dim: int = EMBEDDING_DIMENSIONS, key: str = "chunk_id") -> DataFrame:
    """Repeatable stand-in vectors."""
    return embed(texts, lambda batch: hash_embed(batch, dim), dim, key=key)


def check_vectors(df: DataFrame, dim: int) -> DataFrame:
    """Fail the job on a vector of the wrong width."""
    width = F.size("embedding")
    fine = F.col("embedding").isNull() | (width == dim)
    wrong = F.concat(F.lit(f"expected width {dim}, got "), width.cast("string"))
    return df.withColumn("embedding", F.when(fine, F.col("embedding")).otherwise(F.raise_error(wrong)))


def with_embeddings(corpus: DataFrame, embeddings: DataFrame) -> DataFrame:
    """A corpus with each chunk's vector, null where it has none."""
    return corpus.join(embeddings.select("chunk_id", "embedding"), "chunk_id", "left")


def pending_chunks(
    chunks: DataFrame, embeddings: DataFrame, vehicles: DataFrame | None = None,
    display_name: str | None = None,
) -> DataFrame:
    """Chunks without a vector, of one vehicle when named.

    ``chunks`` carries ``vehicle_id`` when a display name is given.
    """
    pending = chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")
    if not display_name or vehicles is None:
        return pending
    named = vehicles.where(F.col("display_name") == display_name.strip()).select("vehicle_id")
    return pending.join(named, "vehicle_id", "left_semi")


def _stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, EMBEDDINGS + ", run_id string, slice int")


def _committed(spark: SparkSession, path: str, run_id: str) -> dict[int, int]:
    """The run's committed slices, each with the number of slices that the run was dealt into."""
    rows = read_or_empty(spark, f"{path}/_slices", "slices int, run_id string, slice int").where(F.col("run_id") == run_id)
    return {r["slice"]: r["slices"] for r in rows.collect()}  # at most MOST_SLICES


def committed_vectors(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The vectors of the run's committed slices."""
    rows = _stored_vectors(spark, path).where(F.col("run_id") == run_id)
    return rows.where(F.col("slice").isin(list(_committed(spark, path, run_id))))


def backfill_embeddings(
    chunks: DataFrame, path: str, run_id: str, provider: Provider | None,
    vehicles: DataFrame | None = None, display_name: str | None = None,
    dim: int = EMBEDDING_DIMENSIONS, batch: int = MAX_BATCH, slice_chunks: int = SLICE_CHUNKS,
) -> DataFrame:
    """Embed what is pending into the side table at ``path``; report embedded and remaining.

    What is pending is dealt into numbered slices by id.  Each slice is written and then
    entered in the ledger beside the table, so a run that fails and is started again under
    its id asks the provider for the slices that are not entered, and for no other.  Vectors
    are only ever added, and a later run goes on where the last one ended.
    """
    require_provider(provider)
    spark = chunks.sparkSession
    done = _committed(spark, path, run_id)
    stored = _stored_vectors(spark, path).where(F.col("run_id") != run_id)
    pending = pending_chunks(chunks, stored, vehicles, display_name).select("chunk_id", "text")
    # The number of slices is the run's, whatever is pending when it is started again.
    slices = next(iter(done.values())) if done else max(1, min(MOST_SLICES, math.ceil(pending.count() / slice_chunks)))
    dealt = pending.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.lit(slices)).cast("int"))
    if slices > len(done):
        # Written once by slice, so that a slice's job reads its own rows alone.
        folder = scratch_folder(spark)
        dealt.where(~F.col("slice").isin(list(done))).write.partitionBy("slice").parquet(folder)
        waiting = spark.read.schema("chunk_id long, text string, slice int").parquet(folder)
        for number in range(slices):
            if number not in done:
                # Each task sends its own batches, so the requests of a slice go out in parallel.
                own = spread(waiting.where(F.col("slice") == number))
                embed(own, provider, dim, batch).write.mode("overwrite").parquet(f"{path}/run_id={run_id}/slice={number}")
                entry = spark.createDataFrame([(slices,)], "slices int").coalesce(1)
                entry.write.mode("overwrite").parquet(f"{path}/_slices/run_id={run_id}/slice={number}")
    everything = _stored_vectors(spark, path)
    added = everything.where(F.col("run_id") == run_id).agg(F.count(F.lit(1)).alias("embedded"))
    left = pending_chunks(chunks, everything, vehicles, display_name).agg(
        F.count(F.lit(1)).alias("remaining")
    )
    return added.withColumn("one", F.lit(1)).join(left.withColumn("one", F.lit(1)), "one").drop("one")
