"""Exact nearest neighbours by cosine distance, in blocks.

Vectors are packed into blocks inside their task.  Blocks of one vehicle meet in
a join, each meeting is one matrix product, and a task keeps only the nearest
``k`` of each query, so pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .filters import FIT_KEYS
from .ranking import CANDIDATE_WINDOW, top_k
from .sizing import replicated, salted

RECORD_BLOCK_BYTES = 1 << 20
QUERY_BLOCK_BYTES = 1 << 18
HELD_ENTRIES = 4_000_000
# Salts of a vehicle for each core: query blocks are repeated for every salt, so more would only add copies.
SALTS_A_CORE = 2
NO_DATE = -(2**31)
LAST_DATE = 2**31 - 1
UNKNOWN_DISTANCE = 3_000_000_000

_RECORD_ATTRIBUTES = {
    "campaign": "boolean", "component": "string", "filed": "int",
    "trim_key": "string", "litres": "double", "cylinders": "int",
}
_QUERY_ATTRIBUTES = {
    "campaigns": "boolean", "component": "string", "filed_from": "int", "filed_to": "int",
    "this_trim": "boolean", "trim_key": "string", "litres": "double", "cylinders": "int",
}
# Names of a query block's columns where they meet those of a record block.
_ASKED = {"component": "q_component", "trim_key": "q_trim_key", "litres": "q_litres",
          "cylinders": "q_cylinders", "vectors": "q_vectors"}


def _days(name: str) -> Column:
    return F.datediff(F.col(name), F.lit("1970-01-01").cast("date"))


def _fit_values(prefix: str = "") -> dict[str, Column]:
    """Fit attributes with plain stand-ins for unknown ones."""
    key, litres, cylinders = [F.col(prefix + k) for k in FIT_KEYS]
    return {
        "trim_key": F.coalesce(key, F.lit("")),
        "litres": F.coalesce(litres.cast("double"), F.lit(-1.0)),
        "cylinders": F.coalesce(cylinders, F.lit(-1)),
    }


def _packed(df: DataFrame, attributes: dict[str, str], key: str, block_bytes: int) -> DataFrame:
    """Rows ``vehicle_id, <key> array, vectors, <attribute arrays>``, one per block.

    Rows are sorted by vehicle inside their task, without a shuffle, and a block goes
    on over Arrow batches: a vehicle has at most one unfilled block in each partition.
    """
    names = list(attributes)
    schema = f"vehicle_id long, {key} array<long>, vectors binary, " + ", ".join(
        f"{n} array<{t}>" for n, t in attributes.items()
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(frame):
                blocks, left = cut(frame, last=False)
                rest = frame.iloc[left:]
                if blocks:
                    yield pd.DataFrame(blocks)
        if rest is not None and len(rest):
            yield pd.DataFrame(cut(rest.reset_index(drop=True), last=True)[0])

    def cut(frame: pd.DataFrame, last: bool) -> tuple[list[dict], int]:
        """The blocks of a sorted frame, and the row where the unfinished one begins."""
        vehicles = frame["vehicle_id"].to_numpy()
        vectors = np.stack(frame["embedding"].to_numpy()).astype(np.float32)
        columns = {n: frame[n].to_numpy() for n in (key, *names)}
        step = max(1, block_bytes // (4 * vectors.shape[1]))
        edges = [0, *(np.flatnonzero(vehicles[1:] != vehicles[:-1]) + 1).tolist(), len(frame)]
        blocks = []
        for first, end in zip(edges[:-1], edges[1:], strict=True):
            for at in range(first, end, step):
                if end == len(frame) and at + step > end and not last:
                    return blocks, at
                to = min(at + step, end)
                blocks.append({"vehicle_id": vehicles[at], "vectors": vectors[at:to].tobytes(),
                               **{n: c[at:to] for n, c in columns.items()}})
        return blocks, len(frame)

    return df.sortWithinPartitions("vehicle_id", key).mapInPandas(pack, schema)


def record_rows(chunks: DataFrame) -> DataFrame:
    """Embedded chunks with the attributes that queries filter by."""
    return chunks.where(F.col("embedding").isNotNull()).select(
        "vehicle_id", "chunk_id", "embedding",
        (F.col("kind") != "complaint").alias("campaign"),
        F.coalesce("component", F.lit("")).alias("component"),
        F.coalesce(_days("filed_on"), F.lit(NO_DATE)).alias("filed"),
        *[c.alias(n) for n, c in _fit_values().items()],
    )


def pack_records(chunks: DataFrame) -> DataFrame:
    """Blocks of embedded chunks; no shuffle."""
    return _packed(record_rows(chunks), _RECORD_ATTRIBUTES, "chunk_id", RECORD_BLOCK_BYTES)


def query_rows(queries: DataFrame) -> DataFrame:
    """Queries that have a vector, with their filters; a blank component means any."""
    any_bound = F.when(F.col("filed_to").isNotNull(), F.lit(NO_DATE + 1)).otherwise(F.lit(NO_DATE))
    return queries.where(F.col("embedding").isNotNull()).select(
        "vehicle_id", "query_id", "embedding",
        (F.col("scope") == "campaigns").alias("campaigns"),
        F.coalesce("component", F.lit("")).alias("component"),
        F.coalesce(_days("filed_from"), any_bound).alias("filed_from"),
        F.coalesce(_days("filed_to"), F.lit(LAST_DATE)).alias("filed_to"),
        (F.col("trims") == "thisTrim").alias("this_trim"),
        *[c.alias(n) for n, c in _fit_values("own_").items()],
    )


def pack_queries(queries: DataFrame) -> DataFrame:
    """Blocks of query vectors with their filters."""
    return _packed(query_rows(queries), _QUERY_ATTRIBUTES, "query_id", QUERY_BLOCK_BYTES).withColumnsRenamed(_ASKED)


def _unit_rows(block: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = np.frombuffer(block, dtype=np.float32).reshape(rows, -1).astype(np.float64)
    size = np.linalg.norm(vectors, axis=1)
    vectors /= np.where(size > 0, size, 1.0)[:, None]
    return vectors, size > 0


def _allowed(pair, rows: int, width: int) -> np.ndarray:
    """Which records each query may see, by the same rules as the column filters."""
    allowed = np.ones((rows, width), dtype=bool)
    campaigns = np.asarray(pair.campaigns, dtype=bool)
    if campaigns.any():
        allowed[campaigns] &= np.asarray(pair.campaign, dtype=bool)
    start, end = np.asarray(pair.filed_from), np.asarray(pair.filed_to)
    if (start > NO_DATE).any() or (end < LAST_DATE).any():
        filed = np.asarray(pair.filed)
        allowed &= (filed >= start[:, None]) & (filed <= end[:, None])
    wanted, component = np.asarray(pair.q_component), np.asarray(pair.component)
    for row in np.flatnonzero(wanted != ""):
        allowed[row] &= component == wanted[row]
    for row in np.flatnonzero(np.asarray(pair.this_trim, dtype=bool)):
        key, litres, cylinders = pair.q_trim_key[row], pair.q_litres[row], pair.q_cylinders[row]
        if key != "":
            have = np.asarray(pair.trim_key)
            allowed[row] &= (have == "") | (have == key)
        if litres >= 0:
            have = np.asarray(pair.litres)
            allowed[row] &= (have < 0) | (have == litres)
        if cylinders >= 0:
            have = np.asarray(pair.cylinders)
            allowed[row] &= (have < 0) | (have == cylinders)
    return allowed


def _nearest(pair, k: int) -> pd.DataFrame:
    """The nearest ``k`` allowed records of each query of one block meeting.

    Distances are taken to nine places and joined with the record's place in the
    block, which is in id order, so one partition by a unique key settles ties.
    """
    queries, query_ok = _unit_rows(pair.q_vectors, len(pair.query_id))
    records, record_ok = _unit_rows(pair.vectors, len(pair.chunk_id))
    distance = np.rint((1.0 - queries @ records.T) * 1e9).astype(np.int64)
    np.clip(distance, 0, None, out=distance)
    distance[~query_ok] = UNKNOWN_DISTANCE
    distance[:, ~record_ok] = UNKNOWN_DISTANCE
    width = len(pair.chunk_id)
    key = (distance << 21) | np.arange(width)
    barred = np.int64(1) << 60
    key[~_allowed(pair, len(pair.query_id), width)] = barred
    if width > k:
        key = np.partition(key, k - 1, axis=1)[:, :k]
    at, column = np.nonzero(key < barred)
    found = key[at, column]
    return pd.DataFrame({
        "query_id": np.asarray(pair.query_id)[at],
        "chunk_id": np.asarray(pair.chunk_id)[found & ((1 << 21) - 1)],
        "nano": found >> 21,
    })


def _merge(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    together = pd.concat(parts).sort_values(["query_id", "nano", "chunk_id"])
    return together[together.groupby("query_id").cumcount() < k]


def _score(k: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            for pair in batch.itertuples(index=False):
                found = _nearest(pair, k)
                held.append(found)
                size += len(found)
            if size > HELD_ENTRIES:
                held = [_merge(held, k)]
                size = len(held[0])
                if size > HELD_ENTRIES // 2:
                    yield _out(held[0])
                    held, size = [], 0
        if held:
            yield _out(_merge(held, k))

    return score


def _out(found: pd.DataFrame) -> pd.DataFrame:
    nano = found["nano"].to_numpy()
    distance = np.where(nano == UNKNOWN_DISTANCE, np.nan, nano / 1e9)
    return pd.DataFrame({
        "query_id": found["query_id"], "chunk_id": found["chunk_id"], "distance": distance,
    })


def knn(
    queries: DataFrame, chunks: DataFrame, hot: DataFrame | None, k: int = CANDIDATE_WINDOW
) -> DataFrame:
    """``query_id, chunk_id, distance, dense_rank`` of each query's nearest ``k`` chunks.

    With few queries (``hot`` is None) their blocks are broadcast and chunk
    vectors never move.  With many, blocks meet by vehicle, and the blocks of the
    vehicles in ``hot`` are spread over salts that the query blocks follow, no more
    than the cores can use: copies and lists then grow with the queries alone.
    """
    records, wanted = pack_records(chunks), pack_queries(queries)
    if hot is None:
        pairs = records.join(F.broadcast(wanted), "vehicle_id")
    else:
        cores = queries.sparkSession.sparkContext.defaultParallelism
        hot = hot.withColumn("salts", F.least("salts", F.lit(SALTS_A_CORE * cores)))
        pairs = salted(records, F.element_at("chunk_id", 1), hot).join(
            replicated(wanted, hot), ["vehicle_id", "salt"]
        )
    local = pairs.mapInPandas(_score(k), "query_id long, chunk_id long, distance double")
    return top_k(local, "query_id", [F.asc_nulls_last("distance"), F.asc("chunk_id")], k, "dense_rank")
