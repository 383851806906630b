"""Exact nearest neighbours that open only the blocks which can matter.

Vectors are dealt to cells around sampled centres and packed, cell by cell, into
blocks that know their mean direction and the widest angle from it to a member.
Angles keep the triangle inequality, so no member of a block is nearer to a query
than the angle to its centre less that width.  A query opens the few blocks whose
centres are nearest, which gives a distance its ``k``-th neighbour cannot exceed,
and then only blocks whose bound is not beyond it.  The answer is that of
``neighbours.knn``; where vectors form no clusters most blocks are opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .neighbours import _ASKED, _QUERY_ATTRIBUTES, _RECORD_ATTRIBUTES, QUERY_BLOCK_BYTES, _packed, _score, _unit_rows, query_rows, record_rows
from .ranking import CANDIDATE_WINDOW, top_k
from .sizing import hot_vehicles, keep_ids, replicated, salted

# Centres are sampled and broadcast: 512 vectors of 1024 places are 4 MB, whatever the corpus.
CENTRES = 512
ROWS_A_BLOCK = 256
FIRST_BLOCKS = 2
# Listed blocks of a vehicle, and askers of a block, that may meet in one task.
BLOCKS_PER_SALT = 100_000
ASKERS_PER_SALT = 4_096
DIRECTORY_BYTES = 1 << 20
# Angles are right to far less than this, and distances are ranked at nine places.
SLACK = 1e-6
NINE_PLACES = 1e-9

_ROW = "vehicle_id long, near int, then int, chunk_id long, embedding array<float>, " + ", ".join(
    f"{n} {t}" for n, t in _RECORD_ATTRIBUTES.items())
_BLOCK = "vehicle_id long, block_id long, centre array<float>, width double, rows int, chunk_id array<long>, vectors binary, " + ", ".join(
    f"{n} array<{t}>" for n, t in _RECORD_ATTRIBUTES.items())


def sampled_centres(rows: DataFrame, centres: int) -> np.ndarray:
    """Unit vectors of at most ``centres`` chunks, chosen by a hash of their id."""
    picked = rows.select("embedding", "chunk_id", F.xxhash64("chunk_id").alias("h")).orderBy("h", "chunk_id").limit(centres)
    found = [r["embedding"] for r in picked.select("embedding").collect()]
    return _units(np.array(found, dtype=np.float64)) if found else np.zeros((1, 1))


def _units(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(size > 0, size, 1.0)[:, None]


def pack_cells(chunks: DataFrame, centres: int = CENTRES, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Blocks of embedded chunks, each near a centre; to be stored, because several passes read it.

    A row is a block: ``vehicle_id, block_id`` (its least chunk id), ``centre, width, rows``
    and what a block of ``neighbours`` holds.  Chunk ids are unique.  Only the sample of
    centres reaches the driver; a range partitioning by vehicle and cell splits a hot vehicle,
    and a hot cell, among tasks.
    """
    rows = record_rows(chunks)
    around = chunks.sparkSession.sparkContext.broadcast(sampled_centres(rows, centres))
    names = ["chunk_id", *_RECORD_ATTRIBUTES]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                likeness = _units(np.stack(batch["embedding"].to_numpy()).astype(np.float64)) @ around.value.T
                order = np.argsort(-likeness, axis=1, kind="stable")[:, :2]
                yield batch.assign(near=order[:, 0], then=order[:, -1])

    def cut(frame: pd.DataFrame, last: bool) -> tuple[list[dict], int]:
        """Blocks of rows sorted by vehicle and cell, and the row where the unfinished one begins."""
        vehicle, near = frame["vehicle_id"].to_numpy(), frame["near"].to_numpy()
        new_vehicle = np.r_[True, vehicle[1:] != vehicle[:-1]]
        new_cell = new_vehicle | np.r_[True, near[1:] != near[:-1]]
        blocks, start = [], 0
        for at in range(1, len(frame) + 1):
            size = at - start
            if at == len(frame):
                if not last:
                    return blocks, start
            elif not (new_vehicle[at] or size >= rows_a_block or (new_cell[at] and 4 * size >= rows_a_block)):
                continue
            blocks.append(block(frame.iloc[start:at].sort_values("chunk_id")))
            start = at
        return blocks, start

    def block(part: pd.DataFrame) -> dict:
        vectors = np.stack(part["embedding"].to_numpy()).astype(np.float32)
        unit = _units(vectors.astype(np.float64))
        known = np.linalg.norm(unit, axis=1) > 0
        centre = _units(unit.sum(axis=0, keepdims=True)).astype(np.float32)
        angle = np.arccos(np.clip(unit[known] @ _units(centre.astype(np.float64))[0], -1.0, 1.0))
        return {"vehicle_id": part["vehicle_id"].iloc[0], "block_id": part["chunk_id"].iloc[0], "centre": centre[0],
                "width": float(angle.max()) if len(angle) else -1.0, "rows": len(part), "vectors": vectors.tobytes(),
                **{n: part[n].to_numpy() for n in names}}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(frame):
                blocks, left = cut(frame, last=False)
                rest = frame.iloc[left:].reset_index(drop=True)
                if blocks:
                    yield pd.DataFrame(blocks)
        if rest is not None and len(rest):
            yield pd.DataFrame(cut(rest, last=True)[0])

    columns = [c.split()[0] for c in _ROW.split(", ")]
    dealt = rows.withColumns({"near": F.lit(0), "then": F.lit(0)}).select(*columns).mapInPandas(assign, _ROW)
    order = ["vehicle_id", "near", "then", "chunk_id"]
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack, _BLOCK)


def _angles(pair) -> tuple[np.ndarray, np.ndarray]:
    """Angle of each query to each listed centre, and the least angle a member of the block can have."""
    queries, known = _unit_rows(pair.q_vectors, len(pair.query_id))
    centres, _ = _unit_rows(pair.vectors, len(pair.block_id))
    angle = np.arccos(np.clip(queries @ centres.T, -1.0, 1.0))
    width = np.asarray(pair.width)
    least = np.maximum(angle - width[None, :] - SLACK, 0.0)
    least[:, width < 0] = np.pi  # vectors of no direction come after all others
    least[~known] = 0.0
    return angle, least


def _nearest_blocks(first: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                angle, _ = _angles(pair)
                take = np.argsort(angle, axis=1, kind="stable")[:, :first]
                yield pd.DataFrame({
                    "query_id": np.repeat(np.asarray(pair.query_id), take.shape[1]),
                    "block_id": np.asarray(pair.block_id)[take].ravel(),
                    "angle": np.take_along_axis(angle, take, axis=1).ravel(),
                })

    return work


def _blocks_within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks that may hold a member no farther than the query's threshold; all of them without one."""
    for batch in batches:
        for pair in batch.itertuples(index=False):
            _, least = _angles(pair)
            limit = np.array([np.inf if t is None or np.isnan(t) else t for t in pair.threshold], dtype=np.float64)
            at, block = np.nonzero(1.0 - np.cos(least) - NINE_PLACES <= limit[:, None])
            yield pd.DataFrame({"query_id": np.asarray(pair.query_id)[at], "block_id": np.asarray(pair.block_id)[block]})


def _listed(cells: DataFrame, asked: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """Query blocks beside the listed centres of their vehicle; the vectors of the blocks are not read."""
    directory = cells.select("vehicle_id", "block_id", "width", F.col("centre").alias("embedding"))
    hot = hot_vehicles(directory, BLOCKS_PER_SALT)
    centres = _packed(directory, {"width": "double"}, "block_id", DIRECTORY_BYTES)
    wanted = _packed(asked, attributes, "query_id", QUERY_BLOCK_BYTES).withColumnsRenamed(_ASKED)
    return salted(centres, F.element_at("block_id", 1), hot).join(replicated(wanted, hot), ["vehicle_id", "salt"])


def _opened(cells: DataFrame, asked: DataFrame, meetings: DataFrame, k: int) -> DataFrame:
    """The nearest ``k`` chunks of each query in the blocks it opens, from each task.

    The queries of a block travel to it in packs; a block that very many ask for is met in several tasks.
    """
    wanted = meetings.join(asked.drop("vehicle_id"), "query_id").withColumnRenamed("block_id", "vehicle_id")
    hot = hot_vehicles(meetings.select(F.col("block_id").alias("vehicle_id")), ASKERS_PER_SALT)
    dealt = salted(wanted, F.col("query_id"), hot).repartition("vehicle_id", "salt").drop("salt")
    packs = _packed(dealt, _QUERY_ATTRIBUTES, "query_id", QUERY_BLOCK_BYTES).withColumnsRenamed(_ASKED)
    held = keep_ids(cells.drop("vehicle_id", "centre", "width", "rows"), meetings, "block_id")
    pairs = held.join(packs.withColumnRenamed("vehicle_id", "block_id"), "block_id")
    local = pairs.mapInPandas(_score(k), "query_id long, chunk_id long, distance double")
    return cut_lineage(top_k(local, "query_id", [F.asc_nulls_last("distance"), F.asc("chunk_id")], k, "dense_rank"))


def open_cells(
    queries: DataFrame, cells: DataFrame, k: int = CANDIDATE_WINDOW, first: int = FIRST_BLOCKS
) -> tuple[DataFrame, DataFrame]:
    """What ``knn`` gives, and the ``query_id, block_id`` of every block that was opened for it.

    ``cells`` is a stored ``pack_cells``.  A query without a direction, or with fewer than ``k``
    allowed chunks in its first blocks, has no threshold and opens every block of its vehicle.
    Query ids are unique.  Empty tables give empty tables.
    """
    asked = cut_lineage(query_rows(queries))
    near = _listed(cells, asked, _QUERY_ATTRIBUTES).mapInPandas(
        _nearest_blocks(first), "query_id long, block_id long, angle double")
    opened = cut_lineage(top_k(near, "query_id", [F.asc_nulls_last("angle"), F.asc("block_id")], first, "place").select("query_id", "block_id"))
    begun = _opened(cells, asked, opened, k)
    threshold = begun.groupBy("query_id").agg(F.when(F.count("distance") >= k, F.max("distance")).alias("threshold"))
    bounded = asked.join(threshold, "query_id", "left").select(*asked.columns, "threshold")
    within = _listed(cells, bounded, {**_QUERY_ATTRIBUTES, "threshold": "double"}).mapInPandas(
        _blocks_within, "query_id long, block_id long")
    others = cut_lineage(within.join(opened, ["query_id", "block_id"], "left_anti"))
    found = begun.unionByName(_opened(cells, asked, others, k)).drop("dense_rank")
    ranked = top_k(found, "query_id", [F.asc_nulls_last("distance"), F.asc("chunk_id")], k, "dense_rank")
    return ranked, opened.unionByName(others)


def cell_ranking(queries: DataFrame, cells: DataFrame, k: int = CANDIDATE_WINDOW, first: int = FIRST_BLOCKS) -> DataFrame:
    """``query_id, chunk_id, distance, dense_rank`` of each query's nearest ``k`` chunks, as ``knn`` ranks them."""
    return open_cells(queries, cells, k, first)[0]
