"""Mix sources to target weights: exact block quotas, split among shards by a multivariate hypergeometric tree.

The documents of a source, in the order of a hash, are one stream of words, cut
into blocks of equal size.  A source's quota is a whole number of blocks; beyond its
number of blocks a second pass over the source begins.  Each pass goes through the
blocks in an order of its own, a keyed permutation, so "the first quota places" are
disjoint blocks drawn without replacement.  The tree halves the shards again and
again: each half's part of every quota is one multivariate hypergeometric draw, as if
all drawn blocks were shuffled and dealt out, and a shard gets the next places of
each source.  Where a block lies and who takes it is arithmetic on its number, so
nothing but the sizes is ever shuffled.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import WORD, kept_columns

# Documents of one source that are summed in one group, on average.
DOCUMENTS_A_BUCKET = 512
# Sources whose sizes, quotas and shares the driver holds: the rows of a mixing plan.
MOST_SOURCES = 100_000
# A block's words, at least; sources of few words have smaller blocks, so that a block is a thousandth of them.
BLOCK_WORDS = 1024
BLOCKS_A_SOURCE = 1000
# Shards, at least, and words of a shard beyond them.
LEAST_SHARDS = 64
SHARD_WORDS = 1 << 24
# All quotas together, in blocks: the hypergeometric draws need less than 10^9.  Blocks grow to keep it.
MOST_BLOCKS = 400_000_000
EPOCHS = 2


@dataclass
class Plan:
    """What the tasks need of each source, in the order of ``names``."""

    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    block: np.ndarray  # words
    blocks: np.ndarray
    quota: np.ndarray  # blocks
    borders: np.ndarray  # [source, shard]: the first place beyond the shard's


def fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Targets by weight that sum to ``total``; none above ``most`` times its size, the excess goes to the others."""
    targets, open_ = [0.0] * len(sizes), [k for k in range(len(sizes)) if sizes[k] > 0]
    left = min(total, most * sum(sizes))
    while open_:
        scale = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * scale >= most * sizes[k]]
        if not full:
            for k in open_:
                targets[k] = weights[k] * scale
            break
        for k in full:
            targets[k] = most * sizes[k]
            left -= targets[k]
        done = set(full)
        open_ = [k for k in open_ if k not in done]
    return targets


def split(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """``[source, shard]`` quotas: each inner node of the tree is one draw with a seed of its own."""
    out = np.zeros((len(quota), shards), np.int64)
    open_ = [(0, shards, quota.astype(np.int64))]
    while open_:
        first, last, here = open_.pop()
        if last - first == 1:
            out[:, first] = here
            continue
        middle = (first + last) // 2
        total = int(here.sum())
        draw = np.random.default_rng([seed, first, last])
        left = draw.multivariate_hypergeometric(here, total * (middle - first) // (last - first), method="marginals")
        open_ += [(first, middle, left), (middle, last, here - left)]
    return out


def plan(sizes: dict[str | None, int], *, weights=(5, 2, 1), share: float = 1.5, shards: int | None = None,
         seed: int = 7) -> Plan:
    """Targets, blocks, quotas and each shard's part; sources by code point, null last, weigh ``weights`` in turn."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    words = [sizes[n] for n in names]
    targets = fill(words, [weights[k % len(weights)] for k in range(len(names))], share * sum(words), EPOCHS)
    least = -(-int(sum(targets)) // MOST_BLOCKS)
    block = np.array([max(1, least, min(BLOCK_WORDS, w // BLOCKS_A_SOURCE)) for w in words], np.int64)
    blocks = -(-np.array(words, np.int64) // block)
    quota = np.minimum(np.rint(np.array(targets) / block).astype(np.int64), EPOCHS * blocks) if names else np.zeros(0, np.int64)
    shards = shards or max(LEAST_SHARDS, -(-int(sum(targets)) // SHARD_WORDS))
    return Plan(names, words, targets, block, blocks, quota, np.cumsum(split(quota, shards, seed), axis=1))


def scramble(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def permute(block: np.ndarray, blocks: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each block in its pass: a four-round Feistel network, walked until it is below ``blocks``."""
    half = np.ones(len(block), np.uint64)
    while (low := (np.uint64(1) << (half * np.uint64(2))) < blocks.astype(np.uint64)).any():
        half[low] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = block.astype(np.uint64), np.arange(len(block))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (scramble(right, k + np.uint64(turn)) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= blocks[todo].astype(np.uint64)]
    return out.astype(np.int64)


def draw(plan: Plan, source: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int, whole: bool) -> dict[str, np.ndarray]:
    """Every taken stretch of documents that lie at ``start`` in their source's stream.

    ``whole``: a document belongs to the block in which it starts and is taken
    with it; else each block takes its own words of a document.
    """
    block = plan.block[source]
    first = start // block
    count = np.where(size > 0, 1 if whole else (start + size - 1) // block - first + 1, 0)
    doc = np.repeat(np.arange(len(source)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    out = []
    for epoch in range(EPOCHS):
        s = source[doc]
        key = scramble(s.astype(np.uint64), np.full(len(s), seed * EPOCHS + epoch, np.uint64))
        place = permute(number, plan.blocks[s], key) + epoch * plan.blocks[s]
        taken = np.flatnonzero(place < plan.quota[s])
        d = doc[taken]
        begin, end = np.zeros(len(d), np.int64), size[d]
        if not whole:
            begin = np.maximum(number[taken] * block[d] - start[d], 0)
            end = np.minimum((number[taken] + 1) * block[d] - start[d], size[d])
        shard = np.zeros(len(d), np.int64)
        for one in np.unique(s[taken]):
            here = s[taken] == one
            shard[here] = np.searchsorted(plan.borders[one], place[taken][here], "right")
        out.append((d, np.full(len(d), epoch), number[taken], begin, end, shard))
    parts = [np.concatenate(column) for column in zip(*out, strict=True)]
    order = np.argsort(parts[0], kind="stable")
    return dict(zip(("doc", "epoch", "block", "begin", "end", "shard"), (p[order] for p in parts), strict=True))


SPANS = "array<struct<epoch:int,block:bigint,begin:bigint,end:bigint,shard:int>>"


def mix(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, shards: int | None = None, seed: int = 7, whole: bool = False,
        text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row with ``size`` (words), ``source_size``, ``target`` (its source's), ``spans`` and ``taken``.

    ``spans`` lists the stretches of words ``[begin, end)`` that the mix takes, each
    with its pass, block and shard; ``taken`` is their number of words, repeats
    counted.  The text is dropped unless ``whole`` is set, in which documents are taken
    or left as they are and the quotas count blocks of documents.

    Without ``shards`` there are 64, and as many more as keep a shard at 16 million words.

    Null texts have no words and are never taken; a null source is a source of its
    own, the last; rows with the same id are documents each, their order is settled
    by a hash of id and text, so a hot id is spread as others are; rows with equal id and text are
    taken alike but for which comes first; columns named like an output are replaced.  Empty tables and
    sources without words take nothing.  More than ``MOST_SOURCES`` sources raise an
    error: their plan is held by the driver.
    """
    made = ["size", "source_size", "target", "spans", "taken"]
    keep = [c for c in kept_columns(docs, made) if whole or c != text]
    sized = docs.select(
        F.struct(*keep).alias("_row"), F.col(source).alias("_source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(text)).alias("_order"), F.col(doc_id).alias("_id"),
    )
    sizes = sized.groupBy("_source").agg(F.sum("_size").alias("words"), F.count(F.lit(1)).alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: merge the small ones first")
    made_plan = plan({r["_source"]: r["words"] for r in sizes}, weights=weights, share=share, shards=shards, seed=seed)
    buckets = max(1, -(-sum(r["rows"] for r in sizes) // DOCUMENTS_A_BUCKET))
    shared = docs.sparkSession.sparkContext.broadcast(made_plan)

    placed = _starts(sized, buckets)
    schema = T.StructType([placed.schema["_row"]]) \
        .add("_size", "long").add("_total", "long").add("_target", "double").add("_taken", "long") \
        .add("_spans", T._parse_datatype_string(SPANS))

    def run(batches):
        held: Plan = shared.value
        for batch in batches:
            names = batch.column(1).to_pylist()
            index = np.array([_index(held, n) for n in names], np.int64)
            size, start = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            found = draw(held, index, start, size, seed, whole)
            offsets = np.searchsorted(found["doc"], np.arange(len(names) + 1))
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(found["epoch"], pa.int32()), pa.array(found["block"]), pa.array(found["begin"]), pa.array(found["end"]),
                 pa.array(found["shard"], pa.int32())], ["epoch", "block", "begin", "end", "shard"]))
            words = np.bincount(found["doc"], found["end"] - found["begin"], len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([held.sizes[k] for k in index], pa.int64()),
                 pa.array([held.targets[k] for k in index], pa.float64()), pa.array(words), spans],
                ["_row", "_size", "_total", "_target", "_taken", "_spans"])

    out = placed.select("_row", "_source", "_size", "_start").mapInArrow(run, schema)
    return out.select("_row.*", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"),
                      F.col("_spans").alias("spans"), F.col("_taken").alias("taken"))


def _index(held: Plan, name: str | None) -> int:
    return len(held.names) - 1 if name is None else bisect.bisect_left(held.names, name, hi=len(held.names) - (held.names[-1] is None))


def _starts(sized: DataFrame, buckets: int) -> DataFrame:
    """``_start``: the words of the documents before it in its source, in the order of a hash.

    Summed in two steps, within buckets of the hash and over the buckets, so that a
    source of any size is spread over many tasks.  Rows move once: the sums meet them where
    they are, by a key that is never null (a struct of the source), so that it is one of both the window and the join.
    """
    dealt = sized.withColumn("_bucket", F.pmod("_order", F.lit(buckets))).withColumn("_of", F.struct("_source"))
    inside = Window.partitionBy("_of", "_bucket").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("_local", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    over = Window.partitionBy("_of").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("_of", "_bucket").agg(F.sum("_size").alias("_sum"))
        .select("_of", "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    )
    return within.join(before, ["_of", "_bucket"]).withColumn("_start", F.col("_before") + F.col("_local"))


def dealt_out(mixed: DataFrame, *, seed: int = 7, doc_id: str = "doc_id") -> DataFrame:
    """One row for each taken stretch, gathered by shard and shuffled within it."""
    rows = mixed.withColumn("span", F.explode("spans")).drop("spans")
    shuffle = F.xxhash64(F.lit(seed), F.col("span.epoch"), F.col("span.block"), F.col(doc_id), F.col("span.begin"))
    return rows.repartition(F.col("span.shard")).sortWithinPartitions(F.col("span.shard"), shuffle, F.col(doc_id))
