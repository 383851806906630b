"""Hard negatives by exact inner products, most of which bounds make needless.

Every vector is stored with the mean and the deviation of each of its segments.  Of
two segments of width w, the inner product lies within w * (mean * mean +- deviation
* deviation): the deviations from the means are vectors themselves, whose product is at
most that of their lengths.  Wide segments are looked at first; pairs of anchor and
row that they cannot rule out are looked at in narrower segments, and what is left
is scored exactly.

Rows are packed into blocks, blocks into groups of bounded size.  Every group of
anchors meets every group of blocks in one task, which keeps a running list of the
best for each anchor and so knows what a bound must reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

# Widths of segments, each a divisor of the one before.
WIDTHS = (16, 4)
BLOCK_ROWS = 1024
BLOCK_BYTES = 4 << 20
BLOCKS_A_GROUP = 64
ANCHORS_A_GROUP = 4096
# Anchors whose bounds against one block are held at once.
ANCHORS_AT_ONCE = 512
# Beyond this share of pairs left, one matrix product is cheaper than single ones.
DENSE = 0.1

STORE = "part int, number int, n int, dims int, ids binary, labels binary, vectors binary, means binary, deviations binary"


def taking_part(vectors: DataFrame, scale: float = 256.0, *, label: Column | None = None) -> DataFrame:
    """``vec_id, label, x`` of the rows with an id, a label and a vector of finite components; ``x`` holds floor(scale * component).

    Of rows with one id a single one takes part, that of the least label and then of the least vector.
    """
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    return one.select(F.col("vec_id").cast("long").alias("vec_id"), "row.label", F.transform("row.embedding", lambda c: c * scale).alias("x"))


def _matrix(x: pa.Array) -> np.ndarray:
    """Vectors as rows of whole numbers, zeros behind them up to a multiple of the widest segment."""
    lengths = x.value_lengths().to_numpy(zero_copy_only=False)
    dims = max(1, -(-int(lengths.max(initial=0)) // WIDTHS[0])) * WIDTHS[0]
    out = np.zeros((len(x), dims))
    out[np.arange(dims) < lengths[:, None]] = np.floor(x.flatten().to_numpy())
    return out


def _summary(matrix: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    parts = matrix.reshape(len(matrix), -1, width)
    return parts.mean(axis=2), parts.std(axis=2)


def _wider(means: np.ndarray, deviations: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of segments from those of their equal parts."""
    m = means.reshape(len(means), -1, times)
    d = deviations.reshape(len(means), -1, times)
    return m.mean(axis=2), np.sqrt((d * d).mean(axis=2) + m.var(axis=2))


def store(rows: DataFrame) -> DataFrame:
    """The blocks, written: ids, labels, whole vectors, and mean and deviation of their narrowest segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            longest = max(1, int(batch.column(2).value_lengths().to_numpy(zero_copy_only=False).max(initial=0)))
            step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * longest)))
            for start in range(0, batch.num_rows, step):
                block = batch.slice(start, step)
                matrix = _matrix(block.column(2))
                means, deviations = _summary(matrix, WIDTHS[-1])
                small = np.abs(matrix).max(initial=0) < 1 << 15
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "number": number, "n": len(matrix), "dims": matrix.shape[1],
                    "ids": block.column(0).to_numpy().astype("<i8").tobytes(), "labels": block.column(1).to_numpy().astype("<i8").tobytes(),
                    "vectors": matrix.astype("<i2" if small else "<f8").tobytes(),
                    "means": means.astype("<f8").tobytes(), "deviations": deviations.astype("<f8").tobytes(),
                }], schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), *(
                    (name, pa.binary()) for name in ("ids", "labels", "vectors", "means", "deviations"))]))
                number += 1

    return cut_lineage(rows.select("vec_id", "label", "x").mapInArrow(run, STORE))


class Side:
    """Vectors of one side of a meeting, with their segments by level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, means: np.ndarray | None = None, deviations: np.ndarray | None = None):
        self.ids, self.labels, self.matrix = ids, labels, matrix
        if means is None:
            means, deviations = _summary(matrix, WIDTHS[-1])
        self.levels = [_wider(means, deviations, width // WIDTHS[-1]) for width in WIDTHS[:-1]] + [(means, deviations)]
        self.largest = float(np.abs(matrix).max(initial=0))
        self.length = float(np.sqrt((matrix * matrix).sum(axis=1).max(initial=0)))

    @classmethod
    def of_block(cls, block: dict) -> Side:
        n = block["n"]
        kind = "<i2" if len(block["vectors"]) == 2 * n * block["dims"] else "<f8"
        return cls(np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["labels"], "<i8"),
                   np.frombuffer(block["vectors"], kind).reshape(n, -1).astype(np.float64),
                   *(np.frombuffer(block[name], "<f8").reshape(n, -1) for name in ("means", "deviations")))

    def at(self, rows: np.ndarray) -> Side:
        out = object.__new__(Side)
        out.ids, out.labels, out.matrix, out.largest, out.length = self.ids[rows], self.labels[rows], self.matrix[rows], self.largest, self.length
        out.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return out


def _exact(a: np.ndarray, b: np.ndarray, pairs: bool, largest: float) -> np.ndarray:
    """Inner products of whole numbers, all of them or row by row; beyond what doubles hold, in Python's integers."""
    if largest < 1 << 53:
        return (np.einsum("ij,ij->i", a, b) if pairs else a @ b.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (a, b))
    return np.array((a * b).sum(axis=1) if pairs else a @ b.T, dtype=np.int64)


def scored(anchors: Side, rows: Side, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and score of the allowed pairs whose score may lie within ``low`` and ``high`` of the anchor.

    No pair within them is left out; some outside may be returned.
    """
    shared = min(anchors.matrix.shape[1], rows.matrix.shape[1])  # what one side lacks is zero
    slack = 1e-9 * anchors.length * rows.length + 1e-6
    low, high = low - slack, high + slack
    at, to = np.nonzero(allowed)
    for level, width in enumerate(WIDTHS):
        if not len(at):
            break
        segments = shared // width
        (am, ad), (bm, bd) = ((m[:, :segments], d[:, :segments]) for m, d in (anchors.levels[level], rows.levels[level]))
        if len(at) > DENSE * allowed.size:
            middle, reach = width * (am @ bm.T)[at, to], width * (ad @ bd.T)[at, to]
        else:
            middle, reach = width * np.einsum("ij,ij->i", am[at], bm[to]), width * np.einsum("ij,ij->i", ad[at], bd[to])
        left = (middle + reach >= low[at]) & (middle - reach <= high[at])
        at, to = at[left], to[left]
    largest = anchors.largest * rows.largest * shared
    a, b = anchors.matrix[:, :shared], rows.matrix[:, :shared]
    if len(at) > DENSE * allowed.size:
        return at, to, _exact(a, b, False, largest)[at, to]
    return at, to, _exact(a[at], b[to], True, largest)


class Best:
    """The ``k`` best (score, then least id) of each of ``n`` lists, as they come in."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.list, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.last = np.full(n, -np.inf)  # the score that a list's newcomer must reach

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        reach = scores >= self.last[lists]
        lists, scores, ids = (np.concatenate([old, new[reach]]) for old, new in ((self.list, lists), (self.score, scores), (self.id, ids)))
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        first = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]) if len(lists) else lists)
        place = np.arange(len(lists)) - np.repeat(first, np.diff(np.append(first, len(lists))))
        kept = place < self.k
        self.list, self.score, self.id = lists[kept], scores[kept], ids[kept]
        full = place == self.k - 1
        self.last[lists[full]] = scores[full]


def _meetings(blocks: DataFrame, anchors: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over every group of anchors and every group of blocks; both sides are shuffled."""
    many = blocks.count()
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(many / BLOCKS_A_GROUP), min(many, cores))
    sets = max(1, math.ceil(anchors.count() / ANCHORS_A_GROUP))
    dealt = blocks.withColumn("g", F.pmod(F.xxhash64("part", "number"), F.lit(groups)).cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    asked = anchors.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(sets)).cast("int")).withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [work(right.slice(k, ANCHORS_AT_ONCE).combine_chunks(), left) for k in range(0, right.num_rows, ANCHORS_AT_ONCE)]
        return pa.concat_tables(found) if found else work(right, left)

    return dealt.groupBy("g", "c").cogroup(asked.groupBy("g", "c")).applyInArrow(run, schema)


def _side(asked: pa.Table) -> Side:
    return Side(asked.column("vec_id").to_numpy(), asked.column("label").to_numpy(), _matrix(asked.column("x").combine_chunks()))


def _blocks(table: pa.Table) -> Iterator[Side]:
    for batch in table.to_batches(max_chunksize=1):
        yield from map(Side.of_block, batch.to_pylist())


def nearest_alike(blocks: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """``anchor_id, positive_id, positive_score``: the ``k`` best other rows of an anchor's label."""
    names = ["anchor_id", "positive_id", "positive_score"]

    def work(asked: pa.Table, table: pa.Table) -> pa.Table:
        side = _side(asked)
        best = Best(len(side.ids), k)
        for rows in _blocks(table):
            alike = (side.labels[:, None] == rows.labels) & (side.ids[:, None] != rows.ids)
            at, to, score = scored(side, rows, alike, best.last, np.full(len(side.ids), np.inf))
            best.add(at, score, rows.ids[to])
        return pa.table([side.ids[best.list], best.id, best.score], names)

    found = _meetings(blocks, anchors, work, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def hard_negatives(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows``: those of ``taking_part``.  An anchor's positives are its ``positives``
    best other rows of its label (ties: least id), all if there are fewer.  For each,
    the ``negatives`` best rows of another label with ``low`` * positive score <= 100 *
    negative score <= ``high`` * positive score; a positive of no such row has no row.
    Scores are exact inner products; vectors of unequal length are compared as if the
    shorter went on in zeros.  A score beyond 64 bits is an error.

    Rows without id or label, without a vector or with a component that is no finite
    number take no part; of rows with one id one does (see ``taking_part``).  An empty
    table gives an empty table.  Columns beyond the three are not read.  A label may
    hold any share of the rows: rows are dealt out by id, not by label.
    """
    rows = cut_lineage(rows)
    blocks = store(rows)
    anchors = cut_lineage(rows.where(is_anchor))
    alike = cut_lineage(nearest_alike(blocks, anchors, positives))
    listed = alike.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_score", "positive_id"))).alias("positives"))
    asked = cut_lineage(anchors.join(listed, "vec_id").select(
        "vec_id", "label", "x", F.col("positives.positive_id").alias("positive_id"), F.col("positives.positive_score").alias("positive_score")))
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def work(table: pa.Table, block_table: pa.Table) -> pa.Table:
        side = _side(table)
        # One list for each anchor and positive.
        mine = np.repeat(np.arange(len(side.ids)), table.column("positive_id").combine_chunks().value_lengths().to_numpy())
        ids, scores = (table.column(name).combine_chunks().flatten().to_numpy().astype(np.int64) for name in ("positive_id", "positive_score"))
        least = np.array([-(-low * s // 100) for s in scores.tolist()], np.int64)
        most = np.array([high * s // 100 for s in scores.tolist()], np.int64)
        best = Best(len(mine), negatives)
        first = np.searchsorted(mine, np.arange(len(side.ids)))
        count = np.bincount(mine, minlength=len(side.ids))
        for rows in _blocks(block_table):
            reach = np.maximum(best.last, least)
            open_ = most >= reach  # else no newcomer fits
            low_of = np.full(len(side.ids), np.inf)
            high_of = np.full(len(side.ids), -np.inf)
            np.minimum.at(low_of, mine[open_], reach[open_])
            np.maximum.at(high_of, mine[open_], most[open_])
            other = (side.labels[:, None] != rows.labels) & (low_of <= high_of)[:, None]
            at, to, score = scored(side, rows, other, low_of, high_of)
            for k in range(int(count.max(initial=0))):
                has = count[at] > k
                lists, found, row = first[at[has]] + k, score[has], to[has]
                fits = (found >= least[lists]) & (found <= most[lists])
                best.add(lists[fits], found[fits], rows.ids[row[fits]])
        return pa.table([side.ids[mine[best.list]], ids[best.list], scores[best.list], best.id, best.score], names)

    found = _meetings(blocks, asked, work, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.alike
   AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
