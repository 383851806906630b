"""Keyword ranking over stored blocks, most of which a bound leaves shut.

The chunks of a vehicle are dealt into blocks.  A block is one row: its chunks with the
columns that filters look at, and for each word the chunks that hold it, how often, and
the most that any does.  The sum of these most is the highest score that a query can
reach there; blocks are opened from the highest bound down, until no bound reaches the
score of the query's last candidate.  The result is that of the full sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import MAX_TERMS, lexemes, query_lexeme_array
from ..functions.wordlists import is_plain, plain_lexemes
from ..schemas import CAMPAIGN_KINDS
from .filters import RECORD_COLUMNS
from .postings import query_terms
from .ranking import CANDIDATE_WINDOW, rank_sparse
from .sizing import MAX_BROADCAST_IDS, is_small

CHUNKS_A_BLOCK = 1024
# Blocks of one vehicle that meet its queries in one task.
BLOCKS_A_GROUP = 50
# Texts of one vehicle that meet its blocks in one task.
QUERIES_A_GROUP = 20_000
# The same where the vehicle is one group of blocks, as many times as it has groups.
QUERIES_A_TASK = 5_000
# Classes of length in which blocks are dealt, for each doubling, and more than a text can have.
CLASSES_AN_OCTAVE = 4
LAST_CLASS = 1000
# A word held by one chunk of so many of its block, or more, is a row of the block's scores.
DENSE_SHARE = 16
# Characters of a block's texts, about, and of a word where words are given.
CHARS_A_BLOCK = 4 << 20
CHARS_A_WORD = 6

ASKED = ["scope", "trims", "component", "filed_from", "filed_to", "own_trim_key", "own_engine_litres", "own_engine_cylinders"]


def _order(corpus: DataFrame, words: Column | None, chunks_a_block: int) -> tuple[Column, DataFrame]:
    """A chunk's place in the order of blocks, campaigns and the longest texts first, and for each vehicle of several
    blocks and each place the first of its blocks, how many there are, and how many the vehicle has in ``all``."""
    size = F.length("text") if words is None else F.size(words) * CHARS_A_WORD
    size = F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))
    length = F.floor(F.log2(size + F.lit(1)) * CLASSES_AN_OCTAVE).cast("int")
    place = F.coalesce(F.col("kind").isin(CAMPAIGN_KINDS), F.lit(False)).cast("int") * LAST_CLASS + length
    counted = corpus.groupBy("vehicle_id", place.alias("place")).agg(
        F.greatest(F.count(F.lit(1)) / chunks_a_block, F.sum(size.cast("long")) / CHARS_A_BLOCK).alias("n"))
    whole = Window.partitionBy("vehicle_id")
    after = F.sum("n").over(whole.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0))
    first = F.floor(F.round(after - F.col("n"), 6)).cast("int")
    last = F.greatest(first, F.ceil(F.round(after, 6)).cast("int") - 1)
    return place, counted.select(
        "vehicle_id", "place", first.alias("first"), (last - first + 1).alias("blocks"),
        F.ceil(F.round(F.sum("n").over(whole), 6)).cast("int").alias("all"),
    ).where(F.col("all") > 1)


def pack_blocks(corpus: DataFrame, words: Column | None = None, chunks_a_block: int = CHUNKS_A_BLOCK) -> DataFrame:
    """One row a block: ``vehicle_id, g, block``, its chunks and its word lists.

    ``words`` is an array column, by default the lower-case words of ``text``.  A vehicle
    of any size is as many blocks as its chunks and their texts need; the smallest has one.
    A block has chunks of about one length, and campaigns or complaints but where they meet:
    the bound of a block of short texts is low, and a query of one pool leaves the other's
    blocks shut.
    """
    owned = corpus.where(F.col("vehicle_id").isNotNull())
    place, several = _order(owned, words, chunks_a_block)
    # Rows of one chunk go to one block, whatever their lengths: the first to look at.
    repeated = owned.groupBy("vehicle_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "vehicle_id", "chunk_id", F.lit(True).alias("repeated"))
    if is_small(repeated, 0):
        spot = F.pmod(F.xxhash64("chunk_id"), F.coalesce("blocks", F.lit(1))) + F.coalesce("first", F.lit(0))
    else:
        # Blocks by chunk alone.
        several = owned.groupBy("vehicle_id").agg(F.ceil(F.count(F.lit(1)) / chunks_a_block).cast("int").alias("blocks")).where("blocks > 1").select(
            "vehicle_id", F.lit(0).alias("place"), F.lit(0).alias("first"), "blocks", F.col("blocks").alias("all"))
        place, spot = F.lit(0), F.pmod(F.xxhash64("chunk_id"), F.coalesce("blocks", F.lit(1)))
    # Vehicles of several blocks are at most a row for each of their blocks: broadcast, so that no text moves to meet them.
    dealt = owned.withColumn("place", place).join(F.broadcast(several), ["vehicle_id", "place"], "left").withColumn("block", spot.cast("int"))
    # Texts move, once, not their words, which take several times the room; most are cut where they are packed.
    text = F.col("text")
    plain, cut = (F.when(is_plain(text), text), F.when(~is_plain(text), lexemes(text))) if words is None else (F.lit(None).cast("string"), words)
    dealt = dealt.repartition("vehicle_id", "block").select(
        *RECORD_COLUMNS, "chunk_id", "block", F.ceil(F.coalesce("all", F.lit(1)) / BLOCKS_A_GROUP).cast("int").alias("groups"),
        plain.alias("plain"), cut.alias("words"))
    record = T.StructType([corpus.schema["chunk_id"], *(corpus.schema[c] for c in RECORD_COLUMNS if c != "vehicle_id")])
    schema = T.StructType([
        corpus.schema["vehicle_id"], T.StructField("g", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("records", T.ArrayType(record)), T.StructField("lexemes", T.ArrayType(T.StringType())),
        T.StructField("most", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("places", T.BinaryType()), T.StructField("tfs", T.BinaryType())])

    def pack(key: tuple, chunks: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        vehicle, block = (x.as_py() for x in key)
        lists, texts = chunks.column("words").combine_chunks(), chunks.column("plain")
        # A text's words are Python's only until the next text.
        cut = [pa.array([] if text.as_py() is None else plain_lexemes(text.as_py()), pa.string()) for text in texts]
        every = pa.concat_arrays([lists.flatten().cast(pa.string()), *cut])
        coded, each = every.dictionary_encode(), np.arange(len(lists))
        chunk = np.concatenate([np.repeat(each, lists.fill_null([]).value_lengths().to_numpy()), np.repeat(each, [*map(len, cut)])])
        pairs, tfs = np.unique(coded.indices.to_numpy().astype(np.int64) * len(lists) + chunk, return_counts=True)
        word, place = pairs // len(lists), pairs % len(lists)
        starts = np.searchsorted(word, np.arange(len(coded.dictionary) + 1))
        most = np.maximum.reduceat(tfs, starts[:-1]) if len(tfs) else tfs
        records = pa.StructArray.from_arrays([chunks.column(name).combine_chunks() for name in record.names], names=record.names)
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        # Each group has blocks of every length.
        group = block % chunks.column("groups")[0].as_py()
        row = [pa.array([vehicle], pa.int64()), pa.array([group], pa.int32()), pa.array([block], pa.int32()), whole(records),
               whole(coded.dictionary), whole(pa.array(most, pa.int32())), whole(pa.array(starts, pa.int32())),
               pa.array([_narrow(place)], pa.binary()), pa.array([_narrow(tfs)], pa.binary())]
        wanted = to_arrow_schema(schema)
        return pa.table([c.cast(f.type) for c, f in zip(row, wanted, strict=True)], names=wanted.names)

    return dealt.groupBy("vehicle_id", "block").applyInArrow(pack, schema)


def _narrow(values: np.ndarray) -> bytes:
    """Small whole numbers in as few bytes each as the largest needs: 1, 2 or 4."""
    most = values.max(initial=0)
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<i4").tobytes()


def _wide(held: pa.Scalar, many: int) -> np.ndarray:
    buffer = held.as_buffer()
    return np.frombuffer(buffer, {1: "<u1", 2: "<u2", 4: "<i4"}[buffer.size // many] if many else "<u1")


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``many`` of them, one range after the other."""
    ends = np.cumsum(many)
    return np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)


class _Group:
    """The blocks of a task as they are asked: one list of postings, and for each word that any of its queries asks
    the blocks that hold it, with the place of their postings in the list."""

    def __init__(self, rows: pa.Table, asked: pa.Array, distinct: bool, merged: bool):
        column = lambda name: rows.column(name).combine_chunks()
        records, words = column("records"), column("lexemes")
        self.edges = np.append(0, np.cumsum(records.value_lengths().to_numpy()))
        held = records.flatten()
        self.records = {held.type.field(k).name: held.field(k) for k in range(held.type.num_fields)}
        self.ids = self.records["chunk_id"].to_numpy(zero_copy_only=False)
        code = pc.index_in(words.flatten(), value_set=asked).fill_null(-1).to_numpy()
        block = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
        starts = column("starts").flatten().to_numpy()  # one more than words in each block
        at = np.arange(len(code)) + block
        many = starts[at + 1] - starts[at]
        total = np.bincount(block, many, len(words)).astype(np.int64)
        places, tfs = column("places"), column("tfs")
        self.places = np.concatenate([np.zeros(0, np.int32), *(
            _wide(x, n).astype(np.int32) + np.int32(edge) for x, n, edge in zip(places, total.tolist(), self.edges))])
        self.tfs = None if distinct else np.concatenate([np.zeros(0, np.uint8), *(_wide(x, n) for x, n in zip(tfs, total.tolist()))])
        found = np.flatnonzero(code >= 0)
        found = found[np.argsort(code[found], kind="stable")]
        self.starts = np.searchsorted(code[found], np.arange(len(asked) + 1))
        self.block, self.many = block[found].astype(np.int32), many[found].astype(np.int32)
        self.first = starts[at[found]] + (np.cumsum(total) - total)[self.block]
        self.most = np.ones(len(found), np.int32) if distinct else column("most").flatten().to_numpy()[found]
        # Rows of one chunk, if the chunks are to be told by their ids alone.
        self.same, self.times = None, 1
        if merged:
            ids, same = np.unique(self.ids, return_inverse=True)
            if len(ids) < len(self.ids):
                self.ids, self.same = ids, same.ravel()
                self.times = np.array([np.unique(self.same[a:b], return_counts=True)[1].max(initial=1) for a, b in zip(self.edges, self.edges[1:])])
        # A word that many chunks of a block hold is a row of its scores, which is summed several times as fast as a list.
        width = np.diff(self.edges)[self.block]
        full = np.flatnonzero(self.many * DENSE_SHARE >= width) if self.same is None else np.zeros(0, np.int64)
        self.row = np.full(len(found), -1, np.int32)
        self.dense = [None] * len(words)
        full = full[np.argsort(self.block[full], kind="stable")]
        ends = np.searchsorted(self.block[full], np.arange(len(words) + 1))
        for b in range(len(words)):
            mine = full[ends[b]:ends[b + 1]]
            part = _ranges(self.first[mine], self.many[mine])
            tf = np.ones(len(part), np.uint8) if distinct else self.tfs[part]
            size = self.edges[b + 1] - self.edges[b]
            at_row = np.repeat(np.arange(len(mine)), self.many[mine])
            place = self.places[part] - self.edges[b]
            # Sums that fit into the numbers of the rows.
            most = np.bincount(place, tf, size).max(initial=0)
            rows_of = np.zeros((len(mine), size), np.uint16 if most < 1 << 16 else np.uint64)
            rows_of[at_row, place] = tf
            self.dense[b], self.row[mine] = rows_of, np.arange(len(mine))
        # No query reaches more than all that its task asks of a chunk: little, for the block of short texts.
        reach, words_of, posts = np.zeros(self.edges[-1]), np.append(0, np.cumsum(words.value_lengths().to_numpy())), np.append(0, np.cumsum(total))
        for b in range(len(words)):
            span = slice(words_of[b], words_of[b + 1])
            asks = np.flatnonzero(np.repeat(code[span] >= 0, many[span])) + posts[b]
            reach[self.edges[b]:self.edges[b + 1]] = np.bincount(
                self.places[asks] - self.edges[b], None if distinct else self.tfs[asks], self.edges[b + 1] - self.edges[b])
        if self.same is not None:
            reach = np.bincount(self.same, reach)[self.same]
        self.reach = np.maximum.reduceat(reach, self.edges[:-1]) if len(reach) else np.zeros(len(words))

    def __len__(self) -> int:
        return len(self.edges) - 1

    def bounds(self, lists: np.ndarray) -> np.ndarray:
        """The most that a chunk of each block can score with the words of these lists."""
        return np.minimum(np.bincount(self.block[lists], self.most[lists], len(self)) * self.times, self.reach)

    def scores(self, lists: np.ndarray, passing: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the chunks of these lists, given block by block, that pass and score ``least`` or more."""
        row, block = self.row[lists], self.block[lists]
        short = lists[row < 0]
        # The places of all lists, one after the other; a chunk stands once in a word's list.
        part = _ranges(self.first[short], self.many[short])
        found = np.bincount(self.places[part], None if self.tfs is None else self.tfs[part], self.edges[-1])
        if len(short) < len(lists):
            row, block = row[row >= 0], block[row >= 0]
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, z in zip(edges, edges[1:]):
                b = block[a]
                dense = self.dense[b]
                found[self.edges[b]:self.edges[b + 1]] += np.add.reduce(dense[row[a:z]], axis=0, dtype=dense.dtype)
        if self.same is not None:
            found = np.bincount(self.same, np.where(passing, found, 0), len(self.ids))
        kept = np.flatnonzero(found >= least)
        if self.same is None:
            kept = kept[passing[kept]]
        return self.ids[kept], found[kept].astype(np.int64)

    def passing(self, q: dict) -> np.ndarray:
        """The records that pass a query's filters, as ``filters.passes``: pool, component, dates, and the version of
        the vehicle unless all are asked."""
        r = self.records
        out = np.ones(self.edges[-1], bool)
        keep = lambda found: np.logical_and(out, found.fill_null(False).to_numpy(zero_copy_only=False), out=out)
        if q["scope"] != "all":
            keep(pc.is_in(r["kind"], value_set=pa.array(CAMPAIGN_KINDS, r["kind"].type)))
        for name, value, compare in (("component", "component", pc.equal), ("filed_on", "filed_from", pc.greater_equal), ("filed_on", "filed_to", pc.less_equal)):
            if q[value] is not None:
                keep(compare(r[name], pa.scalar(q[value], r[name].type)))
        if q["trims"] != "allTrims":
            for name in ("trim_key", "engine_litres", "engine_cylinders"):
                if q[f"own_{name}"] is not None:
                    keep(pc.equal(r[name], pa.scalar(q[f"own_{name}"], r[name].type)).fill_null(True))
        return out


def best_of_blocks(group: _Group, terms: np.ndarray, passing: np.ndarray, k: int, open_to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Chunks and scores of the ``k`` best of a query, and how many blocks were opened for them.

    Blocks are opened from the highest bound down, one at first, then twice as many at a time.
    ``open_to`` are the blocks that hold a passing chunk.
    """
    ids, scores, opened, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 1
    starts = group.starts[terms]
    lists = _ranges(starts, group.starts[terms + 1] - starts)
    bounds = group.bounds(lists)
    if open_to is not None:
        bounds = np.where(open_to, bounds, 0)
    order = np.argsort(-bounds, kind="stable")
    falling = -bounds[order]
    turn = np.empty(len(order), np.int16 if len(order) < 1 << 15 else np.int64)
    turn[order] = np.arange(len(order))
    turns = turn[group.block[lists]]
    lists = lists[np.argsort(turns, kind="stable")]
    edges = np.append(0, np.cumsum(np.bincount(turns, minlength=len(order))))
    while True:
        # A chunk of the same score as the last candidate may have a smaller id.
        least = int(scores[-1]) if len(scores) == k else 1
        to = min(opened + step, int(np.searchsorted(falling, -least, "right")))
        if to <= opened:
            return ids, scores, opened
        more, found = group.scores(lists[edges[opened]:edges[to]], passing, least)
        opened, step = to, 2 * step
        if len(more):
            ids, scores = np.concatenate([ids, more]), np.concatenate([scores, found])
            if len(ids) > k:
                near = scores >= np.partition(scores, len(ids) - k)[len(ids) - k]
                ids, scores = ids[near], scores[near]
            order = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[order], scores[order]


def block_scores(
    queries: DataFrame, blocks: DataFrame, k: int = CANDIDATE_WINDOW, score: str = "occurrences",
    analyzer: str = "simple", max_terms: int | None = MAX_TERMS, merged: bool = False,
) -> DataFrame:
    """``query_id, g, chunk_id, score, opened, held``: each group of blocks' best ``k`` chunks of a query.

    ``opened`` of its ``held`` blocks were looked into; a group without a chunk gives one
    row without ``chunk_id``.  Queries meet the blocks of their vehicle alone, and nothing
    is exchanged by query and chunk.  With ``merged``, rows of one ``chunk_id`` are one chunk
    and their scores are summed, as a sum over postings does.  Texts whose words are cut
    already are rows ``vehicle_id, asks, terms``: ``asks`` are the queries that ask the text,
    each with its filters, so that words move once for all of them.
    """
    if score not in ("occurrences", "distinct"):
        raise ValueError(f"unknown score {score!r}")
    if "asks" in queries.columns:
        listed = queries.select("vehicle_id", "asks", "terms").where(F.size("terms") > 0)
        counted = queries
        number = queries.schema["asks"].dataType.elementType["query_id"]
    else:
        number = queries.schema["query_id"]
        asked = queries.drop("embedding")
        if analyzer == "simple":
            # Cut in place: a text's terms need no row each.
            terms = asked.select("query_id", "vehicle_id", *ASKED, query_lexeme_array(F.col("text"), max_terms).alias("terms")).where(F.size("terms") > 0)
            every = F.array_distinct(F.flatten(F.collect_list("terms")))
        else:
            terms = query_terms(asked, analyzer=analyzer, max_terms=max_terms).withColumnRenamed("lexeme", "terms")
            every = F.collect_set("terms")
        listed = terms.groupBy("query_id", "vehicle_id", *ASKED).agg(every.alias("terms")).select(
            "vehicle_id", F.array(F.struct("query_id", *ASKED)).alias("asks"), "terms")
        # Counted without cutting a word.
        counted = asked.select("query_id", "vehicle_id", *ASKED).distinct()
    # One text a row, which moves in less room than its words; a word holds no blank.
    listed = listed.withColumn("terms", F.array_join("terms", " "))
    # Queries of one vehicle beyond what a task should hold are split too; its blocks follow.  A vehicle of many groups
    # has tasks enough, so its blocks are copied less.
    groups = blocks.groupBy("vehicle_id").agg((F.max("g") + 1).alias("groups"))
    groups = F.broadcast(groups) if is_small(groups, MAX_BROADCAST_IDS) else groups
    a_part = F.least(F.lit(QUERIES_A_GROUP), F.col("groups") * QUERIES_A_TASK)
    many = counted.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n")).join(groups, "vehicle_id").select(
        "vehicle_id", F.ceil(F.col("n") / a_part).cast("int").alias("parts"), "groups")
    # Blocks, the large side, then move once: to their group.
    many = F.broadcast(many) if is_small(many, MAX_BROADCAST_IDS) else many
    if "asks" in queries.columns:
        # Words too.
        placed = listed.join(many, "vehicle_id").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    else:
        placed = listed.join(many, "vehicle_id").join(blocks.select("vehicle_id", "g").distinct(), "vehicle_id")
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.col("asks")[0]["query_id"]), F.col("parts")).cast("int"))
    held = blocks.join(many.drop("groups"), "vehicle_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["vehicle_id", "g", "part"]
    schema = T.StructType([T.StructField("query_id", number.dataType), T.StructField("g", T.IntegerType()), T.StructField("chunk_id", T.LongType()),
                           T.StructField("score", T.LongType()), T.StructField("opened", T.IntegerType()), T.StructField("held", T.IntegerType())])

    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not asked.num_rows or not rows.num_rows:
            return to_arrow_schema(schema).empty_table()
        lists, asks = pc.split_pattern(asked.column("terms").combine_chunks(), " "), asked.column("asks").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        group = _Group(rows, coded.dictionary, score == "distinct", merged)
        codes, ends = coded.indices.to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        text = np.repeat(np.arange(len(asks)), asks.value_lengths().to_numpy())
        asks = pa.Table.from_struct_array(asks.flatten())
        number = asks.column("query_id").to_pylist()
        # Queries that ask alike follow each other, so one filter's answer is held at a time.
        filters, seen, last, passing, open_to = asks.select(ASKED).to_pylist(), set(), None, None, None
        alike = [tuple(map(str, one.values())) for one in filters]
        parts: list[list[np.ndarray]] = [[], [], []]
        numbers, opened = [], []
        for n in sorted(range(len(filters)), key=alike.__getitem__):
            if (number[n], alike[n]) in seen:
                continue
            seen.add((number[n], alike[n]))
            if alike[n] != last:
                last, passing = alike[n], group.passing(filters[n])
                open_to = np.logical_or.reduceat(passing, group.edges[:-1])
            ids, scores, looked = best_of_blocks(group, codes[ends[text[n]]:ends[text[n] + 1]], passing, k, open_to)
            if not len(ids):
                ids, scores = np.zeros(1, np.int64), np.zeros(1, np.int64)
            for part, values in zip(parts, (np.full(len(ids), n, np.int32), ids, scores), strict=True):
                part.append(values)
            opened.append(looked)
            numbers.append(len(ids))
        wanted = to_arrow_schema(schema)
        row, ids, scores = (np.concatenate([np.zeros(0, np.int64), *part]).astype(np.int64) for part in parts)
        none = scores == 0
        columns = [asks.column("query_id").take(pa.array(row)), asked.column("g").take(pa.array(text[row])), pa.array(ids, mask=none),
                   pa.array(scores, mask=none), np.repeat(np.array(opened, np.int32), numbers), np.full(len(row), len(group), np.int32)]
        return pa.table([pa.chunked_array([c]).cast(f.type) if not isinstance(c, pa.ChunkedArray) else c.cast(f.type)
                         for c, f in zip(columns, wanted, strict=True)], names=schema.names)

    placed = placed.select(*[F.col(c).alias(c) for c in (*keys, "asks", "terms")])
    return placed.groupBy(keys).cogroup(held.groupBy(keys)).applyInArrow(work, schema)


def block_ranking(queries: DataFrame, blocks: DataFrame, k: int = CANDIDATE_WINDOW, **options) -> DataFrame:
    """``query_id, chunk_id, sparse_rank``: what ``sparse_ranking`` gives, from blocks."""
    return rank_sparse(block_scores(queries, blocks, k, **options).where("chunk_id IS NOT NULL"), k)


def opened_share(scores: DataFrame) -> DataFrame:
    """``query_id, opened, held``: how many blocks a query looked into, of all that its vehicle has."""
    return scores.select("query_id", "g", "opened", "held").distinct().groupBy("query_id").agg(
        F.sum("opened").alias("opened"), F.sum("held").alias("held"))
