"""Similarity join of word-shingle sets by chosen paths: recursive splitting on sampled shared tokens, in many runs.

Documents with one set of shingles are one class.  A run splits the classes: at each
node of its tree one or two coordinates of the sets' min-hashes are sampled (1 / the
wanted similarity on average), and a set goes to the child of its least token there,
so two sets part where they do not share it.  Buckets that are small are compared pair by
pair; others are split again, and what is still large at the last level is compared in
blocks.  The number of runs follows from the target recall at the last level,
averaged over how many of its min-hashes a pair shares.

No pair is ever a row.  A bucket's members meet in blocks of bounded size; a pair that
meets in several buckets counts in the first alone, which both members know from
the lists of their buckets.  Estimates from the min-hashes only say which members
must be sent with their sets; every link is an exact Jaccard comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut_lineage
from .common import over_batches
from .hashing import mixed, word_hashes

WORDS = 5
LIKE = 0.8
HASHES = 64
RECALL = 0.99999
LEVELS = 4
# Members of a bucket that is not split further, of a block, and shingles of a block.
SMALL_BUCKET = 2048
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
# Min-hashes that must agree for a pair to be compared exactly: half of them is six deviations below 0.8.
LEAST_EQUAL = 0.5

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _rng.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


# ---- sets ------------------------------------------------------------------------------------------------------

def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted hashes of each text's runs of five words; a shorter text is one run, one without words has none."""
    hashes, offsets = word_hashes(texts, (), lower=False)
    words = np.append(hashes[:, 0], np.zeros(WORDS, np.uint64))
    n = len(hashes)
    runs = np.zeros(n, np.uint64)
    end = np.repeat(offsets[1:], np.diff(offsets))
    for k in range(WORDS):
        runs += np.where(np.arange(n) + k < end, words[k:n + k], np.uint64(0)) * _STEPS[k]
    runs = mixed(runs)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out.append(np.unique(runs[a:max(b - WORDS + 1, min(a + 1, b))]))
    return out


def set_key(tokens: np.ndarray) -> bytes | None:
    return blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """``[set, hash]``; sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat((flat * f) >> np.uint64(32), starts) for f in _FACTORS], axis=1).astype("<u4")


def keyed(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", hashes: bool = True) -> DataFrame:
    """``doc_id, key`` (of its set of shingles, null without words), and with ``hashes`` ``n`` (shingles) and ``sig``."""
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema.add("key", "binary")
    if hashes:
        schema = schema.add("n", "long").add("sig", "binary")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1).to_pylist())
        columns = [batch.column(0), pa.array(map(set_key, sets), pa.binary())]
        if hashes:
            full = [k for k, s in enumerate(sets) if len(s)]
            sigs: list[bytes | None] = [None] * len(sets)
            if full:
                for k, row in zip(full, min_hashes([sets[k] for k in full]), strict=True):
                    sigs[k] = row.tobytes()
            columns += [pa.array(map(len, sets), pa.int64()), pa.array(sigs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return over_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), schema, work, size=2 << 20)


def with_keys(docs: DataFrame, made: str, *, text: str = "text") -> DataFrame:
    """Every row, whole, with the key of its set of shingles as ``made``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(made, T.BinaryType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [set_key(s) for s in shingle_sets(batch.column(batch.num_columns - 1).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.binary())], schema.names)

    return over_batches(docs.select("*", F.col(text).alias("_shingled")), schema, work, size=2 << 20)


# ---- chosen paths ----------------------------------------------------------------------------------------------

def missed(runs: int, like: float, levels: int) -> float:
    """The probability that a pair of similarity ``like`` is not found by ``runs`` runs, if it must pass all levels.

    All runs and nodes pick from the same min-hashes, so their draws are independent
    only for a given number of equal ones, which is binomial.  The roots of ``HASHES``
    runs are different coordinates, and so are the two of a node.
    """
    second = 1 / like - 1
    full, rest = divmod(runs, HASHES)
    total = 0.0
    for equal in range(HASHES + 1):
        weight = math.comb(HASHES, equal) * like**equal * (1 - like) ** (HASHES - equal)
        if equal < LEAST_EQUAL * HASHES:  # not compared
            total += weight
            continue
        unequal, meets = HASHES - equal, 1.0
        for _ in range(levels):
            # Of a node whose first coordinate is an equal one, and of one whose first is not.
            with_first = (1 - meets) * (1 - second * (equal - 1) / (HASHES - 1) * meets)
            without = 1 - second * equal / (HASHES - 1) * meets
            meets = 1 - (equal * with_first + unequal * without) / HASHES
        roots = sum(
            math.comb(equal, k) * math.comb(unequal, rest - k) / math.comb(HASHES, rest) * with_first**k * without ** (rest - k)
            for k in range(rest + 1))
        total += weight * roots * (with_first**equal * without**unequal) ** full
    return total


def runs_for(recall: float, like: float, levels: int) -> int:
    """The least number of runs that find a pair of similarity ``like`` with probability ``recall``, if it must pass all levels."""
    for runs in range(1, 64 * HASHES):
        if missed(runs, like, levels) <= 1 - recall:
            return runs
    raise ValueError(f"{HASHES} min-hashes cannot reach a recall of {recall} at similarity {like}")


def children(node: np.ndarray, sig: np.ndarray, like: float, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the child buckets they go to; a node's coordinates are sampled by its own number."""
    coordinate = (mixed(node + np.uint64(1)) % np.uint64(HASHES)).astype(np.int64) if first is None else first
    other = (mixed(node + np.uint64(2)) % np.uint64(HASHES)).astype(np.int64)
    other = np.where(other == coordinate, (other + 1) % HASHES, other)
    also = np.flatnonzero((mixed(node + np.uint64(3)) >> np.uint64(11)).astype(float) / (1 << 53) < 1 / like - 1)
    rows = np.concatenate([np.arange(len(node)), also])
    chosen = np.concatenate([coordinate, other[also]])
    value = sig[rows, chosen].astype(np.uint64)
    return rows, mixed(mixed(node[rows] ^ (value << np.uint64(17))) + chosen.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def _split(rows: DataFrame, like: float, runs: int | None) -> DataFrame:
    """``bucket, key``: the first level of every run, or the children of ``bucket`` for rows that have one."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = _sigs(batch.column(batch.num_columns - 1))
        keys = batch.column(0)
        if runs is None:
            taken, buckets = children(batch.column(1).to_numpy().view(np.uint64), sig, like)
        else:
            parts = [children(np.full(len(sig), mixed(np.array([run + 1], np.uint64))[0]), sig, like, np.full(len(sig), run % HASHES))
                     for run in range(runs)]
            taken, buckets = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(buckets.view(np.int64)), keys.take(pa.array(taken))], ["bucket", "key"])

    columns = ["key", "sig"] if runs is not None else ["key", "bucket", "sig"]
    return over_batches(rows.select(*columns), "bucket long, key binary", work, size=1 << 40)


def leaves(classes: DataFrame, *, like: float = LIKE, recall: float = RECALL, levels: int = LEVELS, small: int = SMALL_BUCKET) -> DataFrame:
    """``leaf, key, size, shingles``: the members of every bucket that is compared, buckets with the same members once."""
    found = None
    rows = _split(classes, like, runs_for(recall, like, levels))
    for level in range(1, levels + 1):
        # Written, so that the join can split a bucket that holds a third of all classes.
        sizes = cut_lineage(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        members = cut_lineage(rows.join(sizes, "bucket"))
        ready = members if level == levels else members.where(F.col("size") <= small)
        found = ready if found is None else found.unionByName(ready)
        large = members.where(F.col("size") > small)
        if level == levels or large.isEmpty():
            break
        rows = _split(large.select("bucket", "key").join(classes.select("key", "sig"), "key"), like, None)
    marked = found.join(classes.select("key", "n"), "key")
    same = marked.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("key")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit("leaf"), "key")).alias("y"))
    once = cut_lineage(same.groupBy("size", "shingles", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size", "shingles"))
    return found.select("bucket", "key").join(once, "bucket").select(F.col("bucket").alias("leaf"), "key", "size", "shingles")


# ---- comparison in blocks ---------------------------------------------------------------------------------------

def blocks(members: DataFrame, seed: str) -> DataFrame:
    """Members once for each pair of blocks of their leaf, ``bi <= bj``, that they are in (as ``mine``)."""
    count = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    count = F.least(count, F.col("size").cast("int"))
    mine = F.pmod(F.xxhash64(F.lit(seed), "key"), count).cast("int")
    return (
        members.withColumn("_count", count).withColumn("mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
        .withColumn("bi", F.least("mine", "_other")).withColumn("bj", F.greatest("mine", "_other"))
        .drop("_count", "_other", "size", "shingles")
    )


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (leaf, bi, bj), from batches sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        ids = np.column_stack([table.column(c).to_numpy() for c in ("leaf", "bi", "bj")])
        edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist()]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, b - a)
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def owned(group: pa.Table) -> np.ndarray:
    """``[x, y]``: whether the pair belongs to this group: across its blocks (or within its one), and in no leaf before."""
    m = group.num_rows
    leaf, bi, bj = (group.column(c)[0].as_py() for c in ("leaf", "bi", "bj"))
    out = ~np.eye(m, dtype=bool)
    if bi != bj:
        mine = group.column("mine").to_numpy()
        out &= mine[:, None] != mine[None, :]
    lists = group.column("leaves").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    flat = flat[offsets[0]:offsets[-1]]
    owner = np.repeat(np.arange(m), np.diff(offsets))
    before = flat < leaf
    values, which, times = np.unique(flat[before], return_inverse=True, return_counts=True)
    common = times[which.ravel()] > 1
    if common.any():
        has = np.zeros((m, len(values)), np.float32)
        has[owner[before][common], which.ravel()[common]] = 1
        has = has[:, times > 1]
        out &= (has @ has.T) == 0
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("leaf", "bi", "bj").sortWithinPartitions("leaf", "bi", "bj")


def wanted(rows: DataFrame, least_equal: float = LEAST_EQUAL) -> DataFrame:
    """``leaf, bi, bj, mine, key`` of members with an owned pair that the min-hashes do not rule out."""
    def run(batches):
        for group in groups(batches):
            pairs = owned(group)
            sig = _sigs(group.column("sig"))
            equal = np.zeros(pairs.shape, np.uint8)
            for k in range(HASHES):
                equal += sig[:, k, None] == sig[None, :, k]
            keep = (pairs & (equal >= least_equal * HASHES)).any(1)
            if keep.any():
                yield from group.select(["leaf", "bi", "bj", "mine", "key"]).filter(pa.array(keep)).to_batches()

    return _dealt(rows).mapInArrow(run, "leaf long, bi int, bj int, mine int, key binary")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """``[x, y]``: the number of tokens that two sets share, for all pairs of a block."""
    m = len(sets)
    owner = np.repeat(np.arange(m), list(map(len, sets)))
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    which = which.ravel()
    shared = times[which] > 1
    owner, which = owner[shared], (np.cumsum(times > 1) - 1)[which[shared]]
    out = np.zeros((m, m))
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    step = max(1, (1 << 22) // m)
    for first in range(0, int(which[-1]) + 1 if len(which) else 0, step):
        a, b = np.searchsorted(which, [first, first + step])
        has = np.zeros((m, step), np.float32)
        has[owner[a:b], which[a:b] - first] = 1
        out += has @ has.T
    return out


def compare(rows: DataFrame, like: float = LIKE) -> DataFrame:
    """``key, links, root``: for each member its owned links in a group and the least key it is connected with there."""
    def run(batches):
        for group in groups(batches):
            keys = group.column("key").to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in group.column("tokens").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            shared = intersections(sets)
            linked = owned(group) & (shared >= like * (sizes[:, None] + sizes[None, :] - shared) - 1e-9)
            links = linked.sum(1)
            some = np.flatnonzero(links)
            if not len(some):
                continue
            rank = np.empty(len(keys), np.int64)
            rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
            root = rank.copy()
            while True:
                least = np.where(linked, root[None, :], len(keys)).min(1)
                new = np.minimum(root, least)
                if (new == root).all():
                    break
                root = new
            by_rank = sorted(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[k] for k in some], pa.binary()), pa.array(links[some], pa.int64()),
                 pa.array([by_rank[root[k]] for k in some], pa.binary())], ["key", "links", "root"])

    return _dealt(rows).mapInArrow(run, "key binary, links long, root binary")


def _tokens(docs: DataFrame, ids: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``key, tokens`` of the documents that stand for the wanted classes."""
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(
        ids.select(F.col("rep").alias("_rep")).distinct().hint("merge"), F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("_id", "_text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays(
            [pa.array(map(set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "tokens"])

    made = over_batches(found, "key binary, tokens binary", work, size=2 << 20)
    return made.dropDuplicates(["key"])


def connected(edges: DataFrame) -> DataFrame:
    """``key, label``: the least key that each key of ``edges`` (``key, root``) is connected with.

    Each round takes the least label among the neighbours and then the label's own
    label; a round writes one table of numbers a key.  Nothing reaches the driver but
    whether a label changed.
    """
    both = cut_lineage(edges.where(F.col("key") != F.col("root")).select("key", "root").distinct())
    both = cut_lineage(both.unionByName(both.select(F.col("root").alias("key"), F.col("key").alias("root"))).distinct())
    labels = cut_lineage(both.groupBy("key").agg(F.min("root").alias("least")).select("key", F.least("key", "least").alias("label")))
    while True:
        seen = labels.select(F.col("key").alias("root"), F.col("label").alias("seen"))
        near = both.join(seen, "root").groupBy("key").agg(F.min("seen").alias("seen"))
        better = cut_lineage(labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "seen").alias("label")))
        jump = better.select(F.col("key").alias("label"), F.col("label").alias("further"))
        labels = cut_lineage(better.join(jump, "label", "left").select(
            "key", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        if labels.where(F.col("old") != F.col("label")).isEmpty():
            return labels.select("key", "label")
        labels = labels.select("key", "label")


def similar(docs: DataFrame, *, like: float = LIKE, recall: float = RECALL, levels: int = LEVELS, small: int = SMALL_BUCKET,
            text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``doc_id, key`` of every row, and ``key, copy_id, copies, n_links, class_id, class_key`` of every class of copies.

    A class holds the documents with one set of five-word shingles; ``copy_id`` is its
    least id, ``n_links`` the number of other classes whose sets are ``like`` alike or
    more.  ``class_id`` is the least id, and ``class_key`` its class, of all that are
    connected by links.  A text of one to four words is a single shingle.  A text
    without words (null, empty, blank) has a null key and is in no class.  Rows with
    equal ids are documents each; a null id is the least of none, so a class of nulls
    alone has a null id.  Other columns are not read.  Empty tables give empty tables.
    """
    rows = cut_lineage(keyed(docs, text=text, doc_id=doc_id))
    full = rows.where(F.col("key").isNotNull())
    classes = cut_lineage(full.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig")))
    members = cut_lineage(leaves(classes, like=like, recall=recall, levels=levels, small=small))
    lists = members.groupBy("key").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))  # a few dozen at most
    info = cut_lineage(lists.join(classes.select("key", "sig", "rep"), "key"))
    spread = blocks(members, "block")
    needed = cut_lineage(wanted(spread.join(info.select("key", "leaves", "sig"), "key")))
    ids = info.select("key", "rep").join(needed.select("key").distinct(), "key", "left_semi")
    tokens = cut_lineage(_tokens(docs, ids, text, doc_id))
    found = cut_lineage(compare(needed.join(info.select("key", "leaves"), "key").join(tokens, "key"), like))
    links = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    labels = connected(found.select("key", "root"))
    known = classes.select("key", "rep", "copies").join(links, "key", "left").join(labels, "key", "left").select(
        "key", "rep", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "key").alias("label"))
    heads = known.groupBy("label").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "key"))).alias("head"), F.min("key").alias("any"))
    result = cut_lineage(known.join(heads, "label").select(
        "key", F.col("rep").alias("copy_id"), "copies", "n_links", F.col("head.rep").alias("class_id"),
        F.coalesce("head.key", "any").alias("class_key")))
    return rows.select("doc_id", "key"), result


def join_documents(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: ``doc_id, class_id, copy_id, copies, n_links`` (see ``similar``).

    A document without words is its own class and copy and has no links.
    """
    rows, classes = similar(docs, **options)
    return rows.join(classes.drop("class_key"), "key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
