"""Probability of a text, in which every segmentation of a word into pieces of an existing vocabulary counts.

A text is its words and one end.  A word is spelled behind a word mark by pieces
of a given vocabulary, drawn one after another by their weights; its lattice
probability is the sum over all ways to cut it, by one forward recursion in log
space.  The mark is only ever a piece's first character, so a lattice ends where
the next word begins and the lattice probabilities of all words sum to one.  A
character without a piece of its own is spelled by its bytes.

The vocabulary is given, with the weights its own scores suggest.  What is learned
from training texts: the pieces' weights, by expected counts (forward and backward)
over every counted word; and how often each word occurs.  A counted word is one
more segmentation of itself: counts are discounted, and what the discount sets free
goes to the lattice, so the result is still a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import fold, kept_columns, over_batches

MARK = "▁"
LOG10 = math.log(10)
# Words a worker remembers by themselves; all others are counted through a shuffle.
FREQUENT_WORDS = 300_000
LONGEST_FREQUENT = 48
# Counts a task holds before it passes them on.
COUNTED_AT_ONCE = 400_000


# ---- the lattice of many words at once -------------------------------------------------------------------------

@dataclass
class Lattice:
    """The pieces of a vocabulary as a trie over characters, in arrays.

    Place 0 of the trie is its root.  ``edges`` maps (place, character) to the next
    place by a sorted key; ``piece`` gives the piece that ends at a place, -1 for
    none.  Pieces 0 to 255 are the bytes.
    """

    edges: np.ndarray
    targets: np.ndarray
    piece: np.ndarray
    longest: int
    size: int
    start: np.ndarray  # log weights that the vocabulary itself suggests

    @classmethod
    def of(cls, pieces: list[tuple[str, float]]) -> Lattice:
        """``pieces``: normal text alone, each with its log weight up to a constant."""
        places: dict[tuple[int, str], int] = {}
        ends = {}
        weights = []
        for text, score in pieces:
            if not text or MARK in text[1:]:
                continue
            place = 0
            for c in text:
                place = places.setdefault((place, c), len(places) + 1)
            if place not in ends:
                ends[place] = 256 + len(weights)
                weights.append(score)
        keys = np.array([place << 21 | ord(c) for place, c in places], np.int64)
        order = np.argsort(keys)
        found = np.full(len(places) + 1, -1, np.int32)
        for place, k in ends.items():
            found[place] = k
        floor = min(weights, default=0.0)
        start = np.array([floor] * 256 + weights)
        start -= np.logaddexp.reduce(start)
        return cls(np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array([*places.values()], np.int32)[order], 0).astype(np.int32),
                   found, max((len(t) for t, _ in pieces), default=1), 256 + len(weights), start)

    def steps(self, chars: np.ndarray) -> list[np.ndarray]:
        """For words of one length (columns of code points, the mark on top): ``steps[k][i, w]`` is the piece of the
        ``k + 1`` characters from ``i`` on, -1 for none."""
        length, words = chars.shape
        flat = chars.ravel()
        at, place, found = np.arange(flat.size), np.zeros(flat.size, np.int64), []
        for k in range(min(self.longest, length)):
            inside = at < (length - k) * words
            at, place = at[inside], place[inside]
            key = place << 21 | flat[at + k * words]
            edge = np.searchsorted(self.edges, key)
            hit = self.edges[edge] == key
            at, place = at[hit], self.targets[edge[hit]].astype(np.int64)
            here = np.full(flat.size, -1, np.int32)
            here[at] = self.piece[place]
            found.append(here.reshape(length, words))
            if not len(at):
                break
        return found

    def weigh(self, chars: np.ndarray, log_p: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word; with ``counts``, also the expected number of each piece over all of them."""
        length, words = chars.shape
        steps = self.steps(chars)
        scores = [np.where(s >= 0, log_p[s], -np.inf) for s in steps]
        i, w = np.nonzero(steps[0] < 0)  # characters without a piece of their own are spelled by their bytes
        unknown, which = np.unique(chars[i, w], return_inverse=True)
        spelling = [list(chr(c).encode(errors="replace")) for c in unknown.tolist()]
        scores[0][i, w] = np.array([log_p[b].sum() for b in spelling])[which.ravel()] if len(unknown) else 0.0
        forward = np.full((length + 1, words), -np.inf)
        forward[0] = 0
        for j in range(1, length + 1):
            ways = [forward[j - 1 - k] + scores[k][j - 1 - k] for k in range(min(j, len(scores)))]
            forward[j] = log_sum(ways)
        expected = np.zeros(self.size)
        if counts is not None:
            backward = np.full((length + 1, words), -np.inf)
            backward[length] = 0
            for at in range(length - 1, -1, -1):
                ways = [scores[k][at] + backward[at + 1 + k] for k in range(min(length - at, len(scores)))]
                backward[at] = log_sum(ways)
            for k, (pieces, score) in enumerate(zip(steps, scores, strict=True)):
                at, word = np.nonzero(pieces >= 0)
                share = np.exp(forward[at, word] + score[at, word] + backward[at + 1 + k, word] - forward[length, word])
                expected += np.bincount(pieces[at, word], share * counts[word], self.size)
            share = np.exp(forward[i, w] + scores[0][i, w] + backward[i + 1, w] - forward[length, w]) * counts[w]
            for spelled, amount in zip(spelling, np.bincount(which.ravel(), share, len(unknown)).tolist() if len(unknown) else [], strict=True):
                for b in spelled:
                    expected[b] += amount
        return forward[length], expected


def log_sum(ways: list[np.ndarray]) -> np.ndarray:
    """Log of the sum over ways; the first way is always open."""
    if len(ways) == 1:
        return ways[0]
    most = np.maximum.reduce(ways)
    total = np.zeros_like(most)
    for way in ways:
        total += np.exp(way - most)
    return most + np.log(total)


def by_length(words: list[bytes], size: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length together: their places in the list, and their characters behind a word mark, in columns."""
    texts = [w.decode(errors="replace").replace(MARK, "￿") for w in words]
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(lengths, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(lengths[order])) + 1).tolist(), len(order)] if len(order) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        length = int(lengths[order[a]])
        step = max(1, size // (length + 1))
        for at in range(a, b, step):
            places = order[at:min(b, at + step)]
            flat = np.frombuffer("".join(MARK + texts[p] for p in places.tolist()).encode("utf-32-le", "replace"), "<u4")
            yield places, np.ascontiguousarray(flat.astype(np.int64).reshape(len(places), length + 1).T)


def word_logs(words: list[bytes], lattice: Lattice, log_p: np.ndarray) -> np.ndarray:
    """Natural log probability of each word."""
    out = np.zeros(len(words))
    for places, chars in by_length(words):
        out[places] = lattice.weigh(chars, log_p)[0]
    return out


# ---- over a corpus ---------------------------------------------------------------------------------------------

def count_words(docs: DataFrame, train: str, *, text: str = "text") -> DataFrame:
    """``word`` (bytes, A-Z lower-cased), ``trained`` (times in rows whose ``train`` is true) of every word of all rows."""
    def run(batches):
        known, held = Counter(), set()
        for batch in batches:
            for is_train, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (value.as_py() or "").encode().lower().split()
                known.update(words) if is_train else held.update(words)
                if len(known) + len(held) >= COUNTED_AT_ONCE:
                    yield counted(known, held)
                    known, held = Counter(), set()
        yield counted(known, held)

    def counted(known: Counter, held: set) -> pa.RecordBatch:
        only = [w for w in held if w not in known]
        return pa.RecordBatch.from_arrays(
            [pa.array([*known, *only], pa.binary()), pa.array([*known.values(), *[0] * len(only)], pa.int64())], ["word", "trained"])

    parts = docs.select(train, text).mapInArrow(run, "word binary, trained long")
    return parts.groupBy("word").agg(F.sum("trained").alias("trained"))


def expectations(counted: DataFrame, lattice, log_p: np.ndarray) -> np.ndarray:
    """Expected number of each piece over the counted words, once each; the vocabulary's size bounds what is sent."""
    def run(batches):
        total = np.zeros(lattice.value.size)
        for batch in batches:
            for places, chars in by_length(batch.column(0).to_pylist()):
                total += lattice.value.weigh(chars, log_p, np.ones(len(places)))[1]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["piece", "expected"])

    sums = (counted.where("trained > 0").select("word").mapInArrow(run, "piece int, expected double")
            .groupBy("piece").agg(F.sum("expected").alias("expected")).collect())
    out = np.zeros(lattice.value.size)
    for piece, expected in sums:
        out[piece] = expected
    return out


def learn(counted: DataFrame, lattice, *, rounds: int, smoothing: float) -> np.ndarray:
    """Log weight of each piece, after ``rounds`` of expectation and maximisation.

    The lattice gets what the discount takes from each word, the same from nearly
    all, so each counted word has one vote.
    """
    log_p = lattice.value.start
    for _ in range(rounds):
        expected = expectations(counted, lattice, log_p) + smoothing
        log_p = np.log(expected / expected.sum())
    return log_p


@dataclass
class Counts:
    """What the training texts hold: words, different words, words found once and twice, texts."""

    words: int
    types: int
    once: int
    twice: int
    texts: int

    @property
    def tokens(self) -> int:
        return self.words + self.texts

    @property
    def base_scale(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.types + (self.texts > 0) + 1))

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once else 0.5

    @property
    def end(self) -> float:
        return (self.texts + 0.5) / (self.tokens + 1)

    def log10(self, counted, lattice_log):
        """Log10 probability of a word counted so often, with this natural log lattice probability."""
        inside = math.log1p(-self.end)
        if not self.words:
            return (inside + lattice_log) / LOG10
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counted - self.discount, 0) / self.words)
        return (inside + np.logaddexp(whole, math.log(self.discount * self.types / self.words) + lattice_log)) / LOG10


@dataclass
class Frequent:
    """The most frequent words with what each contributes."""

    place: dict[bytes, int]
    known: np.ndarray
    base: np.ndarray
    score: np.ndarray


_frequent: dict[int, Frequent] = {}


def score_texts(docs: DataFrame, pieces: list[tuple[str, float]], *, folds: int = 5, held: int = 1, text: str = "text",
                doc_id: str = "doc_id", rounds: int = 2, smoothing: float = 0.05, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """Every row without its text, with ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Rows whose ``fold(doc_id)`` is ``held`` teach nothing.  ``score`` is the log10
    probability of the whole text; ``base_score`` that of single words by their
    smoothed counts, in which the end is one more word.  A null or empty text is the
    end alone.  Repeated rows are scored each; a null id counts as the empty text
    when folds are dealt.  Columns named like an output are replaced.  An empty table
    gives an empty table; without training texts the vocabulary's own weights hold.

    The most frequent words (at most ``frequent_words``, each of at most 48 bytes)
    are broadcast; every other word of every text meets its count in a shuffled join.
    """
    made = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in kept_columns(docs, made) if c != text]
    context = docs.sparkSession.sparkContext
    split = docs.select(F.struct(*keep).alias("_row"), (fold(F.col(doc_id), folds) == held).alias("_held"), F.col(text).alias("_text"))
    training = split.withColumn("_train", ~F.col("_held"))
    counted = cut_lineage(count_words(training, "_train", text="_text"))
    seen = counted.where("trained > 0").agg(
        F.coalesce(F.sum("trained"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("trained") == 1), F.count_if(F.col("trained") == 2)).first()
    counts = Counts(*seen, training.where("_train").count())
    lattice = context.broadcast(Lattice.of(pieces))
    log_p = learn(counted, lattice, rounds=rounds if counts.types else 0, smoothing=smoothing)
    weights = context.broadcast(log_p)

    def add_logs(batch: pa.RecordBatch) -> pa.RecordBatch:
        logs = word_logs(batch.column(0).to_pylist(), lattice.value, weights.value)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts.log10(batch.column(1).to_numpy(), logs))], ["word", "trained", "log"])

    common = least_count(counted, frequent_words)
    frequent = (F.col("trained") >= common) & (F.octet_length("word") <= LONGEST_FREQUENT)
    top = over_batches(counted.where(frequent).select("word", "trained"), "word binary, trained long, log double", add_logs).toArrow()
    packed = context.broadcast((top.column(0).to_pylist(), top.column(1).to_numpy(), top.column(2).to_numpy()))
    scale = counts.base_scale
    end_known, end_base, end_log = int(counts.texts > 0), math.log10(counts.texts + 0.5) - scale, math.log10(counts.end)

    def run(batches):
        key = id(packed)
        if key not in _frequent:
            words, often, logs = packed.value
            _frequent.clear()
            _frequent[key] = Frequent({w: k for k, w in enumerate(words)}, np.append(often > 0, False).astype(np.int64),
                                      np.append(np.log10(often + 0.5) - scale, 0.0), np.append(logs, 0.0))
        yield from _score(batches, _frequent[key])

    def _score(batches, known: Frequent):
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, rare = [], []
            for value in batch.column(2):
                words = (value.as_py() or "").encode().lower().split()
                at = np.fromiter((known.place.get(w, -1) for w in words), np.int64, len(words))
                others = Counter(words[i] for i in np.flatnonzero(at < 0).tolist())
                rows.append((len(words) + 1, int(known.known[at].sum()) + end_known, float(known.base[at].sum()) + end_base,
                             float(known.score[at].sum()) + end_log))
                rare.append(others)
            ids = [(task << 33) + row + k for k in range(batch.num_rows)]
            row += batch.num_rows
            owners = [i for i, others in zip(ids, rare, strict=True) for _ in others]
            n, m = batch.num_rows, len(owners)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            # A space cannot be part of a word, so a document's own row meets no word and is dealt out by its number.
            yield pa.RecordBatch.from_arrays([
                pa.array([*ids, *owners], pa.int64()),
                pa.concat_arrays([batch.column(0), pa.nulls(m, batch.column(0).type)]),
                pa.concat_arrays([batch.column(1), pa.nulls(m, pa.bool_())]),
                pa.array([*(b" %d" % i for i in ids), *(w for others in rare for w in others)], pa.binary()),
                pa.array([*[0] * n, *(c for others in rare for c in others.values())], pa.int64()),
                *(pa.concat_arrays([pa.array(c, t), pa.nulls(m, t)]) for c, t in zip(
                    columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)),
            ], ["_id", "_row", "_held", "word", "times", "n_tokens", "n_known", "base_score", "score"])

    schema = (split.select("_row", "_held").schema)
    schema = ("_id long, _row " + schema["_row"].dataType.simpleString()
              + ", _held boolean, word binary, times long, n_tokens long, n_known long, base_score double, score double")
    parts = split.mapInArrow(run, schema)
    rest = over_batches(counted.where(~frequent).select("word", "trained"), "word binary, trained long, log double", add_logs)
    times = F.coalesce("times", F.lit(0))
    met = parts.join(rest, "word", "left").select(
        "_id", "_row", "_held", "n_tokens",
        F.coalesce("n_known", F.when(F.col("trained") > 0, times).otherwise(0)).alias("n_known"),
        F.coalesce("base_score", times * (F.log10(F.col("trained") + 0.5) - scale)).alias("base_score"),
        F.coalesce("score", times * F.col("log")).alias("score"),
    )
    return met.groupBy("_id").agg(
        F.max("_row").alias("_row"), F.bool_or("_held").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    ).select("_row.*", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def least_count(counted: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` words were counted that often."""
    sizes = dict(counted.where("trained > 0").groupBy(F.floor(F.log2("trained")).alias("power")).count().collect())
    total, power = 0, max(sizes, default=0) + 1
    while power > 0 and total + sizes.get(power - 1, 0) <= most:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << power
