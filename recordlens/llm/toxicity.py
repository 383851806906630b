"""Toxicity by a convolutional text classifier, trained in numpy, with a threshold for each language.

A word is the sum of hashed vectors (the word and its first letters).  Filters of
several widths slide over a text's word vectors, the largest answer of each filter
anywhere in the whole text is kept, and one linear layer gives a logit.  The
thresholds are calibrated on labelled texts that training did not see, one for each
language that function words tell; a score is the logit's distance from its
language's threshold, put so that the threshold is ``CUT``.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_folder
from .common import fold, kept_columns, one_text_each, over_batches
from .hashing import PREFIXES, hash_of, word_hashes

BUCKETS = 1 << 16
WIDTH = 8  # of a word's vector
FILTERS = 8  # for each size
SIZES = (1, 2, 3)
CUT = 0.7
# Texts of the training sample that must share a bucket for it to have a vector.
LEAST_TEXTS = 4
# Labelled texts that one task trains on at a time; all labelled texts are dealt over tasks.
TEXTS_A_TASK = 4000
# Buckets for each of them: two parts in one bucket are trained one after the other.
BUCKETS_A_PART = 3
# Rounds over the texts of one task; texts of many tasks are so many more that fewer rounds do.
ROUNDS, SHARED_ROUNDS, RATE, SEED = 12, 4, 0.1, 5
# Numbers of an array that are averaged together.
STEP = 1 << 15
# Logits are counted in bins of this width where thresholds are sought.
BIN = 0.001
# Function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as this by are on be at from",
    "de": "der die und das den von zu mit ist auf ein eine nicht des dem im für als auch",
    "fr": "le la les et des un une est que dans pour pas sur au du qui ce plus par",
    "es": "el los las una que es por con para del se su al lo como más pero sus un",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _language_table() -> np.ndarray:
    """Bits of the languages that a bucket's word belongs to."""
    out = np.zeros(BUCKETS, np.uint8)
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for word in words.split():
            out[hash_of(word) % BUCKETS] |= 1 << k
    return out


@dataclass
class Model:
    vectors: np.ndarray
    filters: list[np.ndarray]  # [filter, place in the filter, vector]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    languages: np.ndarray = field(default_factory=_language_table)

    @classmethod
    def new(cls, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        pooled = FILTERS * len(SIZES)
        return cls(rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32),
                   [rng.normal(0, 0.4, (FILTERS, size, WIDTH)).astype(np.float32) for size in SIZES],
                   np.zeros(pooled, np.float32), rng.normal(0, 0.3, pooled).astype(np.float32))

    def words(self, places: np.ndarray) -> np.ndarray:
        out = self.vectors[places[:, 0]]
        for k in range(1, places.shape[1]):
            out = out + self.vectors[places[:, k]]
        return out

    def answers(self, x: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each size, every filter's answer where it begins; beyond a text's end there is nothing to see."""
        last = np.searchsorted(offsets, np.arange(len(x)), "right")
        end = offsets[np.minimum(last, len(offsets) - 1)]
        found = []
        for filters in self.filters:
            total = x @ filters[:, 0].T
            for k in range(1, filters.shape[1]):
                part = x[k:] @ filters[:, k].T
                part[np.arange(len(x) - k) + k >= end[:len(x) - k]] = 0
                total[:len(x) - k] += part
            found.append(total)
        return found

    def pool(self, places: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray] | None, np.ndarray]:
        """The largest answer of each filter in each text, at least 0."""
        texts = len(offsets) - 1
        pooled = np.zeros((texts, len(self.bias)), np.float32)
        x = self.words(places)
        full = np.flatnonzero(np.diff(offsets) > 0)
        answers = self.answers(x, offsets) if len(x) else None
        if answers is not None:
            joined = np.concatenate([np.maximum.reduceat(a, offsets[full], axis=0) for a in answers], axis=1)
            pooled[full] = np.maximum(joined + self.bias, 0)
        return pooled, answers, x

    def logits(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.pool(places, offsets)[0] @ self.out + self.out_bias

    def language(self, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bits = self.languages[places[:, 0]]
        votes = np.stack([np.diff(np.append(0, np.cumsum(bits >> k & 1))[offsets]) for k in range(len(FUNCTION_WORDS))], axis=1)
        return np.where(votes.max(1) > 0, votes.argmax(1), len(FUNCTION_WORDS))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        places, offsets = look_up(texts)
        z = self.logits(places, offsets)
        limits = np.array([self.thresholds.get(name, self.thresholds.get("all", 0.0)) for name in LANGUAGES])
        return 1 / (1 + np.exp(-np.clip(z - limits[self.language(places, offsets)] + math.log(CUT / (1 - CUT)), -500, 500)))


def look_up(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    hashes, offsets = word_hashes(texts, PREFIXES)
    return (hashes % np.uint64(BUCKETS)).astype(np.int32), offsets


# A model's arrays, and beside each what Adagrad has seen of it.
State = dict[str, np.ndarray]


def counts_of(texts: list[str | None], labels: np.ndarray) -> np.ndarray:
    """How many texts of each class (clean, toxic) hold a bucket."""
    shared = np.zeros((2, BUCKETS), np.int64)
    for text, label in zip(texts, labels.tolist(), strict=True):
        shared[int(label == 1), np.unique(look_up([text])[0])] += 1
    return shared


def first_state(shared: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[State, np.ndarray]:
    """Where training begins, and which buckets have a vector; ``sizes`` are the texts of each class."""
    model = Model.new(seed)
    common = shared.sum(0) >= LEAST_TEXTS  # what few texts hold would be learned by heart
    # A first guess for one filter: how surely a bucket's share of toxic texts differs from its share of clean ones.
    share = (shared + 0.5) / (sizes[:, None] + 1)
    model.vectors[:, 0] = np.clip((np.log(share[1]) - np.log(share[0])) / np.sqrt((1 / (shared + 0.5)).sum(0)) / 3, -4, 4)
    model.vectors[~common] = 0
    model.filters[0][0] = np.eye(1, WIDTH)
    model.out[0] = 1
    state = {"vectors": model.vectors, "bias": model.bias, "out": model.out, "out_bias": np.zeros(1, np.float32),
             **{f"f{k}": f for k, f in enumerate(model.filters)}}
    return state | {f"seen {name}": np.full_like(value, 1e-3) for name, value in state.items()}, common


def model_of(state: State) -> Model:
    return Model(state["vectors"], [state[f"f{k}"] for k in range(len(SIZES))], state["bias"], state["out"], float(state["out_bias"][0]))


def advance(state: State, common: np.ndarray, sizes: np.ndarray, texts: list[str | None], labels: np.ndarray, *, rounds: range,
            rate: float, seed: int) -> State:
    """Adagrad on batches of whole texts; only the place of each filter's largest answer has a gradient.

    ``sizes`` are the texts of each class in the whole training set, of which these may be a part.
    """
    state = {name: value.copy() for name, value in state.items()}
    model, rng = model_of(state), np.random.default_rng(seed)
    names = ["out", "bias", *(f"f{k}" for k in range(len(SIZES)))]
    weight = np.where(labels == 1, 0.5 / max(1, sizes[1]), 0.5 / max(1, sizes[0])) * sizes.sum()
    batch = 24
    for turn in range(rounds.stop):
        order = rng.permutation(len(texts))
        if turn < rounds.start:
            continue
        for first in range(0, len(order), batch):
            chosen = order[first:first + batch]
            places, offsets = look_up([texts[k] for k in chosen])
            pooled, answers, x = model.pool(places, offsets)
            z = pooled @ model.out + state["out_bias"][0]
            slope = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            into = slope[:, None] * model.out * (pooled > 0)
            grads = {"out": pooled.T @ slope, "bias": into.sum(0)}
            touched = np.zeros_like(x)
            full = np.flatnonzero(np.diff(offsets) > 0)
            for s, size in enumerate(SIZES):
                gradient = np.zeros_like(model.filters[s])
                for t in full.tolist():
                    a, b = offsets[t], offsets[t + 1]
                    best = answers[s][a:b].argmax(0) + a
                    for f in np.flatnonzero(into[t, s * FILTERS:(s + 1) * FILTERS]).tolist():
                        amount = into[t, s * FILTERS + f]
                        here = slice(best[f], min(best[f] + size, b))
                        wide = here.stop - here.start
                        gradient[f, :wide] += amount * x[here]
                        touched[here] += amount * model.filters[s][f, :wide]
                grads[f"f{s}"] = gradient
            grads["out_bias"] = slope.sum(keepdims=True)
            for name in (*names, "out_bias"):
                state[f"seen {name}"] += grads[name] ** 2
                state[name] -= rate * grads[name] / np.sqrt(state[f"seen {name}"])
            rows = np.flatnonzero(touched.any(1))
            where = places[rows].ravel()
            amounts = np.repeat(touched[rows], places.shape[1], axis=0)
            where, amounts = where[common[where]], amounts[common[where]]
            buckets, which = np.unique(where, return_inverse=True)
            total = np.zeros((len(buckets), WIDTH), np.float32)
            np.add.at(total, which, amounts)
            state["seen vectors"][buckets] += total ** 2
            state["vectors"][buckets] -= rate * total / np.sqrt(state["seen vectors"][buckets])
    return state


def train(texts: list[str | None], labels: np.ndarray, *, rounds: int = ROUNDS, rate: float = RATE, seed: int = SEED) -> Model:
    """A model of texts in one place."""
    sizes = np.bincount(labels == 1, minlength=2)
    state, common = first_state(counts_of(texts, labels), sizes, seed)
    return model_of(advance(state, common, sizes, texts, labels, rounds=range(rounds), rate=rate, seed=seed))


def threshold(bins: np.ndarray, price: float = 3.0) -> float:
    """The cut with the least cost, a clean text above it being ``price`` times as bad as a toxic one below; of equal
    cuts the one in the widest gap.  ``bins``, in order: least and largest logit, toxic and clean texts."""
    low, high, toxic, clean = bins.T
    below = np.append(0, np.cumsum(toxic)) / max(1, toxic.sum())
    above = price * (1 - np.append(0, np.cumsum(clean)) / max(1, clean.sum()))
    left, right = np.append(low[0] - 1, high), np.append(low, high[-1] + 1)
    gap, cost = right - left, below + above
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    k = best[gap[best].argmax()]
    return float((left[k] + right[k]) / 2)


def calibrate(model: Model, texts: DataFrame, least: int = 15) -> None:
    """Set the thresholds from all rows ``_label, text``; a language with fewer than ``least`` texts of a class has the common one."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        places, offsets = look_up(batch.column(1).to_pylist())
        z = shared.value.logits(places, offsets).astype(np.float64)
        return pa.RecordBatch.from_arrays(
            [pa.array(shared.value.language(places, offsets), pa.int32()), batch.column(0).cast(pa.int32()), pa.array(z)], ["language", "label", "z"])

    logits = over_batches(texts.select("_label", "text"), "language int, label int, z double", work, size=1 << 20)
    rows = logits.groupBy("language", F.floor(F.greatest(F.least("z", F.lit(50.0)), F.lit(-50.0)) / BIN).alias("bin")).agg(
        F.min("z"), F.max("z"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)), F.sum(F.when(F.col("label") == 1, 0).otherwise(1))).collect()
    found: dict = {}
    for language, at, low, high, toxic, clean in rows:
        for key in ("all", LANGUAGES[language]):
            old = found.setdefault(key, {}).get(at, (low, high, 0, 0))
            found[key][at] = (min(low, old[0]), max(high, old[1]), toxic + old[2], clean + old[3])
    for name, of in found.items():
        bins = np.array([of[at] for at in sorted(of)], float)
        if bins[:, 2:].sum(0).min() >= (1 if name == "all" else least) and min(np.array([*found["all"].values()])[:, 2:].sum(0)) > 0:
            model.thresholds[name] = threshold(bins)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held: int, most: int,
                    text: str = "text", doc_id: str = "doc_id") -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Whole texts of at most ``most`` rows of each class outside the held-out fold, by a hash of the id.

    Returns texts, labels and the hash order's number, all settled by the ids: an id has one text, the
    least of those its rows hold, so copies of an id crowd out no other.  A label without a document is left out.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where(
        F.col("_label").isNotNull() & F.col("_id").isNotNull() & (fold(F.col("_id"), folds) != held)).withColumn("_hash", F.xxhash64("_id"))
    texts, marks, order = [], [], []
    for value in (0, 1):
        ids = known.where(F.col("_label") == value).select("_id", "_hash").distinct().orderBy("_hash", "_id").limit(most)
        rows = one_text_each(docs, ids, text, doc_id).collect()
        for r in sorted(rows, key=lambda r: (r[0], r[1])):
            texts.append(r[2])
            marks.append(value)
            order.append(r[0])
    return texts, np.array(marks, np.int64), np.array(order, np.int64)


def labelled_ids(labels: DataFrame, label: str, *, folds: int, held: int, doc_id: str) -> DataFrame:
    """``_id, _label`` of every labelled id outside the held-out fold."""
    return labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where(
        F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & (fold(F.col("_id"), folds) != held)).distinct()


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held: int, text: str, doc_id: str) -> DataFrame:
    """``_hash, _id, _label, text``: every labelled id outside the held-out fold that has a document, with one text,
    the least of those its rows hold."""
    known = labelled_ids(labels, label, folds=folds, held=held, doc_id=doc_id)
    # A merge by id whatever the size: the texts of an id are then beside each other, and their least needs no shuffle of its own.
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_read")).join(known.hint("merge"), F.col("_doc") == F.col("_id"))
    return rows.groupBy(F.xxhash64("_id").alias("_hash"), "_id", "_label").agg(F.min("_read").alias("text"))


def dealt_table(texts: DataFrame, parts: int) -> DataFrame:
    """The texts as a table bucketed by ``_part``, so that each round finds the parts where they lie and shuffles no text."""
    spark, name, buckets = texts.sparkSession, f"labelled_texts_{uuid.uuid4().hex}", BUCKETS_A_PART * parts
    texts.repartition(buckets, "_part").write.bucketBy(buckets, "_part").sortBy("_part").option("path", scratch_folder(spark)).saveAsTable(name)
    return spark.table(name)


def count_buckets(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``counts_of`` all rows, and the texts of each class."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = batch.column(0).to_numpy()
        shared = counts_of(batch.column(1).to_pylist(), marks)
        kind, bucket = np.nonzero(shared)
        sizes = np.bincount(marks == 1, minlength=2)
        return pa.RecordBatch.from_arrays([pa.array(np.append(kind, [0, 1]), pa.int32()), pa.array(np.append(bucket, [-1, -1]), pa.int32()),
                                           pa.array(np.append(shared[kind, bucket], sizes), pa.int64())], ["kind", "bucket", "n"])

    shared, sizes = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    # At most two rows a bucket.
    for kind, bucket, n in over_batches(texts.select("_label", "text"), "kind int, bucket int, n long", work).groupBy("kind", "bucket").agg(F.sum("n")).collect():
        if bucket < 0:
            sizes[kind] = n
        else:
            shared[kind, bucket] = n
    return shared, sizes


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 3, held: int = 1,
          text: str = "text", doc_id: str = "doc_id") -> Model:
    """A classifier from all labelled texts; a third of them calibrates the thresholds.

    The texts are written once, dealt over tasks of about ``TEXTS_A_TASK``.  Of few texts one task makes the
    model; of more each task goes on from a common state for a round, and an array's next value is its
    old one and the average step of the tasks that moved it.
    """
    options = {"folds": folds, "held": held, "doc_id": doc_id}
    ids = labelled_ids(labels, label, **options).join(docs.select(F.col(doc_id).alias("_id")), "_id", "left_semi")
    parts = max(1, -(-ids.where(F.xxhash64("_id") % 3 != 0).count() // TEXTS_A_TASK))
    place = F.pmod(F.xxhash64("_hash", F.lit("part")), F.lit(parts)).cast("int")
    # Parts below 0 calibrate.
    texts = dealt_table(labelled_texts(docs, labels, label, text=text, **options).withColumn(
        "_part", F.when(F.col("_hash") % 3 != 0, place).otherwise(place - parts)), parts)
    dealt = texts.where(F.col("_part") >= 0)
    shared, sizes = count_buckets(dealt)
    state, common = first_state(shared, sizes, SEED)
    for rounds in [range(ROUNDS)] if parts == 1 else [range(k, k + 1) for k in range(SHARED_ROUNDS)]:
        state = one_round(dealt, state, common, sizes, rounds)
    model = model_of(state)
    calibrate(model, texts.where(F.col("_part") < 0))
    return model


def one_round(dealt: DataFrame, state: State, common: np.ndarray, sizes: np.ndarray, rounds: range) -> State:
    """The state after every part went on from it; what moves are steps of arrays, each of a bounded size."""
    held = dealt.sparkSession.sparkContext.broadcast((state, common, sizes))

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_label", "ascending"), ("_hash", "ascending"), ("_id", "ascending")])
        old, common, sizes = held.value
        new = advance(old, common, sizes, rows.column("text").to_pylist(), rows.column("_label").to_numpy(), rounds=rounds, rate=RATE, seed=SEED)
        cut = [(name, at, step[at:at + STEP].tobytes()) for name in new
               for step in [(new[name].astype(np.float64) - old[name]).ravel()] for at in range(0, len(step), STEP)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*cut, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["name", "at", "step"])

    def average(key: tuple, steps: pa.Table) -> pa.Table:
        total = moved = 0
        # In a settled order: sums of floats depend on it.
        for step in sorted(x.as_py() for x in steps.column("step")):
            step = np.frombuffer(step)
            total, moved = total + step, moved + (step != 0)
        mean = (total / np.maximum(moved, 1)).tobytes()
        return pa.table({"name": [key[0].as_py()], "at": pa.array([key[1].as_py()], pa.int32()), "step": pa.array([mean], pa.binary())})

    shape = "name string, at int, step binary"
    state = {name: value.astype(np.float64) for name, value in state.items()}
    for name, at, step in dealt.groupBy("_part").applyInArrow(work, shape).groupBy("name", "at").applyInArrow(average, shape).collect():
        state[name].reshape(-1)[at:at + STEP] += np.frombuffer(step)
    return {name: value.astype(np.float32) for name, value in state.items()}


def score(docs: DataFrame, model: Model, *, text: str = "text", made: str = "score") -> DataFrame:
    """Every row with the score (0 to 1) of its whole text.

    Null and empty texts have the score of no words.  The model (a few MB, whatever
    the input) is broadcast once.  A column named like the output is replaced.
    """
    keep = kept_columns(docs, [made])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*keep, F.col(text).alias("_scored"))
    schema = docs.select(*keep).schema.add(made, "double")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores(batch.column(len(keep)).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*keep, made])

    return over_batches(inner, schema, work, size=1 << 20)
