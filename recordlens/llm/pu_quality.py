"""Quality by positive-unlabelled learning: no bad text is ever shown to the classifier as bad.

Trusted positives are labelled good texts; the rest of the evidence is unlabelled
web text, a mixture of good and bad.  The share of good in the mixture is estimated
first (from how a plain positive-against-unlabelled classifier spreads both); then
the classifier minimises the non-negative unbiased risk: the positives' risk as
good, and the unlabelled risk as bad less the part that the good in it must cause,
held at zero or more.  The score is its probability of good, moved so that nearly
all trusted positives kept back from training pass the cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import rules
from .common import fold, kept_columns, one_text_each, over_batches
from .hashing import word_hashes

BUCKETS = 1 << 14
BINS = 24
LEAST_TEXTS = 8
# Labelled good texts and unlabelled texts that training reads at most.
POSITIVES, UNLABELLED = 4000, 8000
CUT = 0.3
# Share of the trusted positives kept back that may lie below the cut.
MISSED = 0.002


CLASSES = np.zeros((256, 6))
for _k, _chars in enumerate((b"0123456789", b".,;:", b"!?", bytes(range(65, 91)), b"#*$%&|<>", bytes(range(128, 192)))):
    CLASSES[[*_chars], _k] = 1


MEASURES = 14


def measures(texts: list[str | None], hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fourteen numbers for each whole text, whose words have these hashes."""
    data = [(t or "").encode() + b"\n" for t in texts]
    borders = np.cumsum([0, *map(len, data)])
    raw = np.frombuffer(b"".join(data), np.uint8)
    size = np.diff(borders).astype(float)
    shares = [np.add.reduceat(CLASSES[raw, k], borders[:-1]) / size for k in range(CLASSES.shape[1])] if texts else [size] * CLASSES.shape[1]
    words = np.diff(offsets)
    owner, n = np.repeat(np.arange(len(texts)), words), np.maximum(words, 1).astype(float)
    ids = np.unique(hashes, return_inverse=True)[1].ravel()
    distinct = np.bincount(np.unique(owner * (len(hashes) + 1) + ids) // (len(hashes) + 1), minlength=len(texts))
    twice = np.bincount(owner[1:][(ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts))
    lines, same = np.ones(len(texts)), np.zeros(len(texts))
    for k, d in enumerate(data):
        full = [line for line in d.split(b"\n") if line and not line.isspace()]
        lines[k], same[k] = max(1, len(full)), len(full) - len(set(full))
    return np.column_stack([np.log1p(words), size / n, *shares, same / lines, rules.repeated_words(ids, owner, len(texts)) / n,
                            twice / n, distinct / n, distinct / n * np.log1p(words), lines / n])


@dataclass
class Model:
    edges: np.ndarray  # [measure, edge]
    bins: np.ndarray  # weight of each measure's bin
    words: np.ndarray
    bias: float = 0.0
    prior: float = 0.5

    def logits(self, x: Features) -> np.ndarray:
        out = self.bins[np.arange(x.bins.shape[1]), x.bins].sum(1) + self.bias
        sums = np.append(0, np.cumsum(self.words[x.bucket]))[x.offsets]
        return out + np.diff(sums) * x.share

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.logits(features(texts, self.edges)[0])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Features:
    bins: np.ndarray  # [text, measure]
    bucket: np.ndarray  # of each word
    offsets: np.ndarray  # where a text's words begin

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bins)), np.diff(self.offsets))

    @property
    def share(self) -> np.ndarray:
        """What one word of each text counts."""
        return 8 / np.maximum(np.diff(self.offsets), 1)

    def pick(self, texts: np.ndarray) -> Features:
        sizes = np.diff(self.offsets)[texts]
        offsets = np.append(0, np.cumsum(sizes))
        places = np.arange(offsets[-1]) + np.repeat(self.offsets[texts] - offsets[:-1], sizes)
        return Features(self.bins[texts], self.bucket[places], offsets)


def features(texts: list[str | None], edges: np.ndarray | None = None) -> tuple[Features, np.ndarray]:
    """The features of texts, and the bins' edges: those given, or quantiles of these texts."""
    hashes, offsets = word_hashes(texts, ())
    step = 256
    values = np.concatenate([
        measures(texts[k:k + step], hashes[offsets[k]:offsets[min(k + step, len(texts))], 0], offsets[k:k + step + 1] - offsets[k])
        for k in range(0, len(texts), step)] or [np.zeros((0, MEASURES))])
    if edges is None:
        edges = np.stack([np.quantile(values[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(values.shape[1])])
    bins = np.column_stack([np.searchsorted(edges[k], values[:, k], "right") for k in range(len(edges))])
    return Features(bins, (hashes[:, 0] % np.uint64(BUCKETS)).astype(np.int32), offsets), edges


def _slope(z: np.ndarray, good: bool) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss of each text when taken as good or as bad, and its derivative by the logit."""
    sign = 1.0 if good else -1.0
    loss = np.logaddexp(0, -sign * z)
    return loss, -sign / (1 + np.exp(np.clip(sign * z, -500, 500)))


class Trainer:
    def __init__(self, model: Model, x: Features, *, rate: float = 0.05, decay: float = 1e-4):
        self.model, self.x, self.rate, self.decay = model, x, rate, decay
        self.word_decay = 3 / max(300, len(x.bins))  # many weights, few texts
        common = np.zeros(BUCKETS, np.int64)
        for a, b in zip(x.offsets[:-1].tolist(), x.offsets[1:].tolist(), strict=True):
            common[np.unique(x.bucket[a:b])] += 1
        self.common = common >= LEAST_TEXTS
        self.moments: dict[str, list] = {}
        self.turn = 0

    def step(self, texts: np.ndarray, slopes: np.ndarray) -> None:
        """One Adam step along the given derivatives by the logits of ``texts``."""
        x, m = self.x.pick(texts), self.model
        bins = np.zeros_like(m.bins)
        np.add.at(bins, (np.broadcast_to(np.arange(x.bins.shape[1]), x.bins.shape), x.bins), slopes[:, None])
        words = np.bincount(x.bucket, np.repeat(slopes * x.share, np.diff(x.offsets)), BUCKETS) * self.common
        self.turn += 1
        for name, gradient in (("bins", bins + self.decay * m.bins), ("words", words + self.word_decay * m.words), ("bias", slopes.sum())):
            first, second = self.moments.setdefault(name, [0.0, 0.0])
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
            self.moments[name] = [first, second]
            change = self.rate * first / (1 - 0.9 ** self.turn) / (np.sqrt(second / (1 - 0.999 ** self.turn)) + 1e-8)
            setattr(m, name, getattr(m, name) - change)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, error: float = 0.1) -> float:
    """Share of good in the mixture: over all cuts of a score, the least ratio of the mixture's share above it to the
    positives' share above it, each cut paying for its sampling error (best bin)."""
    cuts = np.unique(positive)
    if not len(cuts) or not len(unlabelled):
        return 0.5
    above_p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    slack = math.sqrt(math.log(4 / error) / 2) * (1 / math.sqrt(len(positive)) + 1 / math.sqrt(len(unlabelled)))
    best = ((above_u + slack) / above_p).argmin()
    return float(min(max(above_u[best] / above_p[best], 0.02), 0.98))


def train(positive: list[str | None], unlabelled: list[str | None], *, rounds: int = 200, batch: int = 2048, seed: int = 11) -> Model:
    """The classifier and, as its ``prior``, the estimated share of good texts among the unlabelled."""
    texts = positive + unlabelled
    x, edges = features(texts)
    rng = np.random.default_rng(seed)
    good, rest = np.arange(len(positive)), np.arange(len(positive), len(texts))
    new = lambda: Model(edges, np.zeros((len(edges), BINS)), np.zeros(BUCKETS))
    if not len(good) or not len(rest):
        return new()
    # The prior: a plain classifier, judged on the half it has not seen.
    plain = Trainer(new(), x)
    p_fit, p_held, u_fit, u_held = (a for group in (good, rest) for a in np.array_split(rng.permutation(group), 2))
    for _ in range(60):
        p, u = rng.choice(p_fit, batch), rng.choice(u_fit, batch)
        both = np.concatenate([p, u])
        z = _logits(plain.model, x, both)
        slopes = np.concatenate([_slope(z[:batch], True)[1], _slope(z[batch:], False)[1]]) / (2 * batch)
        plain.step(*_gathered(both, slopes))
    prior = class_prior(_logits(plain.model, x, p_held), _logits(plain.model, x, u_held))
    # The classifier: the non-negative unbiased risk.
    good, kept_back = np.split(rng.permutation(good), [len(good) * 4 // 5]) if len(good) > 4 else (good, good)
    trainer = Trainer(new(), x)
    trainer.model.prior = prior
    trainer.model.bias = math.log(prior / (1 - prior))
    for _ in range(rounds):
        p, u = rng.choice(good, batch), rng.choice(rest, batch)
        z_p, z_u = _logits(trainer.model, x, p), _logits(trainer.model, x, u)
        _, good_slope = _slope(z_p, True)
        bad_loss, bad_slope = _slope(z_p, False)
        u_loss, u_slope = _slope(z_u, False)
        if u_loss.mean() - prior * bad_loss.mean() >= 0:
            slopes = np.concatenate([prior * (good_slope - bad_slope), u_slope]) / batch
        else:  # the bad part cannot have a negative risk: undo what made it so
            slopes = np.concatenate([prior * bad_slope, -u_slope]) / batch
        trainer.step(*_gathered(np.concatenate([p, u]), slopes))
    # The cut lies where nearly all trusted positives that it has not seen pass.
    trainer.model.bias += math.log(CUT / (1 - CUT)) - float(np.quantile(_logits(trainer.model, x, kept_back), MISSED))
    return trainer.model


def _logits(model: Model, x: Features, texts: np.ndarray) -> np.ndarray:
    """Logits of a list of texts that may repeat."""
    some, which = np.unique(texts, return_inverse=True)
    return model.logits(x.pick(some))[which]


def _gathered(texts: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some, which = np.unique(texts, return_inverse=True)
    return some, np.bincount(which, slopes, len(some))


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, held: int = 0, positives: int = POSITIVES,
          unlabelled: int = UNLABELLED, text: str = "text", doc_id: str = "doc_id") -> Model:
    """A classifier from at most ``positives`` labelled good texts outside the held-out fold and ``unlabelled`` others.

    Both samples go by a hash of the id, and an id has one text, so they are the same in every run.
    The mixture takes rows without a label first and is filled up from all others, their labels unread.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_id").isNotNull())
    good = known.where((F.col("_label") == 1) & (fold(F.col("_id"), folds) != held)).select("_id")
    ids = docs.select(F.col(doc_id).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    marked = ids.join(known.select("_id", F.lit(1).alias("_marked")).distinct(), "_id", "left")

    def sample(of: DataFrame, most: int, *first: Column) -> list[str | None]:
        numbered = of.distinct().withColumn("_hash", F.xxhash64(F.lit("quality"), "_id"))
        chosen = numbered.orderBy(*first, "_hash", "_id").limit(most).select("_id", "_hash")
        rows = one_text_each(docs, chosen, text, doc_id).collect()
        return [r["text"] for r in sorted(rows, key=lambda r: (r["_hash"], r["_id"]))]

    return train(sample(good, positives), sample(marked, unlabelled, F.col("_marked").asc_nulls_first()))


def score(docs: DataFrame, model: Model, *, text: str = "text", made: str = "score") -> DataFrame:
    """Every row with the score (0 to 1) of its whole text.

    Null and empty texts have the score of no words.  The model (a few hundred KB)
    is broadcast once.  A column named like the output is replaced.
    """
    keep = kept_columns(docs, [made])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*keep, F.col(text).alias("_scored"))
    schema = docs.select(*keep).schema.add(made, "double")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = shared.value.scores(batch.column(len(keep)).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*keep, made])

    return over_batches(inner, schema, work, size=2 << 20)
