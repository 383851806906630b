"""Quality rules whose cutoffs are chosen under a proven limit on false rejections.

Every document is measured whole; labelled documents are counted per stratum,
rule and value; and for each stratum and rule a cutoff is taken whose rate of rejected good documents is shown, by an exact binomial test on the
labelled holdout, to stay under the limit.  The tests are corrected over all
strata and rules (Bonferroni) and run in a fixed sequence over cutoffs, so with
probability ``1 - error`` every cutoff in use keeps its limit.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import kept_columns, over_batches

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_bare")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def measure(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Every row with its counts over the whole text (longs).

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_lines`` (with a word), ``n_dup_lines`` (of those, equal to an earlier
    one), ``n_repeat_words`` (words in windows of five words found twice or more,
    the first included), ``n_distinct`` (different words) and ``n_bare`` (words of
    symbols and punctuation alone).  A null or empty text has zeros.  Repeated rows
    stay; columns named like a count are replaced; the text is dropped.
    """
    keep = [c for c in kept_columns(docs, [*MEASURES]) if c != text]
    schema = docs.select(*keep).schema
    for name in MEASURES:
        schema = schema.add(name, "long")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = count(batch.column(len(keep)).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in counts)], [*keep, *MEASURES])

    return over_batches(docs.select(*keep, text), schema, work)


def count(texts: list[str | None]) -> list[np.ndarray]:
    """The counts of ``MEASURES`` for each text."""
    data = [t.encode() if t else b"" for t in texts]
    words = [d.split() for d in data]  # of bytes: at the six white-space characters alone
    sizes = np.array([len(w) for w in words], np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for doc in words for w in doc), np.int64, int(sizes.sum()))
    symbols = np.array([sum(map(d.count, map(bytes, zip(SYMBOLS)))) for d in data], np.int64)
    chars = np.array([len(t) - sum(map(t.count, " \t\n\v\f\r")) if t else 0 for t in texts], np.int64)
    lines, repeated_lines = [], []
    for d in data:
        full = [line for line in d.split(b"\n") if line and not line.isspace()]
        lines.append(len(full))
        repeated_lines.append(len(full) - len(set(full)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    bare_word = np.fromiter((not any(c.isalnum() for c in w.decode(errors="replace")) for w in number), bool, len(number))
    return [sizes, chars, symbols, np.array(repeated_lines, np.int64), repeated_words(ids, owner, len(texts)),
            np.array(lines, np.int64), np.array([len(set(w)) for w in words], np.int64),
            np.bincount(owner, weights=bare_word[ids] if len(ids) else None, minlength=len(texts)).astype(np.int64)]


def repeated_words(ids: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it; windows are compared word by word."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(texts, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = (key ^ ids[k:k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1:])
    key = (key[inside] + owner[inside].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key, kind="stable")
    key, inside = key[order], inside[order]
    follows = np.flatnonzero(key[1:] == key[:-1])
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(follows):
        # Windows of one key lie together in the order of their places; what the key says is checked on the words.
        group = np.unique(np.concatenate([follows, follows + 1]))
        places = inside[group]
        exact = np.column_stack([owner[places], *(ids[places + k] for k in range(WINDOW))])
        _, which, times = np.unique(exact, axis=0, return_inverse=True, return_counts=True)
        places = places[times[which.ravel()] > 1]
        np.add.at(covered, places, 1)
        np.add.at(covered, places + WINDOW, -1)
    return np.bincount(owner, weights=np.cumsum(covered[:-1]) > 0, minlength=texts).astype(np.int64)


def base_failed(words: Column, repeated: Column) -> Column:
    return (words < 10) | (100 * repeated > 20 * words)


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose value lies above (or below) a cutoff from a fixed grid of ``steps``."""

    name: str
    value: Column  # in [0, 1]
    above: bool = True
    steps: int = 100

    @property
    def step(self) -> Column:
        """0 to ``steps``; the larger, the worse."""
        held = F.least(F.greatest(F.coalesce(self.value, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return F.ceil((held if self.above else 1 - held) * self.steps).cast("int")


def share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def rules() -> list[Rule]:
    """The published heuristics, as shares."""
    return [
        Rule("symbols", share("n_symbols", "n_words")),
        Rule("bare_words", share("n_bare", "n_words")),
        Rule("repeated_lines", share("n_dup_lines", "n_lines")),
        Rule("repeated_words", share("n_repeat_words", "n_words")),
        Rule("distinct_words", share("n_distinct", "n_words"), above=False),
    ]


def at_most(rejected: int, total: int, limit: float) -> float:
    """The chance of at most ``rejected`` of ``total`` when each is rejected with probability ``limit``: the exact
    binomial p-value of "the rate is ``limit`` or more"."""
    if rejected >= total:
        return 1.0
    log, log_p, log_q = -math.inf, math.log(limit), math.log1p(-limit)
    for k in range(rejected + 1):
        term = math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * log_p + (total - k) * log_q
        log = max(log, term) + math.log1p(math.exp(-abs(log - term))) if log > -math.inf else term
    return min(1.0, math.exp(log))


def choose(counts: list[tuple], steps: dict[str, int], *, limit: float, error: float, price: float = 10.0) -> list[tuple]:
    """``(stratum, rule, cutoff, rejected_good, good)`` of every cutoff in use.

    ``counts`` holds ``(stratum, rule, step, good, bad)``.  A document is rejected
    if its step is above the cutoff.  Within a stratum each rule gets an equal part
    of ``limit``, so the rules together keep it.  ``error`` is divided among the
    (stratum, rule) pairs; in each, cutoffs are tested from the loosest on until one
    is not certified (a fixed sequence, which needs no further correction).  Of the
    certified ones that is used which rejects the largest share of the bad after
    ``price`` times the share of the good; a rule that gains nothing is not used.
    """
    tables: dict[tuple, np.ndarray] = {}
    for stratum, rule, step, good, bad in counts:
        found = tables.setdefault((stratum, rule), np.zeros((steps[rule] + 1, 2), np.int64))
        found[step] += (good, bad)
    each, per_rule = error / max(1, len(tables)), limit / max(1, len(steps))
    chosen = []
    for (stratum, rule), found in sorted(tables.items(), key=lambda t: (t[0][0] or "", t[0][1])):
        good, bad = (max(1, int(x)) for x in found.sum(0))
        rejected = (found.sum(0) - np.cumsum(found, axis=0)).tolist()  # good and bad at each cutoff
        best = (0.0, None)
        for cutoff in range(steps[rule] - 1, -1, -1):
            wrong, right = rejected[cutoff]
            if at_most(wrong, good, per_rule) > each:
                break
            best = max(best, (right / bad - price * wrong / good, (stratum, rule, cutoff, wrong, good)), key=lambda x: x[0])
        if best[1]:
            chosen.append(best[1])
    return chosen


def learn(measured: DataFrame, labels: DataFrame, stratum: Column, *, doc_id: str = "doc_id", label: str = "quality",
          limit: float = 0.05, error: float = 0.05) -> list[tuple]:
    """Cutoffs from every labelled row (see ``choose``).

    Only counts reach the driver: at most (strata x rules x steps) rows, whatever
    the number of documents.  Rows whose id or label is null teach nothing; a
    document labelled twice counts once for each label.
    """
    all_rules = rules()
    known = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("_labelled"), F.col(label).cast("int").alias("_label"))
    rows = (
        measured.select(F.col(doc_id).alias("_id"), stratum.alias("_stratum"),
                        F.array(*(F.struct(F.lit(r.name).alias("rule"), r.step.alias("step")) for r in all_rules)).alias("_steps"))
        .join(known, F.col("_id") == F.col("_labelled"))
        .select("_stratum", "_label", F.explode("_steps").alias("at"))
    )
    good = F.col("_label") == 1
    counts = (
        rows.groupBy("_stratum", "at.rule", "at.step")
        .agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad")).collect()
    )
    return choose([tuple(r) for r in counts], {r.name: r.steps for r in all_rules}, limit=limit, error=error)


def verdict(chosen: list[tuple], stratum: Column) -> Column:
    """Whether no rule in use for a row's stratum rejects it."""
    by_name = {r.name: r for r in rules()}
    rejected = F.lit(False)
    by_stratum: dict = {}
    for name, rule, cutoff, _, _ in chosen:
        by_stratum.setdefault(name, []).append(by_name[rule].step > cutoff)
    for name, tests in by_stratum.items():
        any_of = tests[0]
        for test in tests[1:]:
            any_of = any_of | test
        rejected = rejected | (stratum.eqNullSafe(F.lit(name)) & any_of)
    return ~rejected


def apply_rules(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
                strata: str | None = "lang", limit: float = 0.05, error: float = 0.05) -> DataFrame:
    """Every row without its text, with its counts, ``base_failed`` and ``kept``.

    ``strata`` names a column with few values (a null is a stratum of its own);
    strata without labels have no certified cutoff and keep what the base keeps.
    The texts are read once; their counts (a row of numbers a document) are written
    to the shared checkpoint folder, since learning and the result both read them.
    An empty table gives an empty table.
    """
    stratum = F.col(strata) if strata else F.lit("all")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    measured = cut_lineage(measure(docs, text=text))
    chosen = learn(measured.where(~failed), labels, stratum, doc_id=doc_id, label=label, limit=limit, error=error)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(chosen, stratum))
