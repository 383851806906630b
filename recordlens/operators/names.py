"""Known model names, and suggestions for names that are not known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import is_blank, trim_ws
from .ranking import top_k

SUGGESTION_LIMIT = 8
SCOPE = ["make", "model_year"]
# A word of at most this many names of a scope is rare: all its names are scored.
RARE = 64


def name_tokens(col: Column) -> Column:
    """Distinct upper-case words of a name; blanks and ``- ( ) , / . _`` separate them."""
    parts = F.transform(F.split(F.upper(F.coalesce(col, F.lit(""))), r"[ \-(),/._]"), trim_ws)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def split_known(registrations: DataFrame, model_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registrations whose model is listed for their make and year, and the others."""
    known = model_names.select(*SCOPE, F.upper("model").alias("model_key"))
    keyed = registrations.withColumn("model_key", F.upper("model"))
    on = [*SCOPE, "model_key"]
    return (
        keyed.join(known, on, "left_semi").drop("model_key"),
        keyed.join(known, on, "left_anti").drop("model_key"),
    )


def model_names(names: DataFrame) -> DataFrame:
    """Distinct names per make and year, ignoring case, in text order."""
    return (
        names.where(~is_blank(F.col("model")))
        .groupBy(*SCOPE, F.upper(trim_ws(F.col("model"))).alias("key"))
        .agg(F.min(trim_ws(F.col("model"))).alias("model"))
        .select(*SCOPE, "model").orderBy(*SCOPE, "model")
    )


def _length_of(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda total, word: total + F.length(word))


def name_candidates(
    wanted: DataFrame, names: DataFrame, scope: list[str], limit: int = SUGGESTION_LIMIT, rare: int = RARE
) -> DataFrame:
    """``<scope>, typed, name, score`` of the names that can be among the best ``limit``, scores exact for those.

    Names that share a rare word are met through it and scored whole, which gives what the
    last of the best has to reach.  A typed text looks through its frequent words from the rarest on only while
    those still to come can add up to that.  Names with one set of frequent words score alike by them, so each
    set is met once, for its first ``limit`` names in text order, and only the best ``limit`` sets count.
    """
    key = [*scope, "typed"]
    held = names.select(*scope, "name", name_tokens(F.col("name")).alias("tokens")).withColumn("token", F.explode("tokens"))
    counts = held.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("names"))
    held = held.join(counts, [*scope, "token"])
    words = wanted.select(*key, name_tokens(F.col("typed")).alias("words")).withColumn("token", F.explode("words")).join(
        counts, [*scope, "token"])

    by_rare = words.where(F.col("names") <= rare).drop("names").join(
        held.where(F.col("names") <= rare).drop("names"), [*scope, "token"])
    scored = by_rare.withColumn("score", _length_of(F.array_intersect("words", "tokens"))).groupBy(*key, "name").agg(
        F.max("score").alias("score"))
    last = top_k(scored, key, [F.desc("score"), F.asc("name")], limit, "place").where(F.col("place") == limit).select(
        *key, F.col("score").alias("least"))

    # From the most frequent word on: what this word and all more frequent ones can add up to.
    upwards = Window.partitionBy(*key).orderBy(F.desc("names"), F.asc("token")).rowsBetween(Window.unboundedPreceding, 0)
    open_words = (
        words.where(F.col("names") > rare).withColumn("reach", F.sum(F.length("token")).over(upwards))
        .join(last, key, "left").withColumn("least", F.coalesce("least", F.lit(0))).where(F.col("reach") >= F.col("least"))
    )
    sets = held.where(F.col("names") > rare).groupBy(*scope, "name").agg(F.array_sort(F.collect_set("token")).alias("often"))
    firsts = top_k(sets, [*scope, "often"], [F.asc("name")], limit, "place").groupBy(*scope, "often").agg(
        F.array_sort(F.collect_list("name")).alias("first_names"))  # at most ``limit``
    by_set = open_words.drop("names").join(firsts.withColumn("token", F.explode("often")), [*scope, "token"])
    met = (
        by_set.withColumn("score", _length_of(F.array_intersect("words", "often"))).where(F.col("score") >= F.col("least"))
        .groupBy(*key, "often").agg(F.any_value("first_names").alias("first_names"), F.max("score").alias("score"))
    )
    best_sets = top_k(met, key, [F.desc("score"), F.element_at("first_names", 1).asc()], limit, "place")
    frequent = best_sets.select(*key, F.explode("first_names").alias("name"), "score")
    return scored.unionByName(frequent).groupBy(*key, "name").agg(F.max("score").alias("score"))


def suggest_names(
    typed: DataFrame, candidates: DataFrame, scope: list[str], limit: int = SUGGESTION_LIMIT
) -> DataFrame:
    """``<scope>, typed, rank, name, more`` of the candidates that resemble what was typed.

    ``typed`` is ``<scope>, typed``; ``candidates`` is ``<scope>, name``.  A
    candidate scores the length of the typed words it holds.  When none scores,
    the first names in text order stand in.  A word that all names of a scope share
    does not bring all of them up: see ``name_candidates``.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    names = (
        candidates.where(~is_blank(F.col("name")))
        .groupBy(*scope, F.upper(trim_ws(F.col("name"))).alias("key"))
        .agg(F.min(trim_ws(F.col("name"))).alias("name")).drop("key")
    )
    wanted = typed.select(*scope, "typed").distinct()
    scored = name_candidates(wanted, names, scope, limit)
    best = top_k(
        scored, [*scope, "typed"], [F.desc("score"), F.asc("name")], limit, "rank"
    ).select(*scope, "typed", "rank", "name")
    first = top_k(names, scope, [F.asc("name")], limit, "rank")
    unmatched = wanted.join(scored.select(*scope, "typed").distinct(), [*scope, "typed"], "left_anti")
    sample = unmatched.join(first, scope).select(*scope, "typed", "rank", "name")
    totals = names.groupBy(*scope).agg(F.count(F.lit(1)).alias("total"))
    chosen = best.unionByName(sample)
    counts = chosen.groupBy(*scope, "typed").agg(F.count(F.lit(1)).alias("shown"))
    return (
        chosen.join(counts.join(totals, scope), [*scope, "typed"])
        .select(*scope, "typed", "rank", "name", (F.col("total") - F.col("shown")).alias("more"))
    )


def suggestions(unknown: DataFrame, names: DataFrame, n: int = SUGGESTION_LIMIT) -> DataFrame:
    """Suggestions for rejected registrations within their make and year."""
    return suggest_names(
        unknown.select(*SCOPE, F.col("model").alias("typed")),
        names.select(*SCOPE, F.col("model").alias("name")), SCOPE, n,
    )
