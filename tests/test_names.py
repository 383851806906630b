"""Suggestions for unknown names, against a loop over every name."""

import random
import re
from collections import defaultdict

import pytest
from frames import rows

from recordlens.operators import names


def words_of(text):
    return {w.strip() for w in re.split(r"[ \-(),/._]", (text or "").upper())} - {""}


def brute(typed, held, limit):
    """``scope, typed, rank, name, more``: every typed text against every name of its scope."""
    by_scope = defaultdict(dict)
    for scope, name in sorted(held):
        if name.strip():
            by_scope[scope].setdefault(name.strip().upper(), name.strip())
    out = []
    for scope, text in set(typed):
        pool = list(by_scope[scope].values())
        scored = [(-sum(map(len, words_of(text) & words_of(n))), n) for n in pool]
        best = sorted(x for x in scored if x[0]) or [(0, n) for n in sorted(pool)]
        out += [(scope, text, k, n, len(pool) - min(limit, len(best))) for k, (_, n) in enumerate(best[:limit], 1)]
    return out


def drawn(seed, scopes=3, held=160, asked=60):
    """Names of one to four words, of which a few words are in very many names."""
    draw = random.Random(seed)
    vocabulary = ["GT", "SEDAN", "WAGON", "SPORT-X"] * 12 + [f"N{i}" for i in range(60)]
    make = lambda: " ".join(draw.choices(vocabulary, k=draw.randint(1, 4)))
    pool = [(draw.randrange(scopes), make()) for _ in range(held)]
    typed = [(draw.randrange(scopes + 1), make() if draw.random() < 0.9 else "no such thing") for _ in range(asked)]
    return typed, pool


@pytest.mark.parametrize(("seed", "rare", "limit"), [(1, 64, 8), (2, 3, 8), (3, 1, 2), (4, 0, 5)])
def test_suggestions_equal_every_name_scored(spark, monkeypatch, seed, rare, limit):
    typed, pool = drawn(seed)
    counted = names.name_candidates
    monkeypatch.setattr(names, "name_candidates", lambda w, n, s, k: counted(w, n, s, k, rare))
    got = names.suggest_names(spark.createDataFrame(typed, "scope int, typed string"),
                              spark.createDataFrame(pool, "scope int, name string"), ["scope"], limit)
    assert [r[:5] for r in rows(got, "scope", "typed", "rank", "name", "more")] == sorted(
        brute(typed, pool, limit), key=lambda r: tuple((True, str(v)) for v in r))


def test_a_word_in_every_name_does_not_bring_up_every_name(spark):
    pool = [(0, f"MODEL M{i:04d}") for i in range(1500)]
    typed = [(0, f"MODEL T{i:03d}") for i in range(200)] + [(0, f"M{i:04d} MODEL") for i in range(100)]
    wanted = spark.createDataFrame(typed, "scope int, typed string")
    held = spark.createDataFrame(pool, "scope int, name string")
    candidates = names.name_candidates(wanted, held, ["scope"]).count()
    assert candidates <= 9 * len(typed), candidates  # 450,000 pairs share a word
    got = names.suggest_names(wanted, held, ["scope"])
    assert rows(got, "scope", "typed", "rank", "name", "more") == sorted(
        brute(typed, pool, 8), key=lambda r: tuple((True, str(v)) for v in r))


def test_names_or_texts_that_are_not_there(spark):
    none = spark.createDataFrame([], "scope int, name string")
    typed = spark.createDataFrame([(1, "ABC"), (1, None), (2, "")], "scope int, typed string")
    assert names.suggest_names(typed, none, ["scope"]).count() == 0
    some = spark.createDataFrame([(1, "ABC D"), (1, None), (1, " "), (2, "E")], "scope int, name string")
    assert rows(names.suggest_names(typed, some, ["scope"]), "scope", "typed", "name") == [(1, "ABC", "ABC D"), (2, "", "E")]
