import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from recordlens.llm import lattice, line_windows, rules, spotsigs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---- line windows ------------------------------------------------------------------------------------------------

def by_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return sorted(con.execute(line_windows.ORACLE).fetchall(), key=str)


def test_line_windows_equal_sql(spark):
    draw = random.Random(5)
    lines = ["alpha", "beta", "gamma", "delta", "", "  ", "eps"]
    texts = ["\n".join(draw.choice(lines) for _ in range(draw.randint(0, 14))) for _ in range(150)] + [None, "", "a\nb\nc\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_windows.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
    assert sorted(map(tuple, found.collect()), key=str) == by_sql(docs)


def test_line_windows_edges(spark, edge, nothing):
    out = line_windows.dedup_lines(edge)
    assert out.count() == edge.count() and sorted(out.columns) == sorted({*edge.columns, "n_removed"})
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_removed"]))
    assert by_id[2] == [(None, 0, 0)] and by_id[3] == [("", 1, 0)]
    assert len(set(by_id[1])) == 2 and by_id[6][0][2] == 0
    assert line_windows.dedup_lines(nothing).count() == 0


def test_copies_lose_their_lines_and_the_first_keeps_them(spark):
    text = "\n".join(f"line {k}" for k in range(20))
    docs = spark.createDataFrame([(3, text), (2, text + "\nmore"), (9, "x\n" + text), (2, text + "\nmore")], "doc_id long, text string")
    found = sorted((r["doc_id"], r["text"]) for r in line_windows.dedup_lines(docs).collect())
    assert found == [(2, text + "\nmore"), (2, text + "\nmore"), (3, ""), (9, "x")]


# ---- fingerprints ------------------------------------------------------------------------------------------------

def brute_signatures(spark, text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    tokens = []
    for k, w in enumerate(words):
        if w not in spotsigs.ANCHORS:
            tokens.append((words[k - 1] if k and words[k - 1] in spotsigs.ANCHORS else None, w))
    pairs = [(f"{a}:{w}" if a else w, tokens[k + 1][1] if k + 1 < len(tokens) else "") for k, (a, w) in enumerate(tokens)]
    if not pairs:
        return set()
    rows = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "hash(a) AS own", "hash(a, b) AS chain").collect()
    some = {r["chain"] for r in rows if ":" in r["a"] or r["own"] % spotsigs.SPARE == 0}
    return some or {r["chain"] for r in rows}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints_equal_brute_force(spark):
    draw = random.Random(6)
    words = "the of a dog cat house tree und der la red big runs ñu 42".split()
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 40))) + draw.choice(["", ".", " the", " of the"]) for _ in range(14)]
    texts += [None, "", "x", "...", texts[0]]
    ids = [5 * k for k in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(docs).collect()}
    for k, text in enumerate(texts):
        text, after = text or "", texts[k - 1] or ""  # descending order; the first of all follows the last
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        row = got[ids[k]]
        assert (row["n_chars"], row["edited"]) == (len(text), edited)
        assert set(row["sigs"]) == brute_signatures(spark, text) and set(row["edited_sigs"]) == brute_signatures(spark, edited)
        assert set(row["next_sigs"]) == brute_signatures(spark, after)


def test_next_document_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "DOCUMENTS_A_GROUP", 7)
    draw = random.Random(7)
    ids = draw.sample(range(-1000, 10**9), 300)
    docs = spark.createDataFrame([(i, f"abcdef{i}xyz") for i in ids], "doc_id long, text string")
    order = sorted(ids, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = spotsigs.fingerprints(docs).collect()
    assert len(rows) == 300
    for r in rows:
        own, other = f"abcdef{r['doc_id']}xyz", f"abcdef{after[r['doc_id']]}xyz"
        cut = len(own) // 3
        assert r["edited"] == own[:len(own) - cut] + other[:cut]


def test_fingerprint_edges(edge, nothing, spark):
    from pyspark.sql import functions as F

    rows = spotsigs.fingerprints(edge).collect()
    assert len(rows) == edge.count() and {r["doc_id"] for r in rows} == {r[0] for r in edge.select("doc_id").collect()}
    assert spotsigs.fingerprints(nothing).count() == 0
    one = spotsigs.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited"] == "abcdab"
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))
    row = spark.range(1).select(spotsigs.likeness(a, b), spotsigs.likeness(a, b, 0.8), spotsigs.likeness(a.cast("array<int>"), F.array().cast("array<int>"))).first()
    assert tuple(row) == (0.5, 0.0, 0.0)


def test_near_pairs_equal_brute_force(spark):
    draw = random.Random(8)
    base = [" ".join(draw.choice(["the", "of", *map(chr, range(97, 123))]) + str(draw.randint(0, 30)) if draw.random() < .7 else "the"
                     for _ in range(60)) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(4):
            words = b.split()
            words[draw.randrange(60)] = "changed"
            texts.append(" ".join(words))
    texts += texts[:5] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, pairs = spotsigs.near_pairs(docs)
    sets = [frozenset(brute_signatures(spark, t)) for t in texts]
    first = {s: sets.index(s) for s in sets}
    assert {tuple(r) for r in members.collect()} == {(k, first[s]) for k, s in enumerate(sets)}
    wanted = {(i, j) for i, j in itertools.combinations(sorted(first.values()), 2) if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8}
    assert {(r[0], r[1]) for r in pairs.collect()} == wanted and wanted


# ---- scoring -----------------------------------------------------------------------------------------------------

TOY = [("▁", -1.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁a", -2.2), ("ba", -3.0), ("aba", -4.0)]


def test_lattice_equals_sum_over_segmentations():
    table = lattice.Lattice.of(TOY)
    weight = {text: float(table.start[256 + k]) for k, (text, _) in enumerate(TOY)}

    def brute(text):
        if not text:
            return 1.0
        total = sum(math.exp(w) * brute(text[len(p):]) for p, w in weight.items() if text.startswith(p))
        if text[0] not in weight:
            total += math.exp(sum(table.start[b] for b in text[0].encode())) * brute(text[1:])
        return total

    words = ["".join(p) for n in range(1, 6) for p in itertools.product("abé", repeat=n)]
    got = lattice.word_logs([w.encode() for w in words], table, table.start)
    assert np.allclose(got, [math.log(brute("▁" + w)) for w in words])


def test_expected_counts_add_up():
    table = lattice.Lattice.of(TOY)
    for places, chars in lattice.by_length([b"abab", b"aaaa"]):
        logs, expected = table.weigh(chars, table.start, np.array([3.0, 2.0]))
        spelled = sum(expected[256 + k] * len(text) for k, (text, _) in enumerate(TOY))
        assert np.isclose(spelled, 5 * 5) and len(logs) == len(places) == 2


@pytest.mark.parametrize("frequent", [0, 3, 10_000])
def test_scores(edge, frequent):
    rows = lattice.score_texts(edge.select("doc_id", "text", "lang", "score", "word"), TOY, frequent_words=frequent, rounds=1).collect()
    texts = [(r[0], r[1]) for r in edge.select("doc_id", "text").collect()]
    counts, total, scores = Counter(), 0, {}
    tokens = lambda t: [lower(w) for w in WORD.findall(t or "")] + [" end"]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    for i, t in texts:
        if not held(i):
            counts.update(tokens(t))
            total += len(tokens(t))
    scale = total + 0.5 * (len(counts) + 1)
    wanted = sorted((held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total,
                     round(sum(math.log10((counts[w] + 0.5) / scale) for w in tokens(t)), 6)) for i, t in texts)
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == wanted
    for r in rows:
        assert math.isfinite(r["score"]) and r["score"] < 0 and r["word"] == "clash"
        scores.setdefault((r["doc_id"], r["n_tokens"]), set()).add(round(r["score"], 9))
    assert all(len(s) == 1 for s in scores.values())


def test_scores_are_a_probability():
    counts = lattice.Counts(words=10, types=4, once=2, twice=1, texts=3)
    words = [b"a", b"b", b"ab", b"aab"]
    seen = np.array([5, 2, 2, 1])
    table = lattice.Lattice.of([("▁", 0.0), ("a", 0.0), ("b", 0.0)])
    every = [bytes(p) for n in range(1, 14) for p in itertools.product(b"ab", repeat=n)]
    logs = counts.log10(np.array([dict(zip(words, seen, strict=True)).get(w, 0) for w in every]), lattice.word_logs(every, table, table.start))
    assert 0.5 < (10.0 ** logs).sum() + counts.end <= 1.0


def test_scores_of_nothing(nothing):
    assert lattice.score_texts(nothing.select("doc_id", "text"), TOY).count() == 0


# ---- rules -------------------------------------------------------------------------------------------------------

def brute_counts(text):
    words, text = WORD.findall(text or ""), text or ""
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(k, k + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark, edge, nothing):
    draw = random.Random(9)
    texts = ["".join(draw.choice("ab c\n\n #|xé ") for _ in range(draw.randint(0, 200))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = rules.MEASURES[:5]
    found = {r["doc_id"]: tuple(r[n] for n in names) for r in rules.measure(docs).collect()}
    assert found == {k: brute_counts(t) for k, t in enumerate(texts)}
    assert sorted(tuple(r[n] for n in names) for r in rules.measure(edge).collect()) == sorted(
        brute_counts(r[0]) for r in edge.select("text").collect())
    assert rules.measure(nothing).count() == 0


def test_binomial_test():
    for k, n, p in ((0, 100, 0.02), (3, 200, 0.05), (7, 50, 0.3)):
        exact = sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))
        assert math.isclose(rules.at_most(k, n, p), exact, rel_tol=1e-9)
    assert rules.at_most(5, 5, 0.1) == 1.0 and rules.at_most(0, 0, 0.1) == 1.0


def test_chosen_cutoffs_keep_the_limit():
    counts = [("en", "symbols", 0, 5000, 10), ("en", "symbols", 30, 3, 0), ("en", "symbols", 60, 0, 400), ("de", "symbols", 60, 1, 3)]
    chosen = rules.choose(counts, {"symbols": 100}, limit=0.01, error=0.05)
    assert [(c[0], c[1]) for c in chosen] == [("en", "symbols")] and 30 <= chosen[0][2] < 60


def test_rules_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = rules.apply_rules(edge, labels)
    assert out.count() == edge.count() and "text" not in out.columns
    for r in out.collect():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert rules.apply_rules(nothing, labels).count() == 0
    assert rules.apply_rules(edge, labels.limit(0)).where("NOT base_failed AND NOT kept").count() == 0


def test_rules_reject_what_labels_call_bad(spark):
    good = [(k, "plain words in a clean text number " + " ".join(f"w{k}x{j}" for j in range(12)), "en") for k in range(900)]
    bad = [(1000 + k, " ".join(f"w{k}y{j}%%%" for j in range(14)), "en") for k in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k < 900)) for k, _, _ in good + bad], "doc_id long, quality int")
    kept = {r["doc_id"] for r in rules.apply_rules(docs, labels).where("kept").collect()}
    assert kept == set(range(900))


def test_sha_of_edited_text(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "xyzxyz")], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r[0]: r[1] for r in spotsigs.fingerprints(docs).select("doc_id", F.sha2("edited", 256)).collect()}
    assert got[2] == hashlib.sha256(b"xyzxab").hexdigest() and got[1] == hashlib.sha256(b"ab").hexdigest()
