import random
import re
from collections import Counter

import duckdb
import pytest

from recordlens.llm import phrases


def brute(rows, least, top):
    """The definition, as loops over every phrase of every piece."""
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\f\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(5, len(words) - i) + 1):
                    counts[lang, tuple(words[i:i + m])] += 1
    often = {k: f for k, f in counts.items() if f >= least}
    out = []
    for lang in total:
        scored = []
        for (of, p), a in often.items():
            if of != lang or len(p) < 2:
                continue
            if any(o == lang and len(q) > len(p) and f >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for (o, q), f in often.items()):
                continue
            cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def made(count, seed):
    draw = random.Random(seed)
    words = ["a", "B", "the", "é", "日本", "x\x00y", "dog's", "\xa0", "𝔘", "A"]
    rows = [("".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for _ in range(draw.randint(0, 60))),
             draw.choice(["en", "de", None, "und"])) for _ in range(count)]
    rows += [(rows[k % 7][0], "en") for k in range(30)] + [("lone", "en"), ("", "en"), (None, None), (" \t.,\n", "fr")]
    return rows + [("again " * 500 + "end", "en"), ("to be or not " * 90, "de")]


@pytest.mark.parametrize("modulus", [1, 3, 1000])
def test_equals_brute_force(spark, modulus):
    rows = made(120, modulus)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    found = sorted(tuple(r) for r in phrases.collocations(docs, least=4, top=40, modulus=modulus).collect())
    assert found == brute(rows, 4, 40)


def test_every_start_lies_in_one_chunk(spark):
    rows = made(60, 5)
    docs = spark.createDataFrame(rows, "text string, lang string")
    for modulus in (1, 2, 7):
        chunks = phrases.chunk_dictionary(docs, modulus=modulus)
        owned = sum((len(re.findall(r"[^ \n]+", r.chunk)) - 4 * r.follows) * r.times for r in chunks.collect())
        assert owned == sum(len(re.findall(r"[^ \t.,;:!?\n\x0b\f\r]+", t or "")) for t, _ in rows)


def test_numbers_beyond_64_bits(spark):
    pieces = [(f"{a} {b}", "en") for a, b in [("big", "deal")] * 9 + [("big", "dog"), ("raw", "deal")]]
    counted = spark.createDataFrame([("en", p, w, f) for p, w, f in [
        ("big", 1, 2_000_000_000_000), ("deal", 1, 3_000_000_000_000), ("big deal", 2, 1_999_999_999_999)]], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 9_000_000_000_000_000)], "lang string, n long")
    row = phrases.ranked(counted, totals, 10).collect()[0]
    assert row["score"] == 1000 * 1_999_999_999_999 * 9_000_000_000_000_000 // (2_000_000_000_000 * 3_000_000_000_000)
    assert [r["phrase"] for r in phrases.collocations(spark.createDataFrame(pieces, "text string, lang string"), least=9).collect()] == ["big deal"]


def test_a_crowded_bitmap_changes_nothing(spark, monkeypatch):
    rows = made(80, 9)
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(phrases, "BITS", 1 << 15)
    few = sorted(tuple(r) for r in phrases.collocations(docs, least=3).collect())
    monkeypatch.setattr(phrases, "_frequent", lambda bits, hashes: hashes == hashes)
    assert few == sorted(tuple(r) for r in phrases.collocations(docs, least=3).collect()) == brute(rows, 3, 2000)


def test_slices_change_nothing(spark, monkeypatch):
    rows = made(80, 11)
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(phrases, "BYTES_AT_ONCE", 200)
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=3).collect()) == brute(rows, 3, 2000)


def test_edges(edge, nothing):
    wanted = brute([(r["text"], r["lang"]) for r in edge.collect()], 2, 2000)
    assert sorted(tuple(r) for r in phrases.collocations(edge, least=2).collect()) == wanted and wanted
    assert phrases.collocations(nothing).count() == 0


def test_equals_its_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = phrases.collocations(docs)
    cursor = con.execute(phrases.ORACLE)
    assert [c[0] for c in cursor.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(cursor.fetchall())
