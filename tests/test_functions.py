from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordlens.functions import dates, identity, text, vectors
from recordlens.functions.english import stem_word
from recordlens.operators import postings


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column).first()[0]


def terms(spark, question):
    df = spark.createDataFrame([(question,)], "q string")
    return [r["term"] for r in df.select(text.query_term_array(F.col("q")).alias("t")).first()["t"]]


def test_query_terms(spark):
    assert terms(spark, "exhaust exhaust EXHAUST odor") == ["exhaust", "odor"]
    assert terms(spark, " ".join(f"word{i}" for i in range(100))) == [f"word{i}" for i in range(24)]
    assert terms(spark, "is it a to") == []
    assert terms(spark, "!!! ??? ...") == []
    assert terms(spark, "   ") == []
    assert terms(spark, None) == []
    assert terms(spark, "recall 17V001000 and my F-150's tail-gate") == ["recall", "17V001000", "F150s", "tailgate"]
    assert terms(spark, "The VEHICLE it's Truck rattles") == ["rattles"]
    assert terms(spark, "Étrange bruit métallique") == ["Étrange", "bruit", "métallique"]


def test_no_usable_term_matches_nothing(spark):
    q = spark.createDataFrame([(1, "is it a to"), (2, "odor")], "query_id long, text string")
    assert [r["query_id"] for r in postings.query_terms(q).collect()] == [2]


def test_whitespace_is_unicode(spark):
    s = "  a  b\x85c 　"
    assert value(spark, text.collapse_ws(F.col("s")), s=s) == "a b c"
    assert value(spark, text.trim_ws(F.col("s")), s=s) == "a  b\x85c"
    assert value(spark, text.is_blank(F.col("s")), s=" \n\t") is True
    assert text.WHITESPACE == "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")


def test_snippet(spark):
    cut = lambda s: value(spark, text.snippet(F.col("s")), s=s)
    assert cut("a  b\n\tc") == "a b c"
    assert cut("x" * 240) == "x" * 240
    assert cut("x" * 480) == "x" * 240 + "…"
    long = cut("word " * 100)
    assert long.endswith("word…") and len(long) <= 241
    # A blank exactly at the limit is where the text is cut.
    assert cut("y" * 240 + " tail") == "y" * 240 + "…"


def test_small_texts(spark):
    assert value(spark, text.cited_id(F.col("s")), s="RECORD 1886") == "1886"
    assert value(spark, text.cited_id(F.col("s")), s=" record  7 ") == "7"
    assert value(spark, text.cited_id(F.col("s")), s="RECORDING-7") == "RECORDING-7"
    assert value(spark, text.component_prefix(F.col("s")), s="  SERVICE BRAKES, HYDRAULIC") == "SERVICE BRAK"
    assert value(spark, text.single_line(F.col("s")), s=" a\r\nb\nc\rd e ") == "a b c d e"
    assert value(spark, text.result_key(F.lit("sparse"), F.lit("all"))) == "sparse"
    assert value(spark, text.result_key(F.lit("sparse"), F.lit("campaigns"))) == "campaignsSparse"
    modes = ["dense", "sparse", "hybrid"]
    parsed = lambda s: value(spark, text.option(F.col("s"), modes, "hybrid"), s=s)
    assert [parsed(s) for s in ("  ", " DENSE ", "1", "magic")] == ["hybrid", "dense", None, None]


def test_slash_dates(spark):
    read = lambda s: value(spark, dates.slash_date(F.col("s")), s=s)
    assert read("1/2/2019") == date(2019, 1, 2)
    assert read("25/07/2017") == date(2017, 7, 25)
    assert read("10/06/2019") == date(2019, 10, 6)
    assert [read(s) for s in ("31/31/2017", "", "2017-07-27", "02/30/2019", "10/06/19")] == [None] * 5
    flag = lambda s: value(spark, dates.is_ambiguous_date(F.col("s")), s=s)
    assert [flag(s) for s in ("10/06/2019", "06/06/2019", "25/07/2017", "junk")] == [True, False, False, False]
    compact = lambda s: value(spark, dates.compact_date(F.col("s")), s=s)
    assert [compact(s) for s in (" 20170727 ", "", "2017-07-27", "20171332")] == [date(2017, 7, 27), None, None, None]


def test_windows_and_staleness(spark):
    covers = lambda d, end: value(spark, dates.covers(
        F.lit(date(2016, 2, 29)), F.lit(end).cast("date"), F.lit(d)))
    assert covers(date(2016, 2, 29), date(2016, 7, 26)) and covers(date(2016, 7, 26), date(2016, 7, 26))
    assert not covers(date(2016, 7, 27), date(2016, 7, 26)) and covers(date(2030, 1, 1), None)
    stale = lambda last: value(spark, dates.is_stale(
        F.lit(last).cast("timestamp"), F.lit(datetime(2026, 1, 2, 0, 1))))
    assert stale(datetime(2026, 1, 1, 0, 0)) and stale(datetime(2026, 1, 1, 0, 1)) and stale(None)
    assert not stale(datetime(2026, 1, 1, 23, 0))


def test_vins(spark):
    good = lambda s: value(spark, identity.is_vin(F.col("s")), s=s)
    assert good("1FTFW1RJ0PFB00000") and good(" 1ftfw1rj0pfb00000 ")
    assert not any(good(s) for s in ("1FTFW1RJ0PFB0000", "1FTFW1RJ0PFB0000O", "", "1FTFW1RJ0PFB0000é"))
    part = lambda s: value(spark, identity.vin_descriptor(F.col("s")), s=s)
    assert part(" 1fm5k8d80D") == "1FM5K8D8" and part("1FM5K8D") is None
    vin = lambda s: value(spark, identity.payload_vin(F.col("s")), s=s)
    assert vin('{"a": 1, "VIN": " X1 "}') == "X1"
    assert [vin(s) for s in ('{"vin": ""}', "not json", "", '{"vin": ["x"]}', "[1]")] == [None] * 5


def test_fit(spark):
    df = spark.createDataFrame(
        [("SuperCrew-Raptor", Decimal("5.2"), 8), (" ", Decimal("5.0"), 8), (None, Decimal("0.0"), 0), ("--", None, 6)],
        "trim string, engine_litres decimal(4,1), engine_cylinders int",
    )
    c = [F.col(x) for x in df.columns]
    found = [tuple(r) for r in df.select(identity.fit(*c).alias("f")).select("f.*").collect()]
    assert found == [
        ("SuperCrew-Raptor", "supercrewraptor", Decimal("5.2"), 8), (None, None, Decimal("5.0"), 8),
        (None, None, None, None), ("--", None, None, 6),
    ]
    assert value(spark, identity.trim_key(F.col("s")), s="supercrew raptor") == "supercrewraptor"
    label = lambda *v: value(spark, identity.fit_label(
        F.lit(v[0]).cast("string"), F.lit(v[1]).cast("decimal(4,1)"), F.lit(v[2]).cast("int")))
    assert label("Raptor", "5.2", 8) == "Raptor · 5.2L · 8 cyl"
    assert label(None, "5.0", None) == "5L"
    assert label(None, None, None) == "trim not decoded"


def test_hash_embedding(spark):
    import hashlib

    import numpy as np

    texts = ["odor", "", "émoi 😀"]
    made = vectors.hash_embed(texts)
    assert made.shape == (3, 1024) and np.allclose(np.linalg.norm(made, axis=1), 1, atol=1e-4)
    assert (vectors.hash_embed(["odor"])[0] == made[0]).all()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row, text_ in zip(df.select(vectors.hash_bytes(F.col("t"), 3)).collect(), texts):
        want = b"".join(hashlib.sha256(text_.encode() + b.to_bytes(4, "little")).digest() for b in range(3))
        assert row[0] == want.hex()
        raw = (np.frombuffer(want, np.uint8).astype(float) - 128) / 128
        mine = made[texts.index(text_)][:96]
        assert np.allclose(mine / np.linalg.norm(mine), raw / np.linalg.norm(raw), atol=1e-5)


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    row = df.select(
        vectors.cosine_distance(F.col("a"), F.col("b")).alias("d"),
        vectors.unit(F.col("a")).alias("u"), vectors.unit(F.col("z")).alias("e"),
    ).first()
    assert row["d"] == pytest.approx(1 - 24 / 25)
    assert row["u"] == pytest.approx([0.6, 0.8]) and row["e"] == [1.0, 0.0]


@pytest.mark.parametrize("word, stem", [
    ("accelerating", "acceler"), ("transmission", "transmiss"), ("brakes", "brake"), ("leaked", "leak"),
    ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("skies", "sky"), ("failure", "failur"),
    ("consistency", "consist"), ("generously", "generous"), ("gas", "gas"), ("news", "news"),
])
def test_stems(word, stem):
    assert stem_word(word) == stem


def test_english_analyzer(spark):
    df = spark.createDataFrame([(1, "The brakes were leaking, and the brake leaked.")], "id long, body string")
    found = postings.analyze(df, "body", "english").orderBy("position").collect()
    assert [r["lexeme"] for r in found] == ["brake", "leak", "brake", "leak"]
    q = spark.createDataFrame([(1, "leaking brakes leak")], "query_id long, text string")
    kept = postings.query_terms(q, analyzer="english").orderBy("pos").collect()
    assert [(r["pos"], r["lexeme"]) for r in kept] == [(0, "leak"), (1, "brake")]
    with pytest.raises(ValueError):
        postings.analyze(df, "body", "latin")
