import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlens.llm import negatives
from recordlens.llm.suite import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, x string, row string"


def brute(rows, every, positives, count, low, high):
    ok = {}
    for i, v, label in sorted(((i, v, label) for i, v, label, *_ in rows if i is not None and label is not None and v is not None
                               and all(c is not None and math.isfinite(c) for c in v)), key=lambda r: (r[0], r[2], r[1])):
        ok.setdefault(i, (label, [math.floor(256 * float(np.float32(c))) for c in v]))
    out = []
    for a, (label, v) in ok.items():
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(v, w, strict=False)) for i, (_, w) in ok.items() if i != a}
        for p in sorted((i for i in score if ok[i][0] == label), key=lambda i: (-score[i], i))[:positives]:
            fit = [i for i in score if ok[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            for rank, i in enumerate(sorted(fit, key=lambda i: (-score[i], i))[:count], 1):
                out.append((a, p, rank, i, score[p], score[i]))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def made(count, seed, dims=(20,)):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 0.4) for _ in range(max(dims))] for _ in range(5)]
    rows = []
    for i in range(count):
        centre = draw.choice(centres)
        rows.append((i, [float(np.float32(c + draw.gauss(0, 0.2))) for c in centre[:draw.choice(dims)]], draw.randrange(4), "clash", "clash"))
    rows += [(count + k, rows[k % 9][1], k % 3, None, None) for k in range(60)]  # ties
    rows += [(1, [0.25] * 20, 0, None, None), (2, rows[2][1], rows[2][2], None, None)]  # ids met before
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1, None, None), (901, [nan] * 20, 1, None, None), (902, [inf] + [0.0] * 19, 1, None, None),
             (903, [None] * 20, 1, None, None), (904, [0.5] * 20, None, None, None), (None, [0.5] * 20, 1, None, None),
             (910, [], 1, None, None), (920, [0.0] * 20, 2, None, None), (930, [-0.5] * 33, 2, None, None)]
    return rows


@pytest.mark.parametrize(("seed", "dims"), [(1, (20,)), (2, (64,)), (3, (3, 16, 40))])
def test_equals_brute_force(spark, monkeypatch, seed, dims):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 37)
    monkeypatch.setattr(negatives, "BLOCKS_A_GROUP", 3)
    monkeypatch.setattr(negatives, "ANCHORS_A_GROUP", 9)
    rows = made(400, seed, dims)
    df = negatives.taking_part(spark.createDataFrame(rows, SCHEMA).repartition(5))
    for count, low, high in ((10, 30, 90), (3, 0, 100)):
        got = found(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, positives=4, negatives=count, low=low, high=high))
        assert got == brute(rows, 10, 4, count, low, high) and got


def test_bounds_hold_and_rule_out(monkeypatch):
    draw = np.random.default_rng(4)
    centres = np.repeat(draw.integers(-90, 90, (12, 8)), 8, axis=1)
    a = negatives.Side(np.arange(40), np.zeros(40), (centres[draw.integers(0, 12, 40)] + draw.integers(-9, 9, (40, 64))).astype(float))
    b = negatives.Side(np.arange(900), np.zeros(900), (centres[draw.integers(0, 12, 900)] + draw.integers(-9, 9, (900, 64))).astype(float))
    exact = (a.matrix @ b.matrix.T).astype(int)
    low, high = np.quantile(exact, 0.9, axis=1), np.quantile(exact, 0.95, axis=1)
    at, to, score = negatives.scored(a, b, np.ones(exact.shape, bool), low, high)
    assert (score == exact[at, to]).all()
    left = np.zeros(exact.shape, bool)
    left[at, to] = True
    assert left[(exact >= low[:, None]) & (exact <= high[:, None])].all()
    assert left.mean() < 0.25


def test_numbers_that_doubles_do_not_hold(spark):
    rows = [(0, [3.0e6] * 3, 1, "", ""), (10, [2.9999998e6] * 3, 1, "", ""), (1, [1.1e6, 1.3e6, 1.7e6], 2, "", ""), (3, [0.1, 2e6, 1e6], 2, "", "")]
    df = negatives.taking_part(spark.createDataFrame(rows, SCHEMA))
    got = found(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert got == brute(rows, 10, 5, 10, 30, 90) and got[0][4] > 1 << 53


def test_one_label_for_a_third_and_none_for_others(spark):
    draw = random.Random(8)
    rows = [(i, [draw.random() for _ in range(8)], 0 if i % 3 == 0 else i, "", "") for i in range(300)]
    df = negatives.taking_part(spark.createDataFrame(rows, SCHEMA))
    assert found(negatives.hard_negatives(df, F.col("vec_id") % 20 == 0)) == brute(rows, 20, 5, 10, 30, 90)


def test_empty_table(spark):
    nothing = negatives.taking_part(spark.createDataFrame([], SCHEMA))
    assert negatives.hard_negatives(nothing, F.col("vec_id") % 10 == 0).count() == 0


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    got = op12_hard_negatives(spark, "/root/testdata/sf0.001")
    cursor = con.execute(negatives.ORACLE)
    assert got.columns == [c[0] for c in cursor.description]
    assert found(got) == sorted(cursor.fetchall())
