"""Exact search against brute force."""

import math
import random

import numpy as np

from pyspark.sql import functions as F

from tilespan.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, raw string, score int, part int"


def vectors():
    r = random.Random(1)
    out = [(k, [r.gauss(0, 0.3) for _ in range(12)], "x", 1, 2) for k in range(400)]
    out += [(500 + k, out[3][1], "x", 1, 2) for k in range(40)]  # copies: ties
    out += [(700 + k, [round(r.uniform(-1, 1)) * 0.5 for _ in range(12)], "x", 1, 2) for k in range(100)]
    out += [(850, None, None, 1, 2), (851, [0.1, None] + [0.0] * 10, "x", 1, 2), (852, [math.nan] * 12, "x", 1, 2), (853, [math.inf] + [0.0] * 11, "x", 1, 2), (None, [0.1] * 12, "x", 1, 2)]
    out += [(900, [0.5, 0.5], "x", 1, 2), (901, [0.25, -1.0], "x", 1, 2), (950, [], "x", 1, 2), (951, [], "x", 1, 2), (100, out[100][1], "x", 1, 2)]
    return out


def brute(rows, every, top):
    good = []
    for i, v, *_ in {(i, None if v is None else tuple(v)) for i, v, *_ in rows}:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * float(np.float32(e))) for e in v]
        good.append((i, x))
    answers = []
    for i, q in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in good if j != i and len(x) == len(q))[:top]
            answers += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    return sorted(answers)


def test_against_brute_force(spark):
    rows = vectors()
    for every, top in ((50, 5), (7, 3)):
        got = [tuple(r) for r in vafile.search(spark.createDataFrame(rows, SCHEMA), every, top).select("query_id", "rank", "vec_id", "score").collect()]
        assert sorted(set(got)) == brute(rows, every, top)
        assert sum(1 for g in got if g[0] == 100 and g[1] == 1) == (2 if every == 50 else 0)  # the repeated row asks twice


def test_one_id_with_many_vectors(spark, monkeypatch):
    """An id's own vectors, however many and however near, take no place of its answer."""
    r = random.Random(5)
    rows = [(k, [r.uniform(-1, 1) for _ in range(6)], "x", 1, 2) for k in range(1, 50)]
    rows += [(0, [3.0 + r.random() for _ in range(6)], "x", 1, 2) for _ in range(30)] + [(0, [0.5, 0.5], "x", 1, 2), (3, [0.1, 0.2], "x", 1, 2)]
    rows += [(100, rows[-3][1], "x", 1, 2), (100, [9.0] * 6, "x", 1, 2)] + [(k, rows[-3][1], "x", 1, 2) for k in (150, 151, 152)]  # shares a vector with 0
    for block in (8192, 7):
        monkeypatch.setattr(vafile, "BLOCK", block)
        got = sorted(tuple(g) for g in vafile.search(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("query_id", "rank", "vec_id", "score").collect())
        want = brute(rows, 50, 5)
        assert got == want and sum(g[0] == 0 for g in got) >= 30 * 5


def test_empty_and_few(spark):
    assert vafile.search(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([(0, [1.0], "", 0, 0), (1, [2.0], "", 0, 0)], SCHEMA)
    assert [tuple(r) for r in vafile.search(few).collect()] == [(0, 1, 1, 256 * 512)]


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 50)
    monkeypatch.setattr(vafile, "QUERIES", 8)
    rows = vectors()
    got = vafile.search(spark.createDataFrame(rows, SCHEMA).repartition(3), 7, 4).select("query_id", "rank", "vec_id", "score").distinct().orderBy(F.col("query_id"), "rank").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 7, 4)


def large():
    """Components up to a float's largest; most scores with them vanish or lose, so that all that is returned has 64 bits."""
    r = random.Random(6)
    out = [(k, [0.0, round(r.uniform(-1, 1), 2), 5.0], "x", 1, 2) for k in range(60)]
    out += [(61, [1e17, 0.25, 4.0], "x", 1, 2), (62, [-1e30, 3.0, 3.0], "x", 1, 2), (63, [3e38, -1e16, -3e38], "x", 1, 2), (64, [-3e38, 0.5, -1e20], "x", 1, 2), (65, [1e17, 0.25, 4.5], "x", 1, 2)]
    out += [(k, [1.0, -1.0, -1.0], "x", 1, 2) for k in (70, 71)]
    return [(i, v if i != 50 else [0.0, 2.0, 3.0], *x) for i, v, *x in out]


def test_large_components_take_part(spark, monkeypatch):
    rows = large()
    for block in (8192, 9):
        monkeypatch.setattr(vafile, "BLOCK", block)
        got = sorted(tuple(g) for g in vafile.search(spark.createDataFrame(rows, SCHEMA).repartition(2)).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute(rows, 50, 5)


def test_doubles_of_any_size(spark):
    schema = SCHEMA.replace("float", "double")
    rows = [(k, [0.0, k / 7, 1.0], "x", 1, 2) for k in range(12)] + [(20, [0.0, -1e300, 1e14], "x", 1, 2), (21, [1e300, 1.0, 1.0], "x", 1, 2), (22, [-1e300, 1.0, -1e300], "x", 1, 2), (23, [1e307, 1e308, 0.0], "x", 1, 2)]
    got = sorted(tuple(g) for g in vafile.search(spark.createDataFrame(rows, schema)).select("query_id", "rank", "vec_id", "score").collect())
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i != 23]  # 256e308 is no double
    scored = sorted((-sum(a * b for a, b in zip(good[0][1], v)), i) for i, v in good if i != 0)[:5]
    assert got == [(0, k + 1, i, -s) for k, (s, i) in enumerate(scored)] and got[0][2] == 20


def test_a_score_beyond_64_bits_is_an_error(spark):
    rows = [(0, [1e17, 1.0], "x", 1, 2), (1, [1e17, 1.0], "x", 1, 2)]
    try:
        vafile.search(spark.createDataFrame(rows, SCHEMA)).collect()
    except Exception as e:  # Spark's own class
        assert "passes 64 bits" in str(e)
    else:
        raise AssertionError


def test_scores_are_exact():
    r = random.Random(2)
    for scale in (10, 10**9, 10**18, 10**40):
        x = np.array([[float(r.randint(-scale, scale)) for _ in range(5)] for _ in range(7)])
        q = np.array([float(r.randint(-scale, scale)) for _ in range(5)])
        assert [int(s) for s in vafile.scores(x, q)] == [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
