"""Interval algebra against plain definitions on random tilings."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tilespan.functions import intervals as I

SCHEMA = "seq_id string, start long, end long, feature string"


def tiling(r, n=20, labels="abc", most=60):
    out = []
    for k in range(n):
        at, end = r.randint(0, 9), r.randint(10, most)
        while at < end:
            to = min(end, at + r.randint(1, 12))
            out.append((f"q{k}", at, to, r.choice(labels)))
            at = to
    return out


def loose(r, n=20, most=40):
    return [(f"q{k}", s, s + r.randint(1, 15), r.choice("abc")) for k in range(n) for s in (r.randint(0, most) for _ in range(r.randint(0, 9)))]


def bases(rows):
    out = defaultdict(set)
    for q, s, e, *_ in rows:
        out[q] |= set(range(s, e))
    return out


def plain_runs(rows):
    out = []
    for q, s, e, f in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        if out and out[-1][0] == q and out[-1][3] == f and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([q, s, e, f])
    return sorted(map(tuple, out))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_coalesce(spark):
    rows = tiling(random.Random(1))
    assert got(I.coalesce_runs(spark.createDataFrame(rows, SCHEMA))) == plain_runs(rows)
    nested = [("x", 0, 20, "a"), ("x", 2, 5, "a"), ("x", 10, 12, "a"), ("x", 19, 25, "a"), ("x", 30, 31, "a")]
    assert got(I.coalesce_runs(spark.createDataFrame(nested, SCHEMA))) == [("x", 0, 25, "a"), ("x", 30, 31, "a")]


def test_merge_and_cover(spark):
    rows = loose(random.Random(2))
    cover = bases(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.seq_id: r.covered for r in I.total_covered(df).collect()} == {q: len(b) for q, b in cover.items()}
    merged = got(I.merge_overlapping(df))
    assert bases(merged) == cover
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(merged, merged[1:]))


def test_max_block(spark):
    rows = [("x", 0, 10, "a"), ("x", 15, 20, "a"), ("x", 40, 45, "a"), ("y", 3, 4, "a")]
    assert got(I.max_block(spark.createDataFrame(rows, SCHEMA), ["seq_id"], 5)) == [("x", 20), ("y", 1)]


def test_refine(spark):
    r = random.Random(3)
    a = tiling(r)
    ends = {q: (min(x[1] for x in a if x[0] == q), max(x[2] for x in a if x[0] == q)) for q in {x[0] for x in a}}
    b = [(q, s, e, f) for q, (lo, hi) in ends.items() for s, e, f in ((lo, (lo + hi) // 2, "u"), ((lo + hi) // 2, hi, "v")) if s < e]
    found = I.refine({"A": spark.createDataFrame(a, SCHEMA), "B": spark.createDataFrame(b, SCHEMA)}).collect()
    base = {}
    for x in found:
        for p in range(x.start, x.end):
            assert (x.seq_id, p) not in base
            base[x.seq_id, p] = (x.A, x.B)
    want = {(q, p): f for q, s, e, f in a for p in range(s, e)}
    other = {(q, p): f for q, s, e, f in b for p in range(s, e)}
    assert base == {k: (want[k], other[k]) for k in want}


def test_overlap_join(spark):
    r = random.Random(4)
    a, b = loose(r), loose(r)
    want = sorted((q, max(s, t), min(e, u), f"{f}:{g}") for q, s, e, f in a for p, t, u, g in b if p == q and s < u and t < e)
    for size in (4, 1 << 14):
        assert got(I.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), bin_size=size)) == want


def test_subtract_and_fill(spark):
    r = random.Random(5)
    rows, block = tiling(r), loose(r)
    left = I.subtract(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(block, SCHEMA))
    hidden = bases(block)
    want = {(q, p): f for q, s, e, f in rows for p in range(s, e) if p not in hidden[q]}
    assert {(x.seq_id, p): x.feature for x in left.collect() for p in range(x.start, x.end)} == want
    first = I.merge_overlapping(spark.createDataFrame(block, SCHEMA)).withColumn("feature", F.lit("z"))
    filled = I.priority_fill(first, spark.createDataFrame(rows, SCHEMA)).collect()
    assert {x.seq_id for x in filled} == {x[0] for x in rows} & {x[0] for x in block}


def test_mismatches(spark):
    a = spark.createDataFrame([("x", 0, 5, "a"), ("y", 0, 5, "a"), ("z", 0, 4, "a")], SCHEMA)
    b = spark.createDataFrame([("x", 0, 5, "b"), ("z", 0, 5, "b")], SCHEMA)
    assert got(I.track_mismatches({"A": a, "B": b})) == [("y", "missing"), ("z", "span")]
