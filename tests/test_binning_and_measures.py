"""Majority descent, densities and transitions against base-by-base definitions."""

import random
from statistics import median

import pytest

from tilespan.operators import binning, measures

from .test_intervals import SCHEMA, plain_runs, tiling

PARENT = {"b1": "top", "a": "b1", "b": "b1", "c": "top", "d": "c", "top2": "top", "e": "top2"}
EDGES = [("t", k, v) for k, v in PARENT.items()]
LABELS = ["a", "b", "c", "d", "e", "b1", "novel"]


def plain_descent(weights, majority, scope, novel_min):
    """Step by step from the root, as stated."""
    total = sum(weights.values())
    novel = weights.get("novel", 0)
    if novel and (novel >= novel_min * total or novel == total):
        return "novel"
    weights = {k: v for k, v in weights.items() if k != "novel"}
    total = sum(weights.values())

    def line(x):
        return [x] + (line(PARENT[x]) if x in PARENT else [])

    sub, depth = {}, {}
    for x in set(PARENT) | set(PARENT.values()):
        depth[x] = len(line(x)) - 1
    for x, v in weights.items():
        for y in line(x):
            sub[y] = sub.get(y, 0) + v
    at = "top"
    while kids := [k for k, p in PARENT.items() if p == at and sub.get(k)]:
        best = max(kids, key=lambda k: (sub[k], depth[k], k))
        if sub[best] <= majority * (sub[at] if scope == "node" else total):
            break
        at = best
    return at if at != "top" else max(weights, key=lambda k: (weights[k], depth[k], k))


def plain_binning(rows, window, step, majority, scope, novel_min):
    out = []
    for q in sorted({r[0] for r in rows}):
        own = sorted(r[1:] for r in rows if r[0] == q)
        low, label = own[0][0], [f for s, e, f in own for _ in range(s, e)]
        for p in range(0, len(label), step):
            c = min(len(label) - 1, p + step // 2)
            part = label[max(0, c - (window - 1) // 2) : c + window // 2 + 1]
            f = plain_descent({x: part.count(x) for x in set(part)}, majority, scope, novel_min)
            out.append((q, low + p, low + min(p + step, len(label)), f))
    return plain_runs(out)


@pytest.mark.parametrize("scope", ["node", "window"])
@pytest.mark.parametrize("majority", [0.0, 0.3, 0.5, 0.7])
def test_binning(spark, scope, majority):
    r = random.Random(hash((scope, majority)) % 1000)
    rows = tiling(r, 6, LABELS, 80)
    df, edges = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(EDGES, "feature_set string, child string, parent string")
    for window, step in ((11, 1), (21, 1), (30, 7)):
        found = binning.bin_annotations(df, edges, window, step, majority=majority, scope=scope, novel_min=0.4)
        assert sorted(tuple(x) for x in found.collect()) == plain_binning(rows, window, step, majority, scope, 0.4)


def test_long_stretches_cost_no_bases(spark, monkeypatch):
    """Windows are evaluated where weights bend and where the label changes, not at every base; a long sequence is dealt in pieces."""
    rows, low = [], 5
    r = random.Random(3)
    for k in range(40):
        n = r.choice([3, 40, 5_000_000])
        rows.append(("q", low, low + n, r.choice(LABELS)))
        low += n
    rows += [("one", 0, 7, "a")]
    df, edges = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(EDGES, "feature_set string, child string, parent string")
    for piece in (1 << 20, 777_777):
        found = sorted(tuple(x) for x in binning.bin_exact(df, edges, 101, piece=piece).collect())
        assert found.pop(0) == ("one", 0, 7, "a") and found[0][1] == 5 and found[-1][2] == low
        assert all(a[2] == b[1] and a[3] != b[3] for a, b in zip(found[:-1], found[1:]))
        calls = {s: f for _, s, _, f in found}
        for s, f in list(calls.items()):
            for x in (s, s - 1):
                if x >= 5:
                    own = [max(0, min(e, x + 51) - max(b, x - 50)) for _, b, e, _ in rows[:-1]]
                    weights = {}
                    for w, (_, _, _, label) in zip(own, rows):
                        if w:
                            weights[label] = weights.get(label, 0) + w
                    at = max(k for k in calls if k <= x)
                    assert calls[at] == plain_descent(weights, 0.5, "node", 0.5)


def test_tiles_by_chunks(spark):
    df = spark.createDataFrame([("q", 3, 60, "a"), ("q", 60, 103, "b"), ("one", 0, 1, "a")], SCHEMA)
    want = sorted(map(tuple, binning.windows(df, 11, 4).collect()))
    assert sorted(map(tuple, binning.windows(df, 11, 4, chunk=3).collect())) == want
    assert [(x[1], x[2]) for x in want if x[0] == "q"] == [(s, min(s + 4, 103)) for s in range(3, 103, 4)] and ("one", 0, 1, 0, 1) in want


def test_pieces_do_not_matter(spark):
    rows = tiling(random.Random(9), 4, LABELS, 120)
    df, edges = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(EDGES, "feature_set string, child string, parent string")
    a, b = (sorted(tuple(x) for x in binning.bin_exact(df, edges, 15, piece=p).collect()) for p in (7, 50_000))
    assert a == b


@pytest.mark.parametrize("window", [1, 5, 17, 40])
def test_densities(spark, window):
    rows = tiling(random.Random(window), 25, "abcd", 70)
    want = {}
    for q in {x[0] for x in rows}:
        own = sorted(x[1:] for x in rows if x[0] == q)
        label = [f for s, e, f in own for _ in range(s, e)]
        for f in set(label):
            hit = [int(x == f) for x in label]
            s = [sum(hit[i : i + window]) / window for i in range(len(hit) - window + 1)] if len(hit) >= window else [sum(hit) / len(hit)]
            want[q, f] = (max(s), min(s), median(s), s[0], s[-1], max(s[0], s[-1]), min(s[0], s[-1]))
    found = measures.window_densities(spark.createDataFrame(rows, SCHEMA), window).collect()
    assert {(x.seq_id, x.feature): tuple(round(x[d], 9) for d in measures.DENSITIES) for x in found} == {k: tuple(round(v, 9) for v in w) for k, w in want.items()}


def test_fractions_weights_and_matrix(spark):
    rows = [("A", *x) for x in tiling(random.Random(1))] + [("B", *x) for x in tiling(random.Random(2))]
    df = spark.createDataFrame(rows, "feature_set string, " + SCHEMA)
    shares = measures.feature_fraction(df)
    assert all(abs(x.s - 1) < 1e-9 for x in shares.groupBy("feature_set", "seq_id").agg({"frac": "sum"}).withColumnRenamed("sum(frac)", "s").collect())
    wide = measures.wide_matrix(measures.long_metrics(df, 10))
    assert wide.count() == 20 and wide.where("A__total_bp <> A__bp__a + A__bp__b + A__bp__c").count() == 0
    weights = measures.genome_weights(df).collect()
    assert max(w.weight for w in weights) == 1.0 and all(0 <= w.weight <= 1 for w in weights)
    t = measures.adaptive_thresholds(shares).collect()
    assert all(0.001 <= x.threshold <= 0.05 for x in t)


def test_one_label_has_no_information(spark):
    df = spark.createDataFrame([("A", "x", 0, 5, "a")], "feature_set string, " + SCHEMA)
    assert measures.genome_weights(df).first().weight == 0.0
