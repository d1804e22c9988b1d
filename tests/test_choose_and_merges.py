"""Greedy choices, merges base by base, and the sweep over numbers of clusters."""

import random

import numpy as np

from tilespan.operators import choose, clusters, legacy, merges

from .test_intervals import SCHEMA


def test_by_sample_is_proportional(spark):
    """Each sample's rounded share, one at least, largest samples first while slots last."""
    r = random.Random(0)
    for n, pool in ((9, "aaabbc"), (3, "abcdefg"), (40, "aab"), (1, "ab")):
        rows = [(f"c{k % 2}", k, r.choice(pool), r.random()) for k in range(60)]
        got = choose.by_sample(spark.createDataFrame(rows, "cluster_id string, read_id long, sample string, centroid_distance double"), n).collect()
        for c in ("c0", "c1"):
            own, left, want = [x for x in rows if x[0] == c], n, set()
            sizes = {s: sum(x[2] == s for x in own) for s in pool}
            for s in sorted(sizes, key=lambda s: (-sizes[s], s)):
                take = min(max(1, round(sizes[s] / len(own) * n)), sizes[s], left) if sizes[s] else 0
                want |= {x[1] for x in sorted((x for x in own if x[2] == s), key=lambda x: x[3])[:take]}
                left -= take
            mine = [g for g in got if g.cluster_id == c]
            assert {g.read_id for g in mine} == want and [g.read_id for g in sorted(mine, key=lambda g: g["rank"])] == [g.read_id for g in sorted(mine, key=lambda g: g.centroid_distance)]


def test_curated_falls_back(spark):
    candidates = spark.createDataFrame([("a", "r1", 1, 1), ("a", "r2", 2, 2), ("b", "r3", 5, 3), ("b", "r4", 4, 4)], "cluster_id string, read_id string, rank int, ord int")
    choice = spark.createDataFrame([("a", 2)], "cluster_id string, chosen int")
    assert sorted(r.read_id for r in choose.curated(candidates, choice).collect()) == ["r2", "r3"]


def test_sweep_prefers_the_real_number():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.2, (20, 3)) for c in (0, 5, 10)])
    found = choose.sweep(x, legacy.linkage(legacy.pair_distance(x)), range(2, 6), ["a"] * 20 + ["b"] * 20 + ["c"] * 20)
    assert max(found, key=lambda f: f["composite"])["k"] == 3


def test_merges_keep_common_reads(spark):
    s = spark.createDataFrame([("x", 0, 10, "ITS"), ("x", 10, 30, "none"), ("y", 0, 30, "none"), ("only", 0, 5, "ITS")], SCHEMA)
    a = spark.createDataFrame([("x", 0, 20, "DJ"), ("x", 20, 30, "q"), ("y", 0, 30, "q")], SCHEMA)
    got = sorted(tuple(r) for r in merges.telomere_acrocentric(s, a).collect())
    assert got == [("x", 0, 10, "DJ_ITS"), ("x", 10, 20, "DJ"), ("x", 20, 30, "q"), ("y", 0, 30, "q")]
    filled = sorted(tuple(r) for r in merges.telomere_satellite(s, a).collect())
    assert filled == [("x", 0, 10, "ITS"), ("x", 10, 20, "DJ"), ("x", 20, 30, "q"), ("y", 0, 30, "q")]


def test_agreement(spark):
    def pairs(a, b):
        f = lambda x: spark.createDataFrame(list(enumerate(x)), "read_id long, cluster_id string")
        return clusters.agreement(clusters.overlap_pairs(f(a), f(b))).first()

    same = pairs("aabbc", "xxyyz")
    assert same.ari == same.nmi == 1.0 and same.level == "HIGH"
    assert pairs("aaaa", "xxxx").ari == 1.0 == pairs("abcd", "wxyz").ari
    r = pairs("aabb", "xyxy")
    assert abs(r.ari + 0.5) < 1e-9 and abs(r.nmi) < 1e-9
