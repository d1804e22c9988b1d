"""Cluster profiles against plain Python."""

import math
import random
from statistics import median

import numpy as np

from tilespan.operators import profiles as P


def test_quantiles_with_counted_zeros(spark):
    r = random.Random(1)
    rows, sizes = [], []
    for g in range(25):
        own = [r.choice([0.0, -1.5, -0.25, 0.5, 2.0, 2.0, 7.25]) for _ in range(r.randint(0, 9))]
        rows += [(f"g{g}", v, "x") for v in own] + [(f"g{g}", None, "x")]
        sizes.append((f"g{g}", len(own) + r.randint(0, 6), own))
    df = spark.createDataFrame(rows, "g string, v double, n string")
    asked = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(x.g, x.fraction): x["quantile"] for x in P.quantiles(df, ["g"], "v", asked, spark.createDataFrame([s[:2] for s in sizes], "g string, n long")).collect()}
    want = {(g, f): float(np.quantile(own + [0.0] * (n - len(own)), f)) for g, n, own in sizes if n for f in asked}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plain = {(x.g, x.fraction): x["quantile"] for x in P.quantiles(df, ["g"], "v", asked).collect()}
    want = {(g, f): float(np.quantile(own, f)) for g, _, own in sizes if own for f in asked}
    assert plain.keys() == want.keys() and all(abs(plain[k] - want[k]) < 1e-9 for k in want)
    assert P.quantiles(df.where("false"), ["g"], "v", [0.5]).count() == 0


def test_profile_rounds_by_metric(spark):
    values = [("r1", "t__dmax__a", 0.12345), ("r2", "t__dmax__a", 0.5), ("r1", "t__max_block_bp__a", 11.0), ("r2", "t__max_block_bp__a", 4.0), ("r1", "interspersion__total", 1.125), ("r1", "t__dmin__b", 0.9), ("away", "t__dmax__a", 1.0)]
    members = [("c", f"r{k}") for k in range(1, 4)] + [("d", "r1"), ("e", "r9")]
    got = {(x.cluster_id, x.name): x.value for x in P.profile(spark.createDataFrame(values, "seq_id string, name string, value double"), spark.createDataFrame(members, "cluster_id string, seq_id string")).collect()}
    assert got == {("c", "t__dmax__a"): 12.34, ("c", "t__max_block_bp__a"): 4.0, ("c", "interspersion__total"): 0.0, ("c", "t__dmin__b"): 0.0, ("d", "t__dmax__a"): 12.34, ("d", "t__max_block_bp__a"): 11.0, ("d", "interspersion__total"): 1.12, ("d", "t__dmin__b"): 90.0}


CASES = {
    "both": ({"dfirst__canonical_telomere": 70, "dlast__noncanonical_telomere": 10, "dmax__p_arm": 90}, "ECTR", "both ends"),
    "one end alone": ({"dterminal__canonical_telomere": 15}, "ECTR", "no arm"),
    "alone, variant": ({"dterminal__noncanonical_telomere": 5, "dmax__noncanonical_telomere": 25.01}, "ECTR (variant-enriched)", "no arm"),
    "long": ({"dterminal__canonical_telomere": 15, "dmax__q_arm": 30, "max_block_bp__canonical_telomere": 6000}, "Type II ALT subtelomere", "long block"),
    "end": ({"dterminal__canonical_telomere": 15, "bppct__ct": 20, "dmax__TAR1": 35, "dmax__ITS": 35}, "Subtelomere (TAR1/ITS-, SegDup-enriched)", "one end"),
    "end by dmax": ({"dterminal__canonical_telomere": 15, "dmax__ct": 35, "dmax__TAR1": 40}, "Subtelomere (TAR1-, SegDup-enriched)", "one end"),
    "inside": ({"dmax__canonical_telomere": 35, "dmax__ITS": 36, "acro": 50}, "Interstitial telomere (ITS-, rDNA-enriched)", "inside"),
    "inside, variant": ({"dmax__noncanonical_telomere": 35}, "Interstitial telomere (variant-enriched)", "inside"),
    "its": ({"dmax__ITS": 35, "dmax__TAR1": 34}, "Interstitial ITS", "junction"),
    "tar1": ({"dmax__TAR1": 35, "dmax__active": 60, "dmax__mon": 60, "dmax__ct": 90}, "Interstitial TAR1 (active aSat-enriched)", "junction"),
    "both inside": ({"dmax__TAR1": 36, "dmax__ITS": 35, "bppct__ct": 20, "acro": 35}, "Interstitial ITS/TAR1 (rDNA-, SegDup-enriched)", "junction"),
    "satellite": ({"readpct__HSat2": 80, "dmax__HSat3": 99}, "HSat2", "satellite"),
    "satellite of the older names": ({"readpct__monomeric": 81, "readpct__hor": 80}, "monomeric aSat", "satellite"),
    "none": ({"readpct__HSat2": 79, "dmax__canonical_telomere": 34}, "", "none"),
}


def test_every_leaf(spark):
    rows = [(c, "acrocentric__dmax__rDNA" if k == "acro" else f"tr__{k}", float(v)) for c, (metrics, _, _) in CASES.items() for k, v in metrics.items()]
    got = {x.cluster_id: (x.label, x.rule) for x in P.tree_labels(spark.createDataFrame(rows, "cluster_id string, name string, value double"), "tr").collect()}
    assert got == {c: want for c, (_, *rest) in CASES.items() for want in [tuple(rest)]}
    assert {rule for _, rule in got.values()} == {"both ends", "no arm", "long block", "one end", "inside", "junction", "satellite", "none"}


def plain_score(read, cluster, label):
    def near(r, c):
        return max(0.0, 1 - abs(r - c) / max(abs(c), 1e-6))

    def mean(x):
        return sum(x) / len(x) if x else 0.5

    shows = {f for (m, f), v in read.items() if v and m in (*P.PER_CENT, *P.BASES)}
    share = lambda m, f: cluster.get((m, f), 0) / 100
    terms = {
        "terminal": mean([near(read.get((m, f), 0), share(m, f)) for f in ("canonical_telomere", "noncanonical_telomere") for m in ("dfirst", "dlast", "dterminal")]),
        "dmax": mean([near(read.get(("dmax", f), 0), share("dmax", f)) for f in shows if share("dmax", f) > 0.05]),
        "block": mean([near(read.get(("max_block_bp", f), 0), cluster[("max_block_bp", f)]) for f in shows if cluster.get(("max_block_bp", f), 0) > 100]),
        "interspersion": mean([near(read.get(("interspersion", n), 0), cluster.get(("interspersion", n), 0)) for n in ("total", "can_ncan", "tel_sat", "arm_tel")]),
        "bppct": mean([near(read.get(("dmedian", f), 0), share("bppct", f)) for f in shows if share("bppct", f) > 0.01]),
        "enrichment": mean([near(read.get(("dmax", f), 0), share("dmax", f)) for f in {x for n in P.SATELLITES.values() for x in n} | {"ITS", "TAR1"} if share("dmax", f) > 0.2]),
    }
    kind = "ectr" if label.startswith("ECTR") else "satellite" if any(x in label for x in ("aSat", "bSat", "CenSat", "HSat", "GSat")) else ""
    return sum(w * terms[t] for t, w in P.WEIGHTS[kind].items())


def test_read_scores(spark):
    r = random.Random(6)
    labels = {"c1": "ECTR (bSat-enriched)", "c2": "HSat2", "c3": "", "c4": "Subtelomere"}
    features = ["canonical_telomere", "noncanonical_telomere", "ITS", "HSat2", "p_arm", "mon"]

    def metrics(scale, block, extra):
        out = {}
        for f in features:
            for m in (*P.PER_CENT, *extra):
                if r.random() < 0.5:
                    out[m, f] = round(r.random() * scale, 3)
            if r.random() < 0.5:
                out["max_block_bp", f] = float(r.randint(0, block))
        return out | {("interspersion", n): round(r.random() * 5, 2) for n in ("total", "can_ncan", "tel_sat") if r.random() < 0.7}

    clusters = {c: metrics(100, 3000, ("bppct",)) for c in labels}
    reads = {f"r{k}": metrics(1, 3000, ()) if k % 9 else {} for k in range(40)}
    name = lambda m, f: f"interspersion__{f}" if m == "interspersion" else f"tr__{m}__{f}"
    members = [(r.choice(list(labels)), s) for s in reads]
    got = P.read_scores(
        spark.createDataFrame([(s, name(m, f), v) for s, own in reads.items() for (m, f), v in own.items()], "seq_id string, name string, value double"), spark.createDataFrame(members, "cluster_id string, seq_id string"),
        spark.createDataFrame([(c, name(m, f), v) for c, own in clusters.items() for (m, f), v in own.items()], "cluster_id string, name string, value double"), spark.createDataFrame(list(labels.items()), "cluster_id string, label string"), "tr",
    ).collect()
    assert len(got) == len(reads)
    for x in got:
        assert abs(x.score - plain_score(reads[x.seq_id], clusters[x.cluster_id], labels[x.cluster_id])) < 1e-4


def plain_passes(rows, n):
    spans = [s for _, _, s, _ in rows if s is not None]

    def ranked(own, target):
        def key(x):
            _, read, span, score = x
            near = max(0.0, 1 - abs(math.log2(span / target)) / 3) if span and span > 0 and target > 0 else 0.0
            return (-round(math.sqrt(score * near), 12) if score and score > 0 else 0.0, abs((span or 0) - target), read)

        return sorted(own, key=key)

    groups: dict = {}
    for x in rows:
        groups.setdefault(x[0], []).append(x)
    pools = {c: ranked(own, median(spans))[: max(20, 5 * n)] for c, own in groups.items()}
    longest = max([x[2] for own in pools.values() for x in own[:n] if x[2] and x[2] > 0], default=median(spans))
    return sorted((c, x[1], k + 1) for c, own in pools.items() for k, x in enumerate(ranked(own, longest)[:n]))


def test_two_passes(spark):
    r = random.Random(8)
    for n in (1, 3, 6):
        rows = [(r.choice("aaab"), f"r{k}", r.choice([None, 0, 900, 1000, r.randint(1, 5000)]), r.choice([None, 0.0, 0.5, round(r.random(), 3)])) for k in range(120)] + [("c", "only", 10, 0.2)]
        got = P.two_passes(spark.createDataFrame(rows, "cluster_id string, read_id string, span long, score double"), n)
        assert sorted((x.cluster_id, x.read_id, x["rank"]) for x in got.collect()) == plain_passes(rows, n)


def test_statistics(spark):
    rows = [("a", v, 0.004) for v in (4.0, 1.0, 3.0, None, 2.0)] + [("b", 7.0, 0.2)]
    got = {x.g: x for x in P.statistics(spark.createDataFrame(rows, "g string, v double, p double"), ["g"], "v", "p").collect()}
    assert (got["a"].n, got["a"]["mean"], got["a"].q1, got["a"].median, got["a"].q3, got["a"].iqr, got["a"].stars) == (4, 2.5, 1.75, 2.5, 3.25, 1.5, "**")
    assert got["b"].stars == "ns" and got["b"].q1 == got["b"].q3 == 7.0
