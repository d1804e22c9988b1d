"""Decomposition against numpy, loadings by layer, and linkage against the plain recurrence."""

import numpy as np
import pytest

from tilespan.operators import decompose as D
from tilespan.operators import legacy

SCHEMA = "seq_id string, block string, name string, value double, base double"


def cells(r, n, p, base):
    x = np.where(r.random((n, p)) < 0.3, r.gamma(1.0, 2.0, (n, p)), 0.0) + np.outer(r.random(n) < 0.4, r.gamma(1.0, 3.0, p)) * r.random((n, 1))
    dense = np.where(x != 0, x, base)
    rows = [(f"s{i:03}", "edge" if j % 2 else "abundance", f"l{j:02}:m{j % 3}->q:m{j % 2}" if j % 2 else f"l{j:02}", float(x[i, j]), float(base[j])) for i in range(n) for j in range(p) if x[i, j]]
    return rows, dense


@pytest.mark.parametrize("based", [False, True])
def test_components(spark, based):
    r = np.random.default_rng(3)
    n, p, k = 90, 36, 4
    base = r.normal(0, 0.3, p) * based
    rows, dense = cells(r, n, p, base)
    everyone = spark.createDataFrame([(f"s{i:03}",) for i in range(n)] + [("bare",), ("bare",)], "seq_id string")
    dense = np.vstack((dense, base))  # the row without a cell
    found = D.components(spark.createDataFrame(rows, SCHEMA), k, everyone)
    order = [(("abundance", "edge")[j % 2], f"l{j:02}:m{j % 3}->q:m{j % 2}" if j % 2 else f"l{j:02}") for j in range(p)]
    x = dense[:, [order.index(name) for name in found.names]]
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.linalg.norm(found.loadings - found.loadings @ v[:k].T @ v[:k], 2) < 1e-6 and np.allclose(found.singular, s[:k], rtol=1e-9)
    y = x @ found.loadings.T
    assert np.allclose(found.variance_ratio, y.var(0) / x.var(0).sum(), rtol=1e-6) and (found.loadings[np.arange(k), np.abs(found.loadings).argmax(1)] > 0).all()
    weights = {(q.block, q["name"]): q.importance for q in D.importance(found, spark).collect()}
    assert all(abs(weights[c] - (np.abs(found.loadings[:, j]) * found.variance_ratio).sum()) < 1e-12 for j, c in enumerate(found.names))
    want: dict = {}
    for (block, name), w in weights.items():
        sides = name.split("->") if block == "edge" else [name]
        for layer in (0, 1):
            held = [s.split(":")[layer] for s in sides if len(s.split(":")) > layer]
            for label in held:
                want[layer + 1, label] = want.get((layer + 1, label), 0) + w / len(held)
    got = {(q.layer, q.label): q.importance for q in D.by_layer(D.importance(found, spark)).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_components_of_little(spark, monkeypatch):
    assert D.components(spark.createDataFrame([], SCHEMA), 3).loadings.shape == (0, 0)
    few = D.components(spark.createDataFrame([("a", "b", "x", 3.0, 0.0), ("c", "b", "y", 4.0, 0.0)], SCHEMA), 5)
    assert np.allclose(few.singular, [4, 3]) and few.passes == 1
    monkeypatch.setattr(D, "COLUMNS", 1)
    with pytest.raises(ValueError):
        D.components(spark.createDataFrame([("a", "b", "x", 3.0, 0.0), ("c", "b", "y", 4.0, 0.0)], SCHEMA), 1)


@pytest.mark.parametrize("method", ["ward", "average", "complete", "single"])
def test_chain_linkage(method):
    r = np.random.default_rng(5)
    for n in (2, 3, 17, 60):
        x = r.random((n, 4))
        d = legacy.pair_distance(x)
        plain, chain = legacy.linkage(d, method), D.chain_linkage(d, method)
        assert np.allclose([m[2] for m in plain], [m[2] for m in chain])
        for k in range(1, n + 1, 5):
            assert legacy.cut_tree(plain, n, k).tolist() == legacy.cut_tree(chain, n, k).tolist()


def test_dendrogram(spark, monkeypatch):
    rows = [(c, name, v) for c, own in {"a": {"x": 1.0}, "b": {"x": 1.1}, "c": {"y": 5.0}, "d": {"y": 5.3, "x": 0.1}}.items() for name, v in own.items()]
    df = spark.createDataFrame(rows, "cluster_id string, name string, value double")
    merges, order = (x.collect() for x in D.dendrogram(df, scale=False))
    assert [(m.left_node, m.right_node, m["size"]) for m in merges] == [(0, 1, 2), (2, 3, 2), (4, 5, 4)] and [o.cluster_id for o in sorted(order)] == ["a", "b", "c", "d"]
    assert abs(merges[0].height - 0.1) < 1e-9
    members = spark.createDataFrame([("g", "r1"), ("g", "r2"), ("h", "r3")], "cluster_id string, seq_id string")
    got = D.mean_profiles(spark.createDataFrame([("r1", "e", 3), ("r3", "e", 2), ("r3", "f", 4)], "seq_id string, name string, n long"), members)
    assert {(x.cluster_id, x["name"]): x.value for x in got.collect()} == {("g", "e"): 1.5, ("h", "e"): 2.0, ("h", "f"): 4.0}
    assert D.dendrogram(df.where("cluster_id = 'a'"))[0].count() == 0 and D.dendrogram(df.limit(0))[1].count() == 0
    monkeypatch.setattr(D, "LEAVES", 3)
    with pytest.raises(ValueError):
        D.dendrogram(df)
