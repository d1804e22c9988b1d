"""Decomposition of a long sparse matrix by a distributed range finder, what its loadings say by label layer, and dendrograms of mean profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, spread

#: Columns of a matrix that may be decomposed, directions beyond those asked for, passes at most, and the turn of the subspace that ends them; leaves of a dendrogram.
COLUMNS, BEYOND, PASSES, STILL, LEAVES = 20_000, 10, 60, 1e-9, 5_000


@dataclass
class Components:
    """names (block, name) of the columns; loadings, a row a component with its largest entry positive; singular values; share of the columns' variance."""

    names: list[tuple[str, str]]
    loadings: np.ndarray
    singular: np.ndarray
    variance_ratio: np.ndarray
    passes: int


def components(cells: DataFrame, k: int, rows: DataFrame | None = None, seed: int = 7) -> Components:
    """The k leading singular directions (uncentred) of the matrix that cells (seq_id, block, name, value, base) describe; absent cells are base.

    rows (seq_id) are all rows of the matrix, those without a cell too; without it those of cells. No dense matrix exists anywhere: a
    pass sends each task a table of columns by directions, and gets back what its rows make of it (values less base as sparse rows, base as one
    vector for all). The driver holds such tables alone, bounded by COLUMNS and PASSES: each pass adds what it found beyond the directions before
    it to a basis, in which the leading subspace is sought until it stands still; more than PASSES are an error.
    """
    spark = cells.sparkSession
    columns = cells.groupBy("block", "name").agg(F.max("base").alias("base")).orderBy("block", "name").limit(COLUMNS + 1).collect()
    if len(columns) > COLUMNS:
        raise ValueError(f"the matrix has more than {COLUMNS} columns")
    p = len(columns)
    names, base = [(c.block, c["name"]) for c in columns], np.array([c.base for c in columns], float)
    n = (cells.select("seq_id") if rows is None else rows.select("seq_id")).distinct().count()
    if not p or not n:
        return Components(names, np.zeros((0, p)), np.zeros(0), np.zeros(0), 0)
    place = spark.createDataFrame([(b, x, j) for j, (b, x) in enumerate(names)], "block string, name string, _j int")
    sparse = cells.join(F.broadcast(place), ["block", "name"]).groupBy("seq_id").agg(F.collect_list(F.struct("_j", (F.col("value") - F.col("base")).alias("v"))).alias("x"))
    sparse = cut(spread(sparse.select("seq_id", F.transform("x", lambda c: c["_j"]).alias("j"), F.transform("x", lambda c: c["v"]).alias("v")), "seq_id"))

    def applied(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The Gram matrix times q, and the sums of all rows times q."""
        shift, width, shared = base @ q, q.shape[1], spark.sparkContext.broadcast(q)

        def run(parts):
            table, total, seen = np.zeros((p, width)), np.zeros(width), 0
            for batch in parts:
                j, v = batch.column(0), batch.column(1)
                row = np.repeat(np.arange(len(j)), pa.compute.list_value_length(j).to_numpy(zero_copy_only=False))
                j, v = j.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
                y = np.tile(shift, (len(batch), 1))
                np.add.at(y, row, v[:, None] * shared.value[j])
                np.add.at(table, j, v[:, None] * y[row])
                total += y.sum(0)
                seen += len(batch)
            out = np.vstack((table, total))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p + 1)), pa.array(list(out), pa.list_(pa.float64())), pa.array(np.full(p + 1, seen))], names=["j", "y", "n"])

        made = sparse.select("j", "v").mapInArrow(run, "j long, y array<double>, n long")
        one = made.select("j", "n", F.posexplode("y").alias("c", "y")).groupBy("j", "c").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).toArrow()
        found = np.zeros((p + 1, width))
        found[one.column("j").to_numpy(), one.column("c").to_numpy()] = one.column("y").to_numpy()
        empty = n - (int(one.column("n")[0].as_py()) if len(one) else 0)  # rows without a cell are base alone
        total = found[p] + empty * shift
        shared.destroy()
        return found[:p] + np.outer(base, total), total

    blocks = [np.linalg.qr(np.random.default_rng(seed).standard_normal((p, min(p, k + BEYOND))))[0]]
    images, totals, lead = [], [], None
    while True:
        z, sums = applied(blocks[-1])
        images.append(z)
        totals.append(sums)
        basis = np.hstack(blocks)
        small = basis.T @ np.hstack(images)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(-values)[: min(k, p)]
        now = basis @ turn[:, top]
        if basis.shape[1] >= p or (lead is not None and np.linalg.norm(now - lead @ (lead.T @ now), 2) < STILL):
            break
        for _ in range(2):
            z = z - basis @ (basis.T @ z)
        new, size, _ = np.linalg.svd(z, full_matrices=False)
        new = new[:, size > 1e-12 * max(np.abs(values).max(), 1e-300)]
        if not new.shape[1]:
            break  # the basis holds all that the matrix reaches
        if len(blocks) >= PASSES:
            raise ValueError(f"the subspace still turns after {PASSES} passes")
        blocks.append(np.linalg.qr(new - basis @ (basis.T @ new))[0])
        lead = now
    sums, passes = np.concatenate(totals), len(blocks)
    sign = np.sign(now[np.abs(now).argmax(0), np.arange(now.shape[1])])
    squares, first = cells.groupBy("block", "name").agg(F.sum(F.col("value") * F.col("value")).alias("q"), F.sum("value").alias("s"), F.count("*").alias("c")).collect(), dict(zip(names, base, strict=True))
    spread_ = sum((r.q + (n - r.c) * first[r.block, r["name"]] ** 2) / n - ((r.s + (n - r.c) * first[r.block, r["name"]]) / n) ** 2 for r in squares)
    own = np.maximum(values[top], 0)
    variance = own / n - ((sums @ turn[:, top]) / n) ** 2
    return Components(names, (now * sign).T, np.sqrt(own), np.maximum(variance, 0) / spread_ if spread_ > 0 else np.zeros(len(top)), passes)


def importance(found: Components, spark) -> DataFrame:
    """block, name, importance: each column's absolute loadings, weighted by the components' shares of variance."""
    weight = (np.abs(found.loadings) * found.variance_ratio[:, None]).sum(0)
    return spark.createDataFrame([(b, x, float(w)) for (b, x), w in zip(found.names, weight, strict=True)], "block string, name string, importance double")


def by_layer(weights: DataFrame) -> DataFrame:
    """layer (1 or 2), label, importance: what importance() gives labels of each layer. An edge's weight goes in equal parts to the labels that its two sides have in a layer."""
    sides = weights.withColumn("_s", F.when(F.col("block") == "edge", F.split("name", "->")).otherwise(F.array("name")))

    def one(layer):
        held = F.array_compact(F.transform("_s", lambda s: F.get(F.split(s, ":"), F.lit(layer - 1))))
        own = sides.withColumn("_l", held).where("size(_l) > 0").select(F.explode("_l").alias("label"), (F.col("importance") / F.size("_l")).alias("w"))
        return own.groupBy("label").agg(F.sum("w").alias("importance")).select(F.lit(layer).alias("layer"), "label", "importance")

    return one(1).union(one(2))


def chain_linkage(distance: np.ndarray, method: str = "ward") -> list[tuple[int, int, float, int]]:
    """Merges (i, j, height, size) by the nearest-neighbour chain, in the order of their heights; new clusters are numbered from n. ward, average,
    complete or single: under these a pair of mutual nearest neighbours stays one whatever else merges, so pairs may be merged as the chain finds them."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, made, chain, left = np.ones(n), [], [], np.ones(n, bool)
    while len(made) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(left)[0])]
        here = chain[-1]
        row = d[here]
        near = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[near]:
            near = chain[-2]
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        a, b = chain.pop(), chain.pop()
        height, na, nb = d[a, b], size[a], size[b]
        made.append((float(height), min(a, b), max(a, b)))
        rest = left.copy()
        rest[[a, b]] = False
        da, db, nk = d[a, rest], d[b, rest], size[rest]
        if method == "ward":
            new = np.sqrt(np.maximum(0.0, ((na + nk) * da**2 + (nb + nk) * db**2 - nk * height**2) / (na + nb + nk)))
        else:
            new = (na * da + nb * db) / (na + nb) if method == "average" else np.maximum(da, db) if method == "complete" else np.minimum(da, db)
        keep, gone = max(a, b), min(a, b)
        d[keep, rest] = d[rest, keep] = new
        d[gone], d[:, gone] = np.inf, np.inf
        left[gone], size[keep] = False, na + nb
    number, members, out = {k: k for k in range(n)}, {k: 1 for k in range(n)}, []
    up = list(range(n))

    def head(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for step, (height, a, b) in enumerate(sorted(made, key=lambda m: m[0])):  # stable: a merge never stands before one that made its parts
        x, y = head(a), head(b)
        i, j, together = *sorted((number[x], number[y])), members[x] + members[y]
        out.append((i, j, height, together))
        up[x] = y
        number[y], members[y] = n + step, together
    return out


def mean_profiles(cells: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, name, value: the mean over all of a cluster's members (cluster_id, seq_id) of cells (seq_id, name, n); absent ones count 0."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    return cells.join(members, "seq_id").groupBy("cluster_id", "name").agg(F.sum("n").alias("_s")).join(sizes, "cluster_id").select("cluster_id", "name", (F.col("_s") / F.col("_n")).alias("value"))


def dendrogram(profiles: DataFrame, method: str = "average", scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """merges (step, left_node, right_node, height, size; leaves are 0 to n - 1 by cluster_id) and order (place, leaf, cluster_id) of mean profiles
    (cluster_id, name, value). scale: columns by mean and deviation over the clusters. More than LEAVES clusters or COLUMNS names are an error."""
    spark = profiles.sparkSession
    for column, most in (("cluster_id", LEAVES), ("name", COLUMNS)):
        if profiles.select(column).distinct().limit(most + 1).count() > most:
            raise ValueError(f"more than {most} values of {column}")
    rows = profiles.toPandas()  # bounded by the two counts
    ids, names = sorted(rows["cluster_id"].unique()), sorted(rows["name"].unique())
    x = np.zeros((len(ids), len(names)))
    x[np.searchsorted(ids, rows["cluster_id"]), np.searchsorted(names, rows["name"])] = rows["value"]
    if scale and len(x):
        dev = x.std(0)
        x = (x - x.mean(0)) / np.where(dev > 1e-12, dev, 1.0)
    distance = np.sqrt(np.maximum(0.0, ((x[:, None] - x) ** 2).sum(2))) if len(x) < 512 else np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))
    merges = chain_linkage(distance, method) if len(ids) > 1 else []
    below: dict[int, list[int]] = {k: [k] for k in range(len(ids))}
    for step, (i, j, _, _) in enumerate(merges):
        below[len(ids) + step] = below.pop(i) + below.pop(j)
    leaves: Sequence[int] = [leaf for own in below.values() for leaf in own]
    made = spark.createDataFrame([(k, i, j, h, s) for k, (i, j, h, s) in enumerate(merges)], "step int, left_node int, right_node int, height double, size int")
    return made, spark.createDataFrame([(k, leaf, str(ids[leaf])) for k, leaf in enumerate(leaves)], "place int, leaf int, cluster_id string")
