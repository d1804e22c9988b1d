"""The older operators: label bigram matrices, hierarchical clustering and its quality, exact and rank tests, structure strings, label filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .storage import cut, spread

# label bigrams and matrices


def bigrams(rows: DataFrame, symmetric: bool = False) -> DataFrame:
    """seq_id, edge (a->b), n, weight: neighbouring labels that differ; weight sums the first one's length, or for symmetric edges the mean of both."""
    w = Window.partitionBy("seq_id").orderBy("start", "end")
    x = rows.withColumn("len", F.col("end") - F.col("start")).withColumn("g", F.lead("feature").over(w)).withColumn("glen", F.lead("len").over(w)).where("g is not null and g <> feature")
    a, b = (F.least("feature", "g"), F.greatest("feature", "g")) if symmetric else (F.col("feature"), F.col("g"))
    weight = (F.col("len") + F.col("glen")) / 2 if symmetric else F.col("len").cast("double")
    return x.groupBy("seq_id", F.concat(a, F.lit("->"), b).alias("edge")).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))


def long_matrix(rows: DataFrame, kind: str = "count_log1p_zscore", symmetric: bool = False, abundance: bool = True, edges: bool = True) -> DataFrame:
    """seq_id, block (edge or abundance), name, value, of kinds binary, count, count_log1p, count_log1p_zscore, count_log1p_zscore_blockweight and length_weighted.

    Absent cells are those of value 0; for z-scores (population deviation) their value is base, a column of its own, so that the
    matrix stays sparse. The label vocabulary is a few hundred at most.
    """
    lengths = rows.groupBy("seq_id").agg((F.max("end") - F.min("start")).alias("span"))
    parts = []
    if edges:
        parts.append(bigrams(rows, symmetric).select("seq_id", F.lit("edge").alias("block"), F.col("edge").alias("name"), F.col("n").cast("double").alias("n"), "weight"))
    if abundance:
        bp = rows.groupBy("seq_id", "feature").agg(F.sum(F.col("end") - F.col("start")).cast("double").alias("n"))
        parts.append(bp.select("seq_id", F.lit("abundance").alias("block"), F.col("feature").alias("name"), "n", F.col("n").alias("weight")))
    cells = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    if kind == "binary":
        return cells.select("seq_id", "block", "name", F.lit(1.0).alias("value"), F.lit(0.0).alias("base"))
    if kind == "length_weighted":
        return cells.join(lengths, "seq_id").select("seq_id", "block", "name", (F.col("weight") / F.col("span")).alias("value"), F.lit(0.0).alias("base"))
    if kind == "count":
        return cells.select("seq_id", "block", "name", F.col("n").alias("value"), F.lit(0.0).alias("base"))
    logged = cells.withColumn("value", F.log1p("n"))
    if kind == "count_log1p":
        return logged.select("seq_id", "block", "name", "value", F.lit(0.0).alias("base"))
    total = lengths.agg(F.count("*").alias("rows"))
    stats = logged.groupBy("block", "name").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(F.broadcast(total))
    mean = F.col("s") / F.col("rows")
    stats = stats.select("block", "name", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("rows") - mean * mean)).alias("dev"))
    scaled = logged.join(stats, ["block", "name"])
    z = lambda v: F.when(F.col("dev") > 1e-12, (v - F.col("mean")) / F.col("dev")).otherwise(0.0)
    weight = F.lit(1.0)
    if kind.endswith("blockweight") and edges and abundance:
        labels = rows.select("feature").distinct().count()
        weight = F.when(F.col("block") == "abundance", math.sqrt((labels * (labels - 1) / (2 if symmetric else 1)) / max(labels, 1))).otherwise(1.0)
    return scaled.select("seq_id", "block", "name", (z(F.col("value")) * weight).alias("value"), (z(F.lit(0.0)) * weight).alias("base"))


def svd(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest singular triples (uncentred) of a bounded matrix, with each component's largest loading positive."""
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    u, s, v = u[:, :k], s[:k], v[:k]
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    return u * sign * s, s, v * sign[:, None]


def loading_importance(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Each column's squared loadings weighted by the components' shares of variance."""
    share = s**2 / max((s**2).sum(), 1e-300)
    return (v**2 * share[:, None]).sum(0)


# hierarchical clustering of a bounded matrix (representatives, clusters, structures of one chromosome)


def linkage(distance: np.ndarray, method: str = "ward") -> list[tuple[int, int, float, int]]:
    """Merges (i, j, height, size) of a distance matrix by the recurrence of Lance and Williams; ward, average, complete or single. New clusters are numbered from n."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        i, j = min(i, j), max(i, j)
        height, ni, nj = d[i, j], size[i], size[j]
        out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), float(height), int(ni + nj)))
        rest = alive.copy()
        rest[[i, j]] = False
        a, b, nk = d[i, rest], d[j, rest], size[rest]
        if method == "ward":
            new = np.sqrt(np.maximum(0, ((ni + nk) * a**2 + (nj + nk) * b**2 - nk * height**2) / (ni + nj + nk)))
        elif method == "average":
            new = (ni * a + nj * b) / (ni + nj)
        else:
            new = np.maximum(a, b) if method == "complete" else np.minimum(a, b)
        d[i, rest] = d[rest, i] = new
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        ids[i], size[i] = n + step, ni + nj
    return out


def cut_tree(merges: list, n: int, k: int) -> np.ndarray:
    """Labels 1..k of the n leaves, clusters numbered by their first leaf."""
    group = {i: [i] for i in range(n)}
    for step, (i, j, _, _) in enumerate(merges[: n - k]):
        group[n + step] = group.pop(i) + group.pop(j)
    out = np.zeros(n, int)
    for number, members in enumerate(sorted(group.values(), key=min), 1):
        out[members] = number
    return out


def leaf_order(merges: list, n: int) -> list[int]:
    order = {i: [i] for i in range(n)}
    for step, (i, j, _, _) in enumerate(merges):
        order[n + step] = order.pop(i) + order.pop(j)
    return [x for members in order.values() for x in members]


def pair_distance(x: np.ndarray, cosine: bool = False) -> np.ndarray:
    if cosine:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.clip(1 - x @ x.T, 0, 2)
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))


def quality(x: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """silhouette, cosine_silhouette, calinski_harabasz, davies_bouldin of a labelling of a bounded matrix."""
    names = np.unique(labels)
    out = {}
    for key, cosine in (("silhouette", False), ("cosine_silhouette", True)):
        d = pair_distance(x, cosine)
        mean = np.stack([d[:, labels == g].sum(1) / np.maximum((labels == g).sum() - (labels == g), 1) for g in names], 1)
        own = np.searchsorted(names, labels)
        a = mean[np.arange(len(x)), own]
        other = mean.copy()
        other[np.arange(len(x)), own] = np.inf
        b = other.min(1)
        alone = np.array([(labels == g).sum() == 1 for g in labels])
        out[key] = float(np.where(alone, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean()) if len(names) > 1 else 0.0
    centre = np.stack([x[labels == g].mean(0) for g in names])
    within = sum(((x[labels == g] - c) ** 2).sum() for g, c in zip(names, centre, strict=True))
    between = sum((labels == g).sum() * ((c - x.mean(0)) ** 2).sum() for g, c in zip(names, centre, strict=True))
    n, k = len(x), len(names)
    out["calinski_harabasz"] = float(between / max(within, 1e-300) * (n - k) / (k - 1)) if 1 < k < n else 0.0
    spread = np.array([np.linalg.norm(x[labels == g] - c, axis=1).mean() for g, c in zip(names, centre, strict=True)])
    gap = pair_distance(centre)
    np.fill_diagonal(gap, np.inf)
    out["davies_bouldin"] = float(((spread[:, None] + spread) / gap).max(1).mean()) if k > 1 else 0.0
    return out


def knee(values: Sequence[float]) -> int:
    """Where a rising curve bends most: farthest above the chord after scaling both axes to 0..1."""
    y = np.asarray(values, float)
    if len(y) < 3 or y.max() == y.min():
        return 0
    return int(np.argmax((y - y.min()) / (y.max() - y.min()) - np.linspace(0, 1, len(y))))


# exact tests


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_p(a: int, b: int, c: int, d: int, greater: bool = False) -> float:
    """Fisher's exact p of the table [[a, b], [c, d]], two-sided (tables no likelier than this one) or for a larger a."""
    return float(fisher_ps(np.array([[a, b, c, d]]), greater)[0])


def fisher_ps(tables: np.ndarray, greater: bool = False) -> np.ndarray:
    """fisher_p of every row. Log factorials are summed once up to the largest total."""
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, max(1, int(tables.sum(1).max(initial=0))) + 1)))))
    out = np.empty(len(tables))
    for i, (a, b, c, d) in enumerate(tables.tolist()):
        row, column, total = a + b, a + c, a + b + c + d
        low, high = max(0, row + column - total), min(row, column)
        k = np.arange(low, high + 1)
        each = logs[column] - logs[k] - logs[column - k] + logs[total - column] - logs[row - k] - logs[total - column - row + k] - (logs[total] - logs[row] - logs[total - row])
        out[i] = min(1.0, np.exp(each[k >= a if greater else each <= each[a - low] + 1e-7]).sum())
    return out


def fisher_udf(greater: bool = False):
    @F.pandas_udf(DoubleType())
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        kinds, which = np.unique(np.stack([a, b, c, d], 1).astype(np.int64), axis=0, return_inverse=True)
        return pd.Series(fisher_ps(kinds, greater)[which.ravel()])

    return test


def fisher_two_group(members: DataFrame, control: str) -> DataFrame:
    """cluster_id, control_in, treatment_in, odds_ratio, p_value, enrichment of members (cluster_id, group): control against the other
    group. Of more than two groups the other is the commonest one of that cluster (the least name on ties; control itself if it has none)."""
    counts = members.groupBy("cluster_id", "group").agg(F.count("*").alias("n"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("t"))
    known = totals.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.when(F.col("group") == control, F.col("t"))), F.lit(0)).alias("control_total"), F.min(F.when(F.col("group") != control, F.col("group"))).alias("only"))
    first = Window.partitionBy("cluster_id").orderBy((F.col("group") == control).cast("int"), F.desc("n"), "group")
    inside = counts.groupBy("cluster_id").agg(F.coalesce(F.sum(F.when(F.col("group") == control, F.col("n"))), F.lit(0)).alias("a"))
    common = counts.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("cluster_id", F.col("group").alias("common"))
    x = inside.join(common, "cluster_id").join(F.broadcast(known)).withColumn("group", F.when((F.col("groups") == 2) & F.col("only").isNotNull(), F.col("only")).otherwise(F.col("common")))
    x = x.join(counts.withColumnRenamed("n", "b"), ["cluster_id", "group"], "left").na.fill(0, ["b"]).join(totals, "group")
    x = x.withColumn("c", F.col("control_total") - F.col("a")).withColumn("d", F.col("t") - F.col("b"))
    odds = F.when(F.col("b") * F.col("c") > 0, F.try_divide((F.col("a") * F.col("d")).cast("double"), (F.col("b") * F.col("c")).cast("double"))).when(F.col("a") * F.col("d") > 0, float("inf")).otherwise(float("nan"))
    alone = F.col("groups") < 2
    x = x.withColumn("odds_ratio", F.when(alone, float("nan")).otherwise(odds)).withColumn("p_value", F.when(alone, 1.0).otherwise(fisher_udf()("a", "b", "c", "d")))
    label = F.when(F.col("p_value") >= 0.05, "mixed").when(F.col("odds_ratio") > 1, f"{control}-enriched").when(F.col("odds_ratio") < 1, F.concat("group", F.lit("-enriched"))).otherwise("mixed")
    return x.select("cluster_id", F.col("a").alias("control_in"), F.col("b").alias("treatment_in"), "odds_ratio", "p_value", label.alias("enrichment"), F.col("group").alias("treatment"))


def fisher_per_sample(members: DataFrame, scale: bool = False) -> DataFrame:
    """cluster_id, sample, n, p_value: whether the cluster holds more of a sample than chance, for every cluster and sample. scale divides counts by the sample's size over the median size (half-even rounding)."""
    counts = members.groupBy("cluster_id", "sample").agg(F.count("*").alias("n"))
    totals = counts.groupBy("sample").agg(F.sum("n").alias("t"))
    if scale:
        middle = totals.agg(F.percentile("t", F.lit(0.5)).alias("m"))
        totals = totals.join(F.broadcast(middle)).withColumn("f", F.col("t") / F.col("m"))
    else:
        totals = totals.withColumn("f", F.lit(1.0))
    grid = counts.select("cluster_id").distinct().join(F.broadcast(totals)).join(counts, ["cluster_id", "sample"], "left").na.fill(0, ["n"])
    x = grid.withColumn("a", F.bround(F.col("n") / F.col("f")).cast("long")).withColumn("st", F.bround(F.col("t") / F.col("f")).cast("long"))
    inside, all_ = F.sum("a").over(Window.partitionBy("cluster_id")), F.sum("st").over(Window.partitionBy("cluster_id"))
    x = x.withColumn("b", inside - F.col("a")).withColumn("c", F.greatest(F.lit(0), F.col("st") - F.col("a"))).withColumn("d", F.greatest(F.lit(0), all_ - F.col("st") - (inside - F.col("a"))))
    return x.select("cluster_id", "sample", "n", fisher_udf(True)("a", "b", "c", "d").alias("p_value"))


def odds_check(inside: Column, total: Column, other_inside: Column, other_total: Column, cutoff: float = 1.5) -> Column:
    """The quick enrichment test: odds ratio with half a count added, over the cutoff or under its inverse."""
    odds = ((inside + 0.5) * (other_total - other_inside + 0.5)) / ((total - inside + 0.5) * (other_inside + 0.5))
    return F.when(odds >= cutoff, "enriched").when(odds <= 1 / cutoff, "depleted").otherwise("mixed")


# rank tests


def mid_ranks(rows: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """Distinct values with n and mid-rank. Values are dealt to ranges by approximate quantiles and ranked there after the ranges before, so no task holds them all."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    splits = sorted(set(counts.approxQuantile("value", [k / parts for k in range(1, parts)], 0.005)))
    bucket = F.size(F.filter(F.array(*[F.lit(float(s)) for s in splits]), lambda s: s < F.col("value"))) if splits else F.lit(0)
    dealt = counts.withColumn("bucket", bucket)
    before = dealt.groupBy("bucket").agg(F.sum("n").alias("t")).withColumn("before", F.sum("t").over(Window.orderBy("bucket")) - F.col("t")).drop("t")
    within = F.sum("n").over(Window.partitionBy("bucket").orderBy("value"))
    return dealt.withColumn("upto", within).join(F.broadcast(before), "bucket").select("value", "n", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def kruskal(rows: DataFrame, value: str, group: str) -> DataFrame:
    """One row: n, k, h (corrected for ties)."""
    ranks = mid_ranks(rows, value)
    x = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("value")).groupBy("g", "value").agg(F.count("*").alias("m")).join(ranks, "value")
    sums = x.groupBy("g").agg(F.sum(F.col("m") * F.col("rank")).alias("r"), F.sum("m").alias("m")).agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.count("*").alias("k"))
    ties = ranks.agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("t"), F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return sums.join(F.broadcast(ties)).select("n", "k", h.alias("h"))


def mann_whitney(rows: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """One row: n1, n2, u (of the first), rank_biserial, z with tie correction."""
    rows = rows.where(F.col(group).isin(first, second))
    ranks = mid_ranks(rows, value)
    x = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count_if(F.col(group) == first).alias("m1"), F.count_if(F.col(group) == second).alias("m2")).join(ranks, "value")
    got = x.agg(F.sum(F.col("m1") * F.col("rank")).alias("r"), F.sum("m1").alias("n1"), F.sum("m2").alias("n2"), F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("t"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u, n = F.col("r") - n1 * (n1 + 1) / 2, n1 + n2
    dev = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("t") / (n * (n - 1))))
    return got.select("n1", "n2", u.alias("u"), (1 - 2 * u / (n1 * n2)).alias("rank_biserial"), ((u - n1 * n2 / 2) / dev).alias("z"))


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared of k degrees > x): the upper incomplete gamma by series or continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        b += 2
        d = 1 / (-i * (i - a) * d + b)
        c = b - i * (i - a) / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


# column statistics


def column_statistics(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """column, mean, std (population), cv, sparsity_pct, q25, q75, iqr, by falling cv."""
    long = matrix.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], list(names), "column", "v").withColumn("v", F.coalesce("v", F.lit(0.0)))
    got = long.groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (100 * F.avg((F.col("v") == 0).cast("double"))).alias("sparsity_pct"), F.percentile("v", F.lit(0.25)).alias("q25"), F.percentile("v", F.lit(0.75)).alias("q75"))
    return got.select("column", "mean", "std", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0).alias("cv"), "sparsity_pct", "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr")).orderBy(F.desc("cv"), "column")


def correlation(matrix: DataFrame, names: Sequence[str], method: str = "pearson") -> DataFrame:
    """a, b, r of every two columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vectors = VectorAssembler(inputCols=list(names), outputCol="v").transform(matrix.select(*[F.col(n).cast("double").alias(n) for n in names]))
    found = Correlation.corr(vectors, "v", method).first()[0].toArray()
    return matrix.sparkSession.createDataFrame([(a, b, float(found[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, r double")


def rolling_mean(rows: DataFrame, order: str, value: str, half: int) -> DataFrame:
    """value's mean over half rows before and after, along a short curve."""
    return rows.withColumn("smooth", F.avg(value).over(Window.orderBy(order).rowsBetween(-half, half)))


# structures


def structures(rows: DataFrame) -> DataFrame:
    """seq_id, structure: labels in order, equal neighbours as they are, one character each (from A on, by name over all)."""
    names = [r[0] for r in rows.select("feature").distinct().orderBy("feature").collect()]  # a label vocabulary
    code = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(chr(65 + k)))]) if names else F.create_map(F.lit(""), F.lit(""))
    path = F.transform(F.sort_array(F.collect_list(F.struct("start", code[F.col("feature")].alias("c")))), lambda x: x["c"])
    return rows.groupBy("seq_id").agg(F.array_join(path, "").alias("structure"))


def structure_distances(found: DataFrame, group: str, block: int = 256) -> DataFrame:
    """group, a, b, distance: edit distances of the different structures of one group; equal structures are compared once. A group's structures are dealt
    to parts of about block, and every two parts meet in a unit of work, so that a large group is many tasks' work."""
    one = cut(found.select(group, "structure").where(F.col(group).isNotNull() & F.col("structure").isNotNull()).distinct())
    parts = one.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    part = one.join(parts, group).withColumn("_p", F.pmod(F.xxhash64("structure"), F.col("_n")).cast("int")).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    units = part.select(group, F.least("_p", "_t").alias("_i"), F.greatest("_p", "_t").alias("_j"), "_p", "structure")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("structure")
        held, own = table["structure"].combine_chunks(), table["_p"].to_numpy()
        one, other = (np.flatnonzero(own == table[c][0].as_py()) for c in ("_i", "_j"))
        x, y = (v.ravel() for v in np.meshgrid(one, other, indexing="ij"))
        if table["_i"][0].as_py() == table["_j"][0].as_py():
            x, y = x[x < y], y[x < y]
        return pa.table({group: pa.repeat(table[group][0], len(x)), "a": held.take(pa.array(np.minimum(x, y))), "b": held.take(pa.array(np.maximum(x, y))), "distance": pa.array(edit_distances(held.to_pylist(), x, y), pa.int32())})

    return spread(units, group, "_i", "_j").groupBy(group, "_i", "_j").applyInArrow(run, f"`{group}` {dict(one.dtypes)[group]}, a string, b string, distance int")


def edit_distances(texts: list[str], x: np.ndarray, y: np.ndarray, batch: int = 8192) -> np.ndarray:
    """Levenshtein distances of texts x[k] and y[k], by code points, of many pairs side by side (Myers 1999, in blocks by Hyyro 2003). A bit for each place of x says whether the
    distance rises (up) or falls (down) from the place before, in words of 64; each code point of y moves them on. Pairs of longer y stand first and stay longest."""
    size = np.array([len(t) for t in texts], np.int64)
    longest = int(size.max(initial=0))
    letters = np.array(texts, dtype=f"U{max(1, longest)}").view(np.uint32).reshape(len(texts), -1)
    kinds, codes = np.unique(letters, return_inverse=True)
    codes, words = np.ascontiguousarray(codes.reshape(letters.shape).T), -(-max(1, longest) // 64)
    places = np.zeros((words, len(texts), len(kinds)), np.uint64)
    for i in range(longest):  # bits of the places at which a text has a code point
        has = np.flatnonzero(size > i)
        places[i // 64, has, codes[i, has]] |= np.uint64(1 << (i % 64))
    one, out, order = np.uint64(1), size[y].copy(), np.argsort(-size[y], kind="stable")
    for at in range(0, len(x), batch):
        k = order[at : at + batch]
        last, row = size[y[k]], x[k] * len(kinds)
        span = -(-max(1, int(size[x[k]].max())) // 64)
        up, down = np.full((span, len(k)), ~np.uint64(0)), np.zeros((span, len(k)), np.uint64)
        live = len(k)
        for j in range(int(last.max(initial=0))):
            while last[live - 1] <= j:
                live -= 1
            cell = row[:live] + codes[j, y[k[:live]]]
            plus, minus = one, None
            for w in range(span):
                pv, mv, eq = up[w, :live], down[w, :live], places[w].ravel()[cell]
                xv = eq | mv
                if minus is not None:
                    eq |= minus
                xh = eq & pv
                xh += pv
                xh ^= pv
                xh |= eq
                ph = xh | pv
                np.invert(ph, out=ph)
                ph |= mv
                xh &= pv
                carry = (ph >> np.uint64(63), xh >> np.uint64(63)) if w + 1 < span else None
                ph <<= one
                ph |= plus
                xh <<= one
                if minus is not None:
                    xh |= minus
                np.bitwise_and(ph, xv, out=mv)
                xv |= ph
                np.invert(xv, out=xv)
                np.bitwise_or(xv, xh, out=pv)
                plus, minus = carry or (one, None)
        for w in range(span):
            held = np.clip(size[x[k]] - 64 * w, 0, 64)
            mask = np.where(held > 63, ~np.uint64(0), (one << np.minimum(held, 63).astype(np.uint64)) - one)
            out[k] += np.bitwise_count(up[w] & mask).astype(np.int64) - np.bitwise_count(down[w] & mask)
    return out


# label filters and small helpers


def keep_prefixes(label: Column, prefixes: Sequence[str], other: str) -> Column:
    out = F.lit(other)
    for p in prefixes:
        out = F.when(label.startswith(p), label).otherwise(out)
    return out


def glob_to_regex(pattern: str) -> str:
    """A wildcard pattern (* any text, ? any character) as an anchored regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in pattern) + "$"


def matches_any(label: Column, patterns: Sequence[str]) -> Column:
    """The label, or a layer of it, fits one of the wildcard patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | _layer_fits(label, glob_to_regex(p))
    return out


def _layer_fits(label: Column, regex: str) -> Column:
    return F.exists(F.split(label, ":"), lambda x: x.rlike(regex))


def layers(label: Column, n: int) -> Column:
    """n layers, the last ones empty where the label has fewer, the surplus joined into the last."""
    parts = F.split(label, ":", n)
    return F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.lit(0), n - F.size(parts))))


def layer_count(rows: DataFrame) -> DataFrame:
    """The commonest number of layers."""
    return rows.agg(F.mode(F.size(F.split("feature", ":"))).alias("n_layers"))


def shares_listed(column: Column, least: float = 10.0) -> Column:
    """Labels of a list like "a(12.3%), b(4.0%)" with least per cent at least."""
    found = F.regexp_extract_all(column, F.lit(r"([^,(]+)\(([0-9.]+)%\)"), F.lit(1))
    pct = F.regexp_extract_all(column, F.lit(r"([^,(]+)\(([0-9.]+)%\)"), F.lit(2))
    return F.transform(F.filter(F.arrays_zip(found.alias("f"), pct.alias("p")), lambda x: x["p"].cast("double") >= least), lambda x: F.trim(x["f"]))


def coverage_of(rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """seq_id, read_length, {target}_bp and {target}_pct; reads of length 0 go."""
    got = rows.groupBy("seq_id").agg(F.max("end").alias("read_length"), *[F.sum(F.when(F.col("feature") == t, F.col("end") - F.col("start")).otherwise(0)).alias(f"{t}_bp") for t in targets]).where("read_length > 0")
    return got.select("seq_id", "read_length", *[f"{t}_bp" for t in targets], *[F.round(100 * F.col(f"{t}_bp") / F.col("read_length"), 2).alias(f"{t}_pct") for t in targets])


def alignment_stats(rows: DataFrame) -> DataFrame:
    """read, n, aligned (length of what is not secondary), primary_start: one pass with conditional aggregates over (read, start, length, secondary, primary)."""
    return rows.groupBy("read").agg(F.count("*").alias("n"), F.sum(F.when(~F.col("secondary"), F.col("length")).otherwise(0)).alias("aligned"), F.max_by(F.when(F.col("primary"), F.col("start")), F.col("primary").cast("int")).alias("primary_start"))


def orient(rows: DataFrame, primary: Sequence[str], fallback: Sequence[str] = ()) -> DataFrame:
    """Reads turned so that the primary labels (or, without any, the fallback) lie in the first half."""
    def mean(labels):
        return F.avg(F.when(F.col("feature").isin(*labels), (F.col("start") + F.col("end")) / 2)) if labels else F.lit(None).cast("double")

    place = rows.groupBy("seq_id").agg(F.coalesce(mean(list(primary)), mean(list(fallback))).alias("m"), F.max("end").alias("len"))
    x = rows.join(place, "seq_id")
    flip = F.coalesce(F.col("m") > F.col("len") / 2, F.lit(False))
    return x.select("seq_id", F.when(flip, F.col("len") - F.col("end")).otherwise(F.col("start")).alias("start"), F.when(flip, F.col("len") - F.col("start")).otherwise(F.col("end")).alias("end"), "feature", flip.alias("reversed"))


def first_seen(rows: DataFrame, column: str) -> DataFrame:
    """column's values with their place of first appearance, from 1."""
    return rows.groupBy(column).agg(F.min("ord").alias("_o")).withColumn("place", F.row_number().over(Window.orderBy("_o", column))).drop("_o")
