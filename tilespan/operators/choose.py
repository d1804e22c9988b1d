"""Choosing representatives: scores, tiers, and greedy choices that are one cluster's work each."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def presence(members: DataFrame, wanted: DataFrame, held: DataFrame) -> DataFrame:
    """cluster_id, read_id, share: of the cluster's wanted labels (cluster_id, feature), those that the read holds (read_id, feature)."""
    asked = members.select("cluster_id", "read_id").join(wanted, "cluster_id")
    found = asked.join(held.select("read_id", "feature", F.lit(1).alias("has")).distinct(), ["read_id", "feature"], "left")
    return found.groupBy("cluster_id", "read_id").agg(F.avg(F.coalesce("has", F.lit(0)).cast("double")).alias("share"))


def group_bp(held: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """read_id and the length of each named group of labels."""
    return held.groupBy("read_id").agg(*[F.sum(F.when(F.col("feature").isin(*labels), F.col("bp")).otherwise(0)).alias(name) for name, labels in groups.items()])


def tiered(rows: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """n reads a cluster: those with all wanted labels and a length in [low, high] first, then those with all labels, then by share; in a tier the nearest to the centre."""
    tier = F.when((F.col("share") == 1) & F.col("read_length").between(low, high), 0).when(F.col("share") == 1, 1).when(F.col("share") > 0, 2).otherwise(3)
    w = Window.partitionBy("cluster_id").orderBy("tier", F.desc("share"), "centroid_distance", "read_id")
    return rows.withColumn("tier", tier).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


#: The lengths of reads that are drawn best, and next best.
BEST, NEXT = (16_000, 20_000), (10_000, 15_999)


def length_tiers(rows: DataFrame, n: int) -> DataFrame:
    """n reads a cluster (cluster_id, read_id, read_length, share) that hold a wanted label: those of the best length first, then of the next, then shorter ones, in a
    tier the longest; reads beyond the best length are never taken."""
    tier = F.when(F.col("read_length").between(*BEST), 0).when(F.col("read_length").between(*NEXT), 1).when(F.col("read_length") < NEXT[0], 2)
    w = Window.partitionBy("cluster_id").orderBy("tier", F.desc("read_length"), "read_id")
    return rows.where("share > 0").withColumn("tier", tier).where("tier is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def by_strategy(rows: DataFrame, n: int, strategy: str) -> DataFrame:
    """n reads a cluster by name: feature-match (length_tiers, and for clusters where that finds none the fallback), longest, balanced (by clusters.balanced_score),
    centroid or by-sample; columns cluster_id, read_id, rank."""
    from . import clusters

    own = Window.partitionBy("cluster_id")
    if strategy == "feature-match":
        found = length_tiers(rows, n).select("cluster_id", "read_id", "rank")
        rest = rows.join(found.select("cluster_id").distinct(), "cluster_id", "left_anti")
        return found.unionByName(clusters.nearest_then_longest(rest, n).select("cluster_id", "read_id", "rank"))
    if strategy == "centroid":
        return clusters.representatives(rows, n).select("cluster_id", "read_id", "rank")
    if strategy == "by-sample":
        return by_sample(rows, n).select("cluster_id", "read_id", "rank")
    scored = {"longest": lambda: rows.withColumn("_s", F.col("read_length")), "balanced": lambda: clusters.balanced_score(rows).withColumnRenamed("score", "_s")}
    if strategy not in scored:
        raise ValueError(f"no strategy {strategy}")
    ranked = scored[strategy]().withColumn("rank", F.row_number().over(own.orderBy(F.desc("_s"), "read_id")))
    return ranked.where(F.col("rank") <= n).select("cluster_id", "read_id", "rank")


def closeness(read: Column, cluster: Column) -> Column:
    """1 for equal values, falling to 0 where their difference is the cluster's value."""
    return F.greatest(F.lit(0.0), 1 - F.abs(read - cluster) / F.greatest(F.abs(cluster), F.lit(1e-6)))


def annotation_score(read_metrics: DataFrame, cluster_metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """cluster_id, read_id, score: closeness of a read's metrics (cluster_id, read_id, term, feature, value) to its cluster's (cluster_id, term, feature, value), averaged by term and weighted; absent values are 0."""
    reads = read_metrics.select("cluster_id", "read_id").distinct()
    grid = reads.join(cluster_metrics.withColumnRenamed("value", "c"), "cluster_id").join(read_metrics.withColumnRenamed("value", "r"), ["cluster_id", "read_id", "term", "feature"], "left")
    terms = grid.groupBy("cluster_id", "read_id", "term").agg(F.avg(closeness(F.coalesce("r", F.lit(0.0)), F.col("c"))).alias("near"))
    heft = F.coalesce(*[F.when(F.col("term") == t, F.lit(float(w))) for t, w in weights.items()], F.lit(0.0))
    return terms.groupBy("cluster_id", "read_id").agg((F.sum(F.col("near") * heft) / F.nullif(F.sum(heft), F.lit(0.0))).alias("score"))


def by_sample(rows: DataFrame, n: int) -> DataFrame:
    """n reads a cluster at most (cluster_id, read_id, sample, centroid_distance, rank): samples by falling size each take their
    share of n, rounded half to even, one at least, while slots last, and give their nearest reads."""
    sample = Window.partitionBy("cluster_id", "sample")
    sizes = rows.groupBy("cluster_id", "sample").agg(F.count("*").alias("size"))
    wanted = F.least("size", F.greatest(F.lit(1), F.bround(F.col("size") / F.sum("size").over(Window.partitionBy("cluster_id")) * n)).cast("long"))
    sizes = sizes.withColumn("wanted", wanted)
    before = F.sum("wanted").over(Window.partitionBy("cluster_id").orderBy(F.desc("size"), "sample")) - F.col("wanted")
    slots = sizes.select("cluster_id", "sample", F.least("wanted", F.greatest(F.lit(0), n - before)).alias("slots")).where("slots > 0")
    near = rows.withColumn("_n", F.row_number().over(sample.orderBy("centroid_distance", "read_id")))
    kept = near.join(slots, ["cluster_id", "sample"]).where("_n <= slots")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("centroid_distance", "read_id"))
    return kept.select("cluster_id", "read_id", "sample", "centroid_distance", rank.alias("rank"))


def even_lengths(rows: DataFrame, n: int) -> DataFrame:
    """n candidates a cluster whose lengths lie nearest to one target, the median of all best candidates: in rank order those within a doubling first."""
    best = rows.where("rank = 1").agg(F.percentile("read_length", F.lit(0.5)).alias("target"))
    off = F.abs(F.log2(F.col("read_length") / F.col("target")))
    w = Window.partitionBy("cluster_id").orderBy("far", "rank", "read_id")
    return rows.join(F.broadcast(best)).withColumn("far", F.when(off <= 1, 0).otherwise(1)).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n).drop("target", "far")


def curated(candidates: DataFrame, choice: DataFrame) -> DataFrame:
    """A candidate (cluster_id, read_id, rank, ord) a cluster: that of the chosen rank (cluster_id, chosen; 1 if none), else the first in the file."""
    asked = candidates.join(choice, "cluster_id", "left").withColumn("hit", (F.col("rank") == F.coalesce("chosen", F.lit(1))).cast("int"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("hit"), "ord")
    return asked.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "hit", "chosen")


def sweep(x, merges: list, ks: Sequence[int], groups: Sequence[str]) -> list[dict]:
    """Quality of each number of clusters of a bounded matrix: the measures, the share of reads in enriched clusters' size and of pure clusters, and the composite .5 silhouette (0 to 1) + .1 enriched + .4 pure."""
    import numpy as np

    from .legacy import cut_tree, quality

    out = []
    for k in ks:
        labels = cut_tree(merges, len(x), k)
        tables = [[groups[i] for i in np.flatnonzero(labels == g)] for g in np.unique(labels)]
        pure = sum(len(set(t)) == 1 for t in tables) / len(tables)
        overall = {g: groups.count(g) / len(groups) for g in set(groups)} if isinstance(groups, list) else {g: list(groups).count(g) / len(groups) for g in set(groups)}
        enriched = sum(any(t.count(g) / len(t) >= 1.5 * overall[g] for g in set(t)) for t in tables) / len(tables)
        q = quality(x, labels)
        out.append({"k": k, **q, "enriched": enriched, "pure": pure, "composite": 0.5 * (q["silhouette"] + 1) / 2 + 0.1 * enriched + 0.4 * pure})
    return out
