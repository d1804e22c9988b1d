"""What clusters hold: enrichment by group, agreement of clusterings, catalogues, signatures, labels and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .measures import chromosome, structural


def enrichment(clusters: DataFrame, groups: DataFrame, min_log2: float = 1.0, min_size: int = 2) -> DataFrame:
    """A row for each cluster and group: cluster_id, group, n, n_total, frac, log2fc (-inf if absent), top_group, private, enriched. Reads without a group go; ties of the top effect take the first group by name."""
    reads = clusters.join(groups.where("group is not null"), "read_id").select("cluster_id", "group")
    counts = reads.groupBy("cluster_id", "group").agg(F.count("*").alias("n"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("group_total"))
    sizes = counts.groupBy("cluster_id").agg(F.sum("n").alias("n_total"), F.count("*").alias("present"))
    pool = totals.agg(F.sum("group_total").alias("total"))
    names = totals.agg(F.sort_array(F.collect_list(F.struct("group", "group_total"))).alias("all"))
    grid = sizes.join(F.broadcast(names.join(F.broadcast(pool)))).select("cluster_id", "n_total", "present", "total", F.explode("all").alias("g")).select("*", "g.group", "g.group_total").drop("g")
    full = grid.join(counts, ["cluster_id", "group"], "left").na.fill(0, ["n"])
    full = full.withColumn("frac", F.col("n") / F.col("group_total"))
    full = full.withColumn("log2fc", F.when(F.col("n") > 0, F.log2(F.col("frac") / (F.col("n_total") / F.col("total")))).otherwise(float("-inf")))
    best = Window.partitionBy("cluster_id").orderBy(F.desc("log2fc"), "group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = full.withColumn("top_group", F.first("group").over(best)).withColumn("top", F.max("log2fc").over(Window.partitionBy("cluster_id")))
    return full.select("cluster_id", "group", "n", "n_total", "frac", "log2fc", "top_group", (F.col("present") == 1).alias("private"), ((F.col("n_total") >= min_size) & (F.col("top") >= min_log2)).alias("enriched"))


def wide_enrichment(rows: DataFrame) -> DataFrame:
    """enrichment() as a row for each cluster, the strongest first: cluster_id, n_total, then n_, frac_ and log2fc_ of each group by name, top_group, private and enriched (1 or 0). The groups are read first."""
    names = [r[0] for r in rows.select("group").distinct().orderBy("group").collect()]
    cells = [F.max(F.when(F.col("group") == g, F.col(c))).alias(f"{c}_{g}") for c in ("n", "frac", "log2fc") for g in names]
    ends = [F.first("top_group").alias("top_group"), *[F.max(F.col(c).cast("int")).alias(c) for c in ("private", "enriched")]]
    return rows.groupBy("cluster_id", "n_total").agg(*cells, *ends, F.max("log2fc").alias("_top")).orderBy(F.desc("_top"), F.desc("n_total"), "cluster_id").drop("_top")


def enrichment_summary(rows: DataFrame) -> DataFrame:
    """By top group: clusters, enriched and private ones."""
    one = rows.where("group = top_group")
    return one.groupBy("top_group").agg(F.count("*").alias("clusters"), F.count_if("enriched").alias("enriched"), F.count_if("private").alias("private"))


def select_rows(rows: DataFrame, enriched_only: bool = True, limit: int | None = None) -> DataFrame:
    """Clusters of a heatmap by falling effect, enriched ones only unless asked, limit of them at most (the feature's own)."""
    best = rows.where("enriched" if enriched_only else "true").groupBy("cluster_id").agg(F.max("log2fc").alias("top")).orderBy(F.desc("top"), "cluster_id")
    return best if limit is None else best.limit(limit)


def overlap_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """cluster_a, cluster_b, n_shared of two labelings (read_id, cluster_id)."""
    return a.withColumnRenamed("cluster_id", "cluster_a").join(b.withColumnRenamed("cluster_id", "cluster_b"), "read_id").groupBy("cluster_a", "cluster_b").agg(F.count("*").alias("n_shared"))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: n, ari, nmi (arithmetic mean), level, from overlap counts. Equal trivial partitions agree fully."""
    two = lambda x: x * (x - 1) / 2
    a = pairs.groupBy("cluster_a").agg(F.sum("n_shared").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"), F.sum(F.col("n") * F.log("n")).alias("ha"), F.count("*").alias("ka"))
    b = pairs.groupBy("cluster_b").agg(F.sum("n_shared").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"), F.sum(F.col("n") * F.log("n")).alias("hb"), F.count("*").alias("kb"))
    all_ = pairs.agg(F.sum("n_shared").alias("n"), F.sum(two(F.col("n_shared"))).alias("sab"), F.sum(F.col("n_shared") * F.log("n_shared")).alias("hab"), F.count("*").alias("kab"))
    x = all_.join(F.broadcast(a)).join(F.broadcast(b))
    n = F.col("n")
    expected = F.try_divide(F.col("sa") * F.col("sb"), two(n))
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when((most == expected) | (n < 2), F.when(F.col("kab") == F.greatest("ka", "kb"), 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("sab") - expected, most - expected))
    h = lambda s: F.log(n) - F.col(s) / n
    mutual = h("ha") + h("hb") - h("hab")
    nmi = F.when((F.col("ka") == 1) & (F.col("kb") == 1), 1.0).otherwise(F.coalesce(F.try_divide(mutual, (h("ha") + h("hb")) / 2), F.lit(0.0)))
    out = x.select(n, ari.alias("ari"), nmi.alias("nmi"))
    return out.withColumn("level", F.when(F.col("ari") >= 0.75, "HIGH").when(F.col("ari") >= 0.5, "MODERATE").otherwise("LOW"))


def signatures(consensus: DataFrame, sep: str = " > ") -> DataFrame:
    """cluster_id, n_segments, consensus_signature: labels by start, equal neighbours once."""
    w = Window.partitionBy("cluster_id").orderBy("start", "end")
    steps = consensus.withColumn("_b", F.lag("feature").over(w)).withColumn("_k", F.when(F.col("_b") == F.col("feature"), None).otherwise(F.struct("start", "end", "feature")))
    path = F.transform(F.sort_array(F.collect_list("_k")), lambda x: x.feature)
    return steps.groupBy("cluster_id").agg(F.count("*").alias("n_segments"), F.array_join(path, sep).alias("consensus_signature"))


def catalogue(clusters: DataFrame, consensus: DataFrame, min_size: int = 2) -> DataFrame:
    """cluster_id, size, n_segments, width, consensus_signature of clusters (cluster_id, size, width) of some size, largest first."""
    found = clusters.where(F.col("size") >= min_size).join(signatures(consensus), "cluster_id", "left")
    return found.select("cluster_id", "size", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("consensus_signature", F.lit("")).alias("consensus_signature")).orderBy(F.desc("size"), "cluster_id")


def labels(clusters: DataFrame, consensus: DataFrame, roles, min_size: int = 2, end_share: float = 0.15, satellite_share: float = 0.8, alt_bp: int = 6000, specific=None) -> DataFrame:
    """Structural labels of clusters from where telomere, satellite and ITS/TAR1 stretches lie in the consensus; roles as in measures.category, with telomere."""
    own = consensus.withColumn("_f", structural(F.col("feature")))
    every = Window.partitionBy("cluster_id")
    own = own.withColumn("_s", F.min("start").over(every)).withColumn("_e", F.max("end").over(every)).withColumn("_len", F.greatest(F.lit(1), F.col("_e") - F.col("_s")))
    tel, near, far = roles.members("telomere", F.col("_f")), F.col("start") < F.col("_s") + end_share * F.col("_len"), F.col("end") > F.col("_e") - end_share * F.col("_len")
    canonical = roles.members("canonical", F.col("_f"))
    w = Window.partitionBy("cluster_id").orderBy("start", "end")
    own = own.withColumn("_run", F.sum(F.when(canonical, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("_block", F.sum(F.when(canonical, F.col("end") - F.col("start")).otherwise(0)).over(Window.partitionBy("cluster_id", "_run")))
    flags = own.groupBy("cluster_id").agg(
        F.bool_or(tel & near).alias("a"), F.bool_or(tel & ~near & far).alias("b"), F.bool_or(tel & ~near & ~far).alias("c"), F.bool_or(roles.members("its_tar1", F.col("_f"))).alias("i"),
        F.sum(F.when(roles.members("satellite", F.col("_f")), F.col("end") - F.col("start")).otherwise(0)).alias("sat"), F.max("_block").alias("block"), F.max("_len").alias("len"),
    )
    label = F.when(F.col("a") & F.col("b"), "ECTR").when((F.col("a") | F.col("b")) & (F.col("block") >= alt_bp), "Type II ALT subtelomere").when(F.col("a") | F.col("b"), "subtelomere")
    label = label.when(F.col("c"), "interstitial telomere").when(F.col("i"), "interstitial ITS/TAR1").when(F.col("sat") / F.col("len") >= satellite_share, "satellite-dominant").otherwise("")
    chrom = chromosome(F.col("feature"))
    keep = (chrom != "") if specific is None else chrom.isin(sorted(specific))
    digits = F.substring(chrom, 4, 100)
    key = F.struct(F.when(digits.rlike("^[0-9]+$"), 0).otherwise(1).alias("k"), digits.try_cast("int").alias("n"), digits.alias("s"), chrom.alias("c"))
    chroms = consensus.where(keep).groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set(key)), lambda x: x.c), "+").alias("chromosomes"))
    found = catalogue(clusters, consensus, min_size).join(flags.select("cluster_id", label.alias("label")), "cluster_id", "left").join(chroms, "cluster_id", "left")
    return found.select("cluster_id", "size", "width", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("chromosomes", F.lit("")).alias("chromosomes"), "consensus_signature").orderBy(F.desc("size"), "cluster_id")


def crosstab_margins(merged: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of label pairs with All rows and columns."""
    return merged.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb")).select(F.when(F.col("ga") == 1, "All").otherwise(F.col(a)).alias(a), F.when(F.col("gb") == 1, "All").otherwise(F.col(b)).alias(b), "n")


def retention(merged: DataFrame, a: str, b: str, top: int = 3) -> DataFrame:
    """For each label of a: reads, the share that has the same label in b, and its commonest labels there as label(n)."""
    n = merged.groupBy(a, b).agg(F.count("*").alias("n"))
    w = Window.partitionBy(a).orderBy(F.desc("n"), b)
    ranked = n.withColumn("r", F.row_number().over(w))
    shown = F.struct("r", F.concat(F.col(b), F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    return ranked.groupBy(a).agg(F.sum("n").alias("n_reads"), (F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)) / F.sum("n")).alias("retained"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= top, shown))), lambda x: x.t), ", ").alias("top"))


def purity(merged: DataFrame, a: str, b: str) -> DataFrame:
    """retention() seen from b."""
    return retention(merged, b, a)


def summary(rows: DataFrame, value: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """By cluster: size, mean, median, standard deviation and the count of each kind."""
    return rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev(value).alias("std"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def top_labels(shares: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """The n largest labels by bp of each key, as one string label(12.3%); shares are rounded by their exact binary value, halves to even, as printf does."""
    w = Window.partitionBy(*keys).orderBy(F.desc("bp"), "feature")
    total = F.sum("bp").over(Window.partitionBy(*keys))
    ranked = shares.withColumn("r", F.row_number().over(w)).withColumn("_share", 100 * F.col("bp") / total).withColumn("t", F.concat(F.col("feature"), F.lit("("), F.call_function("format_number", F.col("_share"), F.lit("0.0")), F.lit("%)"))).where(F.col("r") <= n)
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x.t), ", ").alias("top"))


def top_or_other(rows: DataFrame, n: int) -> DataFrame:
    """Labels beyond the n commonest (by rows, then name) become other."""
    best = rows.groupBy("feature").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "feature").limit(n).select(F.col("feature").alias("_f"))
    return rows.join(F.broadcast(best), rows.feature == F.col("_f"), "left").withColumn("feature", F.coalesce("_f", F.lit("other"))).drop("_f")


def above_threshold(fractions: DataFrame, members: DataFrame, thresholds: DataFrame) -> DataFrame:
    """cluster_id, feature, readpct (share of its reads over the label's threshold) and bppct (share of its bp)."""
    own = fractions.join(members, "seq_id")
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    total = own.groupBy("cluster_id").agg(F.sum("bp").alias("all_bp"))
    hit = own.join(thresholds.select("feature", "threshold"), "feature").groupBy("cluster_id", "feature").agg(F.count_if(F.col("frac") > F.col("threshold")).alias("hit"), F.sum("bp").alias("bp"))
    return hit.join(size, "cluster_id").join(total, "cluster_id").select("cluster_id", "feature", (F.col("hit") / F.col("n")).alias("readpct"), (F.col("bp") / F.col("all_bp")).alias("bppct"))


def representatives(rows: DataFrame, n: int = 1) -> DataFrame:
    """The n rows (cluster_id, read_id, centroid_distance) of each cluster nearest its centre, with rank."""
    w = Window.partitionBy("cluster_id").orderBy("centroid_distance", "read_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def nearest_then_longest(rows: DataFrame, n: int) -> DataFrame:
    """Of the nearest quarter of each cluster (one at least) the n longest reads."""
    w = Window.partitionBy("cluster_id").orderBy("centroid_distance", "read_id")
    near = rows.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("cluster_id"))).where(F.col("_r") <= F.greatest(F.lit(1), F.expr("_n div 4")))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("read_length"), "read_id"))).where(F.col("rank") <= n).drop("_r", "_n")


def balanced_score(rows: DataFrame) -> DataFrame:
    """score: half the feature score, four tenths the length over the cluster's longest, a tenth the nearness to the centre."""
    every = Window.partitionBy("cluster_id")
    length = F.coalesce(F.try_divide(F.col("read_length"), F.max("read_length").over(every)), F.lit(0.0))
    far = F.coalesce(F.try_divide(F.col("centroid_distance"), F.max("centroid_distance").over(every)), F.lit(0.0))
    return rows.withColumn("score", 0.5 * F.col("feature_score") + 0.4 * length + 0.1 * (1 - far))


def length_score(span: str, target: str, most: float = 3.0):
    """1 at the target length, 0 at most doublings away."""
    return F.greatest(F.lit(0.0), 1 - F.abs(F.log2(F.col(span) / F.col(target))) / most)
