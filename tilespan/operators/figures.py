"""What figures show: selections, groupings, orders, legends, matrices and lines, as tables. Nothing is drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .measures import chromosome


def missing_colors(rows: DataFrame, palette: DataFrame) -> DataFrame:
    """Labels in use that the palette lacks; novel needs no colour."""
    return rows.select("feature").distinct().where("feature <> 'novel'").join(palette.select("feature"), "feature", "left_anti")


def legend(rows: DataFrame, palette: DataFrame) -> DataFrame:
    """place, label, color of the labels in use, in the palette's order, underscores as blanks, each text once."""
    used = rows.select("feature").distinct().join(palette.select("feature", "color", "ord"), "feature")
    shown = used.groupBy(F.translate("feature", "_", " ").alias("label")).agg(F.min_by("color", "ord").alias("color"), F.min("ord").alias("ord"))
    return shown.select(F.row_number().over(Window.orderBy("ord", "label")).alias("place"), "label", "color")  # a legend


def legend_order(labels: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """feature, place: labels by the featureset that holds their last layer (the first in the hierarchy's order, where several do), then categorized, chromosomes by
    number, others as the hierarchy lists them, novel last; labels of no featureset after all. hierarchy: feature_set, child and ord, its order."""
    first = Window.partitionBy("child").orderBy("_rank", "ord")
    ranks = hierarchy.groupBy("feature_set").agg(F.min("ord").alias("_o")).withColumn("_rank", F.row_number().over(Window.orderBy("_o"))).drop("_o")  # featuresets
    known = hierarchy.join(F.broadcast(ranks), "feature_set").withColumn("_k", F.row_number().over(first)).where("_k = 1").select(F.col("child").alias("_s"), "_rank", "ord")
    named = labels.select("feature").distinct().withColumn("_s", F.when(F.instr("feature", ":") > 0, F.expr("substring(feature, instr(feature, ':') + 1)")).otherwise(F.col("feature")))
    pinned = F.when(F.col("_s") == "categorized", 0).when(F.col("_s") == "novel", 2).otherwise(1)
    number = F.regexp_extract("_s", "^chr([0-9]+)$", 1).try_cast("int")
    order = [F.col("_rank").asc_nulls_last(), pinned, F.when(F.col("_s").startswith("chr"), 0).otherwise(1), number.asc_nulls_last(), F.when(F.col("_s").startswith("chr"), F.col("_s")), F.col("ord").asc_nulls_last(), F.col("_s"), F.col("feature")]
    return named.join(known, "_s", "left").select("feature", F.row_number().over(Window.orderBy(*order)).alias("place"))  # a legend


def value_colors(rows: DataFrame, column: str, colors: Sequence[str]) -> DataFrame:
    """value and colour of a categorical column, colours dealt in order of first appearance (column ord), round and round."""
    seen = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.orderBy("ord", "value"))
    return seen.select("value", place.alias("place"), F.element_at(F.array(*map(F.lit, colors)), ((place - 1) % len(colors) + 1).cast("int")).alias("color"))


def grouping(rows: DataFrame, group: str, subgroup: str) -> DataFrame:
    """group, subgroup, place: groups by first appearance, each one's subgroups together, by first appearance too."""
    parts = rows.groupBy(F.col(group).alias("group"), F.col(subgroup).alias("subgroup")).agg(F.min("ord").alias("_s"))
    parts = parts.withColumn("_g", F.min("_s").over(Window.partitionBy("group")))
    return parts.select("group", "subgroup", F.row_number().over(Window.orderBy("_g", "group", "_s", "subgroup")).alias("place"))


def relabelled(reads: DataFrame, parts: DataFrame) -> DataFrame:
    """reads (read_id, sample, group, subgroup) with label and boundary: label is group — subgroup (the group alone without one, the sample of reads without a
    group); boundary marks the last part of each group but the last. parts: grouping() of the reads."""
    name = lambda g, s: F.when(F.col(s).isNull(), F.col(g)).otherwise(F.concat_ws(" \u2014 ", g, s))
    after = F.lead("group").over(Window.orderBy("place"))  # a figure's parts
    shown = parts.select(name("group", "subgroup").alias("label"), F.coalesce(after != F.col("group"), F.lit(False)).alias("boundary")).distinct()
    named = reads.withColumn("label", F.when(F.col("group").isNull(), F.col("sample")).otherwise(name("group", "subgroup")))
    return named.join(F.broadcast(shown), "label", "left").withColumn("boundary", F.coalesce("boundary", F.lit(False)))


def column_specs(specs: Sequence[str]) -> list[tuple[str, str]]:
    """(column, shown name) of COLUMN[:DISPLAY]."""
    return [(c, shown or c) for c, _, shown in (x.partition(":") for x in specs)]


def group_spans(parts: DataFrame) -> DataFrame:
    """group, start, end: the extent of each unbroken stretch of a group over ordered parts (group, place, start, end)."""
    w = Window.orderBy("place")
    runs = parts.withColumn("_r", F.sum(F.when(F.lag("group").over(w) == F.col("group"), 0).otherwise(1)).over(w))
    return runs.groupBy("_r", "group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_r")


def major_chromosomes(consensus: DataFrame, chromosomes: Sequence[str] | None = None, least: float = 0.1) -> DataFrame:
    """cluster_id, chromosomes: first layers (given chromosomes, the hierarchy's role of that name, only those) that hold least of the whole consensus, largest first, joined by a plus. Clusters without one are left out."""
    n = consensus.withColumn("c", chromosome(F.col("feature"))).groupBy("cluster_id", "c").agg(F.sum(F.col("end") - F.col("start")).alias("bp"))
    n = n.withColumn("share", F.col("bp") / F.sum("bp").over(Window.partitionBy("cluster_id"))).where(F.col("share") >= least)
    n = n if chromosomes is None else n.where(F.col("c").isin(*chromosomes))
    return n.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("bp")).alias("k"), "c"))), lambda x: x["c"]), "+").alias("chromosomes"))


def to_breakpoint(consensus: DataFrame, telomere: Sequence[str]) -> DataFrame:
    """cluster_id, start, end, feature, breakpoint: consensus turned so that more telomere lies left; breakpoint is the end of the telomere stretch that opens it (0 without one)."""
    tel = F.col("feature").isin(*telomere)
    shape = consensus.groupBy("cluster_id").agg(F.max("end").alias("_w"), F.avg(F.when(tel, (F.col("start") + F.col("end")) / 2)).alias("_m"))
    x = consensus.join(shape, "cluster_id")
    flip = F.coalesce(F.col("_m") > F.col("_w") / 2, F.lit(False))
    x = x.select("cluster_id", F.when(flip, F.col("_w") - F.col("end")).otherwise(F.col("start")).alias("start"), F.when(flip, F.col("_w") - F.col("start")).otherwise(F.col("end")).alias("end"), "feature")
    broken = F.sum(F.when(tel, 0).otherwise(1)).over(Window.partitionBy("cluster_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    lead = x.withColumn("_b", broken).withColumn("breakpoint", F.coalesce(F.max(F.when(F.col("_b") == 0, F.col("end"))).over(Window.partitionBy("cluster_id")), F.lit(0)))
    return lead.drop("_b")


def count_matrix(members: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """cluster_id and the reads of each sample or group named."""
    return members.groupBy("cluster_id").pivot(column, list(names)).count().na.fill(0)


def row_shares(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """A count matrix as shares of its rows; rows of zeros stay zero."""
    total = sum((F.col(n) for n in names), F.lit(0))
    return matrix.select("cluster_id", *[(F.col(n) / F.when(total > 0, total).otherwise(1)).alias(n) for n in names])


def density_line(rows: DataFrame, size: int, most: int = 50) -> DataFrame:
    """seq_id, bin, percent: marks that touch each bin, over most, 100 at the top."""
    hit = rows.select("seq_id", F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(end - 1) div {size}"))).alias("bin"))
    return hit.groupBy("seq_id", "bin").agg(F.least(F.lit(100.0), 100.0 * F.count("*") / most).alias("percent"))


def by_sample_then_length(reads: DataFrame, samples: DataFrame) -> DataFrame:
    """reads (read_id, sample, length) with place: samples in their order (sample, place), longest reads first."""
    w = Window.partitionBy("sample").orderBy(F.desc("length"), "read_id")
    return reads.join(samples.withColumnRenamed("place", "sample_place"), "sample").withColumn("place", F.row_number().over(w)).orderBy("sample_place", "place")
