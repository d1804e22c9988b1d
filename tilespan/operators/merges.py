"""The older pairwise merges: only sequences that all inputs hold, pieces uncoalesced unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import coalesce_runs, overlap_join, priority_fill

#: Label classes of the merges.
TELOMERE = ("canonical_telomere", "noncanonical_telomere", "telomere_like", "ITS", "TAR1")
ARMS = ("arm", "p_arm", "q_arm")
ACROCENTRIC = ("chr13", "chr14", "chr15", "chr21", "chr22")


def common(*tables: DataFrame) -> list[DataFrame]:
    """The rows of sequences that every table holds."""
    ids = reduce(lambda a, b: a.intersect(b), [t.select("seq_id").distinct() for t in tables])
    return [t.join(ids, "seq_id", "left_semi") for t in tables]


def region_repeat(region: Column, repeat: Column) -> Column:
    """Arms show the repeat; ct shows a repeat unless there is none; rDNA over rRNA is rRNA; else the region."""
    return F.when(region.isin(*ARMS), repeat).when((region == "ct") & (repeat == "nonrepeat"), "ct").when(region == "ct", repeat).when((region == "rDNA") & (repeat == "rRNA"), "rRNA").otherwise(region)


def three_way(subtelomeric: DataFrame, region: DataFrame, repeat: DataFrame) -> DataFrame:
    """Telomere labels over all; elsewhere region and repeat by region_repeat()."""
    subtelomeric, region, repeat = common(subtelomeric, region, repeat)
    below = overlap_join(region, repeat, label=region_repeat(F.col("f1"), F.col("f2")))
    return overlay_first(subtelomeric.where(F.col("feature").isin(*TELOMERE)), below)


def overlay_first(first: DataFrame, below: DataFrame) -> DataFrame:
    """first, and below where first has nothing; sequences without any first keep below whole."""
    bare = below.join(first.select("seq_id").distinct(), "seq_id", "left_anti").select("seq_id", "start", "end", "feature")
    return priority_fill(first, below).union(bare)


def telomere_satellite(subtelomeric: DataFrame, satellite: DataFrame, priority=TELOMERE) -> DataFrame:
    subtelomeric, satellite = common(subtelomeric, satellite)
    return overlay_first(subtelomeric.where(F.col("feature").isin(*priority)), satellite)


def chromosome_acrocentric(chromosome: DataFrame, acrocentric: DataFrame, priority=("DJ", "PHR", "rDNA", "SST1", "PJ", "array", "acrocentric")) -> DataFrame:
    chromosome, acrocentric = common(chromosome, acrocentric)
    return overlay_first(acrocentric.where(F.col("feature").isin(*priority)), chromosome)


def telomere_acrocentric(subtelomeric: DataFrame, acrocentric: DataFrame) -> DataFrame:
    """Telomere labels win; ITS and TAR1 join DJ, PHR and rDNA by an underscore, else stand alone; else the acrocentric label. Equal neighbours joined."""
    subtelomeric, acrocentric = common(subtelomeric, acrocentric)
    s, a = F.col("f1"), F.col("f2")
    label = F.when(s.isin("canonical_telomere", "noncanonical_telomere"), s).when(s.isin("ITS", "TAR1") & a.isin("DJ", "PHR", "rDNA"), F.concat_ws("_", a, s)).when(s.isin("ITS", "TAR1"), s).otherwise(a)
    return coalesce_runs(overlap_join(subtelomeric, acrocentric, label=label))


def remap_chromosomes(label: Column, keep=ACROCENTRIC, other: str = "nonacrocentric") -> Column:
    return F.when(label.startswith("chr") & ~label.isin(*keep), other).otherwise(label)


def either_version(newer: Column, older: Column) -> Column:
    """The newer vocabulary's value, or where it is 0 or missing the older one's, else 0."""
    return F.coalesce(F.nullif(newer, F.lit(0.0)), F.nullif(older, F.lit(0.0)), F.lit(0.0))
