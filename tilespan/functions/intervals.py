"""Interval algebra on rows (keys, start, end, feature), half-open, one shuffle by key at most for each step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _before(keys, *order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def coalesce_runs(rows: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Equal labels that follow each other and touch or overlap become one row; a run reaches as far as its longest member."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    marked = rows.withColumn("_new", F.when(F.lag("feature").over(w) == F.col("feature"), 0).otherwise(1))
    marked = marked.withColumn("_same", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reach = F.max("end").over(_before([*keys, "_same"], "start", "end"))
    marked = marked.withColumn("_cut", F.when(F.col("start") <= reach, 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_cut").over(Window.partitionBy(*keys, "_same").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_same", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("feature").alias("feature")).select(*keys, "start", "end", "feature")


def blocks(rows: DataFrame, keys: Sequence[str], tolerance: int = 0) -> DataFrame:
    """Stretches of rows of one key with no gap over the tolerance between them."""
    reach = F.max("end").over(_before(keys, "start", "end"))
    marked = rows.withColumn("_cut", F.when(F.col("start") - reach <= tolerance, 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_cut").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_run")


def merge_overlapping(rows: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    return blocks(rows, keys).drop("n")


def total_covered(rows: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Length covered, overlaps once."""
    return merge_overlapping(rows, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def max_block(rows: DataFrame, keys: Sequence[str], tolerance: int = 100) -> DataFrame:
    """The longest stretch, gaps up to the tolerance bridged."""
    return blocks(rows, keys, tolerance).groupBy(*keys).agg(F.max(F.col("end") - F.col("start")).alias("max_block"))


def refine(tracks: dict[str, DataFrame], keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """The common refinement of tilings of one span: keys, start, end and a column for each track. Starts of all tracks are
    united and each track's last label filled forward, so no range join is needed."""
    names, parts = list(tracks), None
    for name in names:
        own = tracks[name].select(*keys, F.col("start").alias("_pos"), F.col("end").alias("_end"), *[(F.col("feature") if n == name else F.lit(None).cast("string")).alias(n) for n in names])
        parts = own if parts is None else parts.union(own)
    at = parts.groupBy(*keys, "_pos").agg(*[F.max(n).alias(n) for n in names], F.max("_end").alias("_end"))
    w = Window.partitionBy(*keys).orderBy("_pos")
    filled = at.select(*keys, F.col("_pos").alias("start"), *[F.last(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names], F.coalesce(F.lead("_pos").over(w), F.max("_end").over(Window.partitionBy(*keys))).alias("end"))
    return filled.select(*keys, "start", "end", *names)


def track_mismatches(tracks: dict[str, DataFrame]) -> DataFrame:
    """Sequences whose tracks do not all exist over one span: seq_id, problem (missing or span)."""
    parts = None
    for name, rows in tracks.items():
        own = rows.groupBy("seq_id").agg(F.min("start").alias("s"), F.max("end").alias("e")).withColumn("t", F.lit(name))
        parts = own if parts is None else parts.union(own)
    found = parts.groupBy("seq_id").agg(F.count_distinct("t").alias("n"), F.min("s").alias("s0"), F.max("s").alias("s1"), F.min("e").alias("e0"), F.max("e").alias("e1"))
    return found.select("seq_id", F.when(F.col("n") < len(tracks), "missing").when((F.col("s0") != F.col("s1")) | (F.col("e0") != F.col("e1")), "span").alias("problem")).where("problem is not null")


def overlap_join(a: DataFrame, b: DataFrame, sep: str = ":", label: Column | None = None, bin_size: int = 1 << 14) -> DataFrame:
    """Every overlap of a row of a with one of b in the same sequence, its label a's and b's joined. Rows are dealt to bins of
    the coordinate, so that one long sequence is many join keys; a pair is taken in the bin where the overlap starts."""

    def binned(rows, s, e, f):
        own = rows.select("seq_id", F.col("start").alias(s), F.col("end").alias(e), F.col("feature").alias(f))
        return own.withColumn("_bin", F.explode(F.sequence(F.expr(f"{s} div {bin_size}"), F.expr(f"({e} - 1) div {bin_size}"))))

    met = binned(a, "s1", "e1", "f1").join(binned(b, "s2", "e2", "f2"), ["seq_id", "_bin"]).where("s1 < e2 and s2 < e1").where(F.expr(f"greatest(s1, s2) div {bin_size} = _bin"))
    return met.select("seq_id", F.greatest("s1", "s2").alias("start"), F.least("e1", "e2").alias("end"), (F.concat_ws(sep, "f1", "f2") if label is None else label).alias("feature"))


def subtract(rows: DataFrame, blockers: DataFrame) -> DataFrame:
    """The parts of rows that no blocker covers, a piece each: cut at blocker edges in one sweep by sequence. Rows must not overlap each other."""
    solid = merge_overlapping(blockers.select("seq_id", "start", "end"))
    events = rows.select("seq_id", F.col("start").alias("pos"), F.lit(1).alias("kind"), "feature", "end").union(
        solid.select("seq_id", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(2).alias("kind"), F.col("end")), F.struct(F.col("end").alias("pos"), F.lit(0).alias("kind"), F.col("end")))).alias("x")).select("seq_id", "x.pos", "x.kind", F.lit(None).cast("string"), "x.end")
    )
    w = Window.partitionBy("seq_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("feature", F.last("feature", ignorenulls=True).over(w)).withColumn("row_end", F.last(F.when(F.col("kind") == 1, F.col("end")), ignorenulls=True).over(w))
    swept = swept.withColumn("covered", F.sum(F.when(F.col("kind") == 2, 1).when(F.col("kind") == 0, -1).otherwise(0)).over(w))
    swept = swept.withColumn("next", F.lead("pos").over(Window.partitionBy("seq_id").orderBy("pos", "kind")))
    left = swept.where("covered = 0 and row_end is not null").select("seq_id", F.col("pos").alias("start"), F.least(F.coalesce("next", "row_end"), "row_end").alias("end"), "feature")
    return left.where("start < end")


def priority_fill(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of first, and of second only where first has none; sequences that both have."""
    common = first.select("seq_id").distinct().intersect(second.select("seq_id").distinct())
    first, second = first.join(common, "seq_id", "left_semi"), second.join(common, "seq_id", "left_semi")
    return first.select("seq_id", "start", "end", "feature").union(subtract(second, first))
