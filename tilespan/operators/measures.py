"""Measures of each sequence: lengths and shares of labels, sliding-window densities, transitions, thresholds, and the wide matrix."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import max_block
from .storage import dealt, tasks, written

WINDOW, GAP, FACTOR, LEAST, MOST = 1000, 100, 3.0, 0.001, 0.05
DENSITIES = ("dmax", "dmin", "dmedian", "dfirst", "dlast", "dterminal", "dterminal_min")


def feature_bp(rows: DataFrame, keys: Sequence[str] = ("feature_set", "seq_id")) -> DataFrame:
    return rows.groupBy(*keys, "feature").agg(F.sum(F.col("end") - F.col("start")).alias("bp"))


def feature_fraction(rows: DataFrame, keys: Sequence[str] = ("feature_set", "seq_id")) -> DataFrame:
    """keys, feature, bp, total_bp, frac."""
    total = F.sum("bp").over(Window.partitionBy(*keys))
    return feature_bp(rows, keys).withColumn("total_bp", total).withColumn("frac", F.col("bp") / F.col("total_bp"))


def window_densities(rows: DataFrame, window: int = WINDOW, keys: Sequence[str] = ("seq_id",), n_tasks: int | None = None) -> DataFrame:
    """keys, feature and the density of each label over all windows of this length: dmax, dmin, dmedian, dfirst, dlast, dterminal, dterminal_min.

    The covered length in [i, i + window) is piecewise linear in i: its slope falls by one where a row starts to leave (at its
    start) and rises where one starts to enter (at its start less the window), and back at the ends. Sorted slope changes give
    runs; extremes stand at run ends, and only sloped runs are exploded for the median. A sequence shorter than the window has
    its whole share everywhere.
    """
    keys = list(keys)
    own = [*keys, "feature"]
    n_tasks = n_tasks or tasks(rows)
    rows = rows.repartition(n_tasks, *keys)  # everything below stays in such tasks: a row becomes ten, and sorts and aggregates hold them
    span = rows.groupBy(*keys).agg(F.min("start").alias("_s"), (F.max("end") - F.min("start")).alias("_len"))
    local = rows.join(span, keys).select(*own, (F.col("start") - F.col("_s")).alias("s"), (F.col("end") - F.col("_s")).alias("e"), "_len")
    short = local.where(F.col("_len") < window).groupBy(*own).agg((F.sum(F.col("e") - F.col("s")) / F.max("_len")).alias("d")).select(*own, *[F.col("d").alias(n) for n in DENSITIES])
    long = local.where(F.col("_len") >= window).withColumn("_last", F.col("_len") - window)
    at_zero = F.greatest(F.lit(0), F.least("e", F.lit(window)) - F.col("s"))
    # each row's mark at zero carries what it covers of the first window, so that no join or union has these rows dealt anew into tasks by shuffled bytes
    marks = F.array(*[F.struct(p.alias("p"), F.lit(d).alias("d"), v.cast("bigint").alias("v")) for p, d, v in ((F.col("s"), -1, F.lit(None)), (F.col("e"), 1, F.lit(None)), (F.col("s") - window, 1, F.lit(None)), (F.col("e") - window, -1, F.lit(None)), (F.lit(0).cast("bigint"), 0, at_zero))])
    moves = long.select(*own, "_last", F.explode(marks).alias("m")).select(*own, "_last", F.greatest(F.lit(0), "m.p").alias("p"), "m.d", "m.v").where((F.col("p") < F.col("_last")) | F.col("v").isNotNull())
    moves = moves.groupBy(*own, "_last", "p").agg(F.sum("d").alias("d"), F.sum("v").alias("v0"))
    w = Window.partitionBy(*own).orderBy("p")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = moves.withColumn("slope", F.sum("d").over(upto)).withColumn("next", F.coalesce(F.lead("p").over(w), "_last"))
    runs = runs.withColumn("gain", F.col("slope") * (F.col("next") - F.col("p")))
    runs = runs.withColumn("v0", F.first("v0").over(upto)).withColumn("v", F.col("v0") + F.coalesce(F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tail = F.col("next") == F.col("_last")
    ends = runs.groupBy(*own).agg(
        F.greatest(F.max("v"), F.max(F.col("v") + F.col("gain"))).alias("hi"), F.least(F.min("v"), F.min(F.col("v") + F.col("gain"))).alias("lo"), F.max("v0").alias("a"), F.max(F.when(tail, F.col("v") + F.col("gain"))).alias("b")
    )
    # a flat run holds one value n times, a sloped one each of n neighbouring values once: steps of the values' counts
    n = F.col("next") - F.col("p") + F.when(tail, 1).otherwise(0)
    far = F.col("v") + F.col("slope") * (F.col("n") - 1)
    low, high, held = F.least("v", far), F.greatest("v", far), F.when(F.col("slope") == 0, F.col("n")).otherwise(1)
    counts = runs.withColumn("n", n).where("n > 0").select(*own, "_last", F.explode(F.array(F.struct(low.alias("x"), held.alias("d")), F.struct((high + 1).alias("x"), (-held).alias("d")))).alias("c"))
    counts = counts.groupBy(*own, "_last", F.col("c.x").alias("x")).agg(F.sum("c.d").alias("d"))
    by_value = Window.partitionBy(*own).orderBy("x")
    counts = counts.withColumn("each", F.sum("d").over(by_value.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.col("each") * (F.coalesce(F.lead("x").over(by_value), "x") - F.col("x"))).where("n > 0")
    counts = counts.withColumn("upto", F.sum("n").over(by_value.rowsBetween(Window.unboundedPreceding, 0)))

    def ranked(rank):
        inside = (F.expr(rank) < F.col("upto")) & (F.expr(rank) >= F.col("upto") - F.col("n"))
        return F.max(F.when(inside, F.col("x") + F.floor((F.expr(rank) - F.col("upto") + F.col("n")) / F.col("each"))))

    middle = counts.groupBy(*own).agg(((ranked("_last div 2") + ranked("(_last + 1) div 2")) / 2).alias("mid"))
    sides = ("hi", "lo", "a", "b", "mid")
    both = ends.withColumn("mid", F.lit(None).cast("double")).union(middle.select(*own, *[F.lit(None).cast("bigint").alias(c) for c in sides[:4]], "mid"))  # not joined: that would deal them anew, too
    out = both.groupBy(*own).agg(*[F.max(c).alias(c) for c in sides])
    out = out.select(*own, *[(c / window).alias(n) for n, c in zip(DENSITIES, (F.col("hi"), F.col("lo"), F.col("mid"), F.col("a"), F.col("b"), F.greatest("a", "b"), F.least("a", "b")), strict=True)])
    return out.union(short)


#: The pairs of category sets whose changes a feature matrix counts.
CROSSINGS = {"can_ncan": ({"canonical"}, {"noncanonical"}), "tel_sat": ({"canonical", "noncanonical"}, {"satellite"}), "arm_tel": ({"arm"}, {"canonical", "noncanonical", "ITS_TAR1"})}


def interspersion(rows: DataFrame, category: Column, pairs: dict[str, tuple[set, set]], keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Changes of category along each sequence, for each kilobase (half-even, two places): total over all rows; and for each named
    pair of category sets the changes between the two sets, among rows that are not other."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("start", "end")
    marked = rows.withColumn("_c", category).withColumn("_b", F.lag("_c").over(w))
    # the nearest earlier row that is not other
    marked = marked.withColumn("_t", F.last(F.when(F.col("_c") != "other", F.col("_c")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    crosses = [F.sum(F.when((F.col("_c") != "other") & ((F.col("_c").isin(sorted(a)) & F.col("_t").isin(sorted(b))) | (F.col("_c").isin(sorted(b)) & F.col("_t").isin(sorted(a)))), 1).otherwise(0)).alias(n) for n, (a, b) in pairs.items()]
    kb = (F.max("end") - F.min("start")) / 1000
    got = marked.groupBy(*keys).agg(F.sum(F.when(F.col("_c") != F.col("_b"), 1).otherwise(0)).alias("total"), *crosses, kb.alias("_kb"))
    return got.select(*keys, *[F.bround(F.col(n) / F.col("_kb"), 2).alias(n) for n in ("total", *pairs)])


def adaptive_thresholds(fractions: DataFrame, factor: float = FACTOR, least: float = LEAST, most: float = MOST, keys: Sequence[str] = ("feature_set",)) -> DataFrame:
    """keys, feature, threshold: the median non-zero share over the factor, held between least and most; with median_nonzero and n_nonzero."""
    found = fractions.where("frac > 0").groupBy(*keys, "feature").agg(F.percentile("frac", F.lit(0.5)).alias("median_nonzero"), F.count("*").alias("n_nonzero"))
    return found.withColumn("threshold", F.least(F.lit(most), F.greatest(F.lit(least), F.col("median_nonzero") / factor)))


#: The metrics of a feature matrix, by the pass that makes them.
METRICS = ("bp", "frac", *DENSITIES, "max_block_bp", "total_bp")


def long_metrics(rows: DataFrame, window: int = WINDOW, gap: int = GAP, metrics: Sequence[str] = METRICS, crossings: DataFrame | None = None) -> DataFrame:
    """seq_id, name ({featureset}__{metric}__{feature}), value: shares, lengths, densities and longest blocks of every label, and total
    lengths; only those of the metrics asked for are computed. crossings: a table of interspersion(), whose columns join as interspersion__{name}.
    All passes take tasks of so many rows, which are counted first: AQE's, by shuffled bytes, hold far more in sorts and aggregates."""
    keys, asked = ["feature_set", "seq_id"], set(metrics)
    n = tasks(rows)
    near = rows.repartition(n, "seq_id")

    def named(df, own):
        """All asked metrics of one table in a single pass over it."""
        own = [m for m in own if m in asked]
        long = df.select("feature_set", "seq_id", "feature", *[F.col(m).cast("double").alias(m) for m in own]).unpivot(["feature_set", "seq_id", "feature"], own, "metric", "value")
        return long.select("seq_id", F.concat_ws("__", "feature_set", "metric", "feature").alias("name"), "value")

    parts = []
    if asked & {"bp", "frac"}:
        parts.append(named(feature_fraction(near, keys), ("bp", "frac")))
    if asked & set(DENSITIES):
        parts.append(named(window_densities(rows, window, keys, n), DENSITIES))
    if "max_block_bp" in asked:
        parts.append(named(max_block(near, [*keys, "feature"], gap).withColumnRenamed("max_block", "max_block_bp"), ("max_block_bp",)))
    if "total_bp" in asked:
        totals = near.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).cast("double").alias("value"))
        parts.append(totals.select("seq_id", F.concat_ws("__", "feature_set", F.lit("total_bp")).alias("name"), "value"))
    if crossings is not None:
        own = [c for c in crossings.columns if c != "seq_id"]
        long = crossings.select("seq_id", *[F.col(c).cast("double").alias(c) for c in own]).unpivot(["seq_id"], own, "metric", "value")
        parts.append(long.select("seq_id", F.concat_ws("__", F.lit("interspersion"), "metric").alias("name"), "value"))
    if not parts:
        raise ValueError(f"metrics are {', '.join(METRICS)}")
    return reduce(DataFrame.union, parts)


def metrics_of(names: Sequence[str]) -> set[str]:
    """The metrics that columns of a feature matrix are named after."""
    return {part for n in names for part in n.split("__")[1:2]}


def wide_matrix(metrics: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """A row for each sequence, a column for each name, 0 where absent. Without names the column set is read first, in sorted order.
    The metrics are made once and written, then dealt by sequence to tasks of so many values."""
    metrics = written(metrics if names is None else metrics.where(F.col("name").isin(list(names))), "metrics")
    names = sorted(r[0] for r in metrics.select("name").distinct().collect()) if names is None else list(names)
    return dealt(metrics, "seq_id").groupBy("seq_id").pivot("name", names).agg(F.first("value")).na.fill(0.0)


def genome_weights(rows: DataFrame) -> DataFrame:
    """feature_set, feature, genome_bp, genome_fraction, info_content (-ln of the share, 0 for shares of 0 or 1) and weight (over the largest)."""
    shares = rows.groupBy("feature_set", "feature").agg(F.sum(F.col("end") - F.col("start")).alias("genome_bp"))
    shares = shares.withColumn("genome_fraction", F.col("genome_bp") / F.sum("genome_bp").over(Window.partitionBy("feature_set")))
    shares = shares.withColumn("info_content", F.when((F.col("genome_fraction") > 0) & (F.col("genome_fraction") < 1), -F.log("genome_fraction")).otherwise(0.0))
    top = F.max("info_content").over(Window.partitionBy())
    return shares.withColumn("weight", F.col("info_content") / F.when(top > 0, top).otherwise(1.0))


def document_weights(rows: DataFrame, floor: float = 0.1) -> DataFrame:
    """feature, weight: max(floor, 1 - share of sequences that hold the label), by the label's last layer."""
    layer = structural(F.col("feature"))
    n = rows.select("seq_id").distinct().agg(F.count("*").alias("n"))
    held = rows.select("seq_id", layer.alias("feature")).distinct().groupBy("feature").agg(F.count("*").alias("df"))
    return held.join(F.broadcast(n)).select("feature", F.greatest(F.lit(floor), 1 - F.col("df") / F.col("n")).alias("weight"))


def structural(feature: Column) -> Column:
    """The part after the first colon, or all."""
    return F.when(F.instr(feature, ":") > 0, F.substring(feature, F.instr(feature, ":") + 1, F.length(feature))).otherwise(feature)


def chromosome(feature: Column) -> Column:
    return F.when(F.instr(feature, ":") > 0, F.substring_index(feature, ":", 1)).otherwise("")


def category(feature: Column, roles) -> Column:
    """The interspersion category of a one- or two-layer label; roles has satellite, canonical, noncanonical, its_tar1, ct, arm."""
    first = F.substring_index(feature, ":", 1)
    second = F.when(F.instr(feature, ":") > 0, structural(feature)).otherwise("")
    tests = [(first, "satellite", "satellite"), *[(second, r, n) for r, n in (("canonical", "canonical"), ("noncanonical", "noncanonical"), ("its_tar1", "ITS_TAR1"))],
             *[(first, r, n) for r, n in (("canonical", "canonical"), ("noncanonical", "noncanonical"), ("its_tar1", "ITS_TAR1"), ("ct", "ct"), ("arm", "arm"))]]
    out = F.lit("other")
    for column, role, name in reversed(tests):
        out = F.when(roles.members(role, column), name).otherwise(out)
    return out


def density_bins(rows: DataFrame, size: int, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """keys, bin, n, level: marks touching each bin; none, low (1), medium (2 or 3), high."""
    hit = rows.select(*keys, F.explode(F.sequence(F.expr(f"start div {size}"), F.expr(f"(end - 1) div {size}"))).alias("bin"))
    n = hit.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return n.withColumn("level", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "low").when(F.col("n") <= 3, "medium").otherwise("high"))
