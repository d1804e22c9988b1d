"""How closely labels occur together, and stratified tests of that between two samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .assembly import numbered

WINDOWS = (0, 1_000, 10_000, 50_000)


def min_gaps(rows: DataFrame, least: int = 0) -> DataFrame:
    """seq_id, feature_a, feature_b (in order), gap: the least distance of each pair of labels on a sequence, rows of least length at least counting.

    For every row and label the nearest earlier row of that label is the last one, so one window for each label of the
    vocabulary (some hundred at most) replaces the self-join, whose size is the square of a sequence's rows.
    """
    used = rows.where(F.col("end") - F.col("start") >= least)
    vocabulary = sorted(r[0] for r in used.select("feature").distinct().collect())
    before = Window.partitionBy("seq_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    if not vocabulary:
        return used.select("seq_id", F.col("feature").alias("feature_a"), F.col("feature").alias("feature_b"), F.col("start").alias("gap"))
    seen = used.select("seq_id", "feature", "start", *[F.max(F.when(F.col("feature") == v, F.col("end"))).over(before).alias(f"_w{k}") for k, v in enumerate(vocabulary)])
    last = F.array(*[F.struct(F.lit(v).alias("other"), F.col(f"_w{k}").alias("end")) for k, v in enumerate(vocabulary)])
    near = seen.select("seq_id", "feature", "start", F.explode(last).alias("l")).where("l.end is not null and l.other <> feature")
    gap = F.greatest(F.lit(0), F.col("start") - F.col("l.end"))
    return near.groupBy("seq_id", F.least("feature", "l.other").alias("feature_a"), F.greatest("feature", "l.other").alias("feature_b")).agg(F.min(gap).alias("gap"))


def read_spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("seq_id").agg((F.max("end") - F.min("start")).alias("span"))


def length_bucket(span: Column, boundaries: Sequence[int]) -> Column:
    """How many boundaries the span reaches."""
    out = F.lit(0)
    for b in boundaries:
        out = out + F.when(span >= b, 1).otherwise(0)
    return out


def support(gaps: DataFrame, spans: DataFrame, windows: Sequence[int] = WINDOWS, boundaries: Sequence[int] = ()) -> tuple[DataFrame, DataFrame]:
    """bucket, feature_a, feature_b, window, support; and bucket, total (sequences)."""
    bucketed = spans.withColumn("bucket", length_bucket(F.col("span"), boundaries))
    at = gaps.join(bucketed.select("seq_id", "bucket"), "seq_id").withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows])))
    found = at.groupBy("bucket", "feature_a", "feature_b", "window").agg(F.count_if(F.col("gap") <= F.col("window")).alias("support"))
    return found, bucketed.groupBy("bucket").agg(F.count("*").alias("total"))


def pooled_rate(found: DataFrame, totals: DataFrame) -> DataFrame:
    """feature_a, feature_b, window, rate: support over all sequences."""
    n = totals.agg(F.sum("total").alias("n"))
    return found.groupBy("feature_a", "feature_b", "window").agg(F.sum("support").alias("support")).join(F.broadcast(n)).select("feature_a", "feature_b", "window", F.coalesce(F.try_divide("support", "n"), F.lit(0.0)).alias("rate"))


def stratified(experiment, control, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Cochran-Mantel-Haenszel over length buckets, for every pair seen in the experiment and every window: supports, totals, statistic and odds ratio.

    experiment and control are (support, totals) tables. Strata of under two sequences count for nothing; the statistic has the
    usual correction of one half and is null without information.
    """
    (es, et), (cs, ct) = experiment, control
    cells = ["feature_a", "feature_b", "window"]
    pairs = es.select("feature_a", "feature_b").distinct().withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows])))
    strata = et.withColumnRenamed("total", "et").join(ct.withColumnRenamed("total", "ct"), "bucket", "full").na.fill(0)
    grid = pairs.join(F.broadcast(strata))  # length buckets: as many as boundaries, and one
    full = grid.join(es.withColumnRenamed("support", "es"), ["bucket", *cells], "left").join(cs.withColumnRenamed("support", "cs"), ["bucket", *cells], "left").na.fill(0, ["es", "cs"])
    a, b, c, d = F.col("es").cast("double"), (F.col("et") - F.col("es")).cast("double"), F.col("cs").cast("double"), (F.col("ct") - F.col("cs")).cast("double")
    n = a + b + c + d
    use = n >= 2

    def total(x):
        return F.sum(F.when(use, x).otherwise(0.0))

    got = full.groupBy(*cells).agg(
        F.sum("es").alias("exp_support"), F.sum("et").alias("exp_total"), F.sum("cs").alias("ctrl_support"), F.sum("ct").alias("ctrl_total"),
        total(a).alias("sa"), total((a + b) * (a + c) / n).alias("se"), total((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("sv"), total(a * d / n).alias("up"), total(b * c / n).alias("down"),
    )
    got = got.withColumn("statistic", F.when(F.col("sv") > 0, F.pow(F.abs(F.col("sa") - F.col("se")) - 0.5, F.lit(2.0)) / F.col("sv")))
    odds = F.when(F.col("down") > 0, F.try_divide("up", "down")).when(F.col("up") > 0, float("inf")).otherwise(float("nan"))
    return got.withColumn("odds_ratio", odds).drop("sa", "se", "sv", "up", "down")


@F.pandas_udf(DoubleType())
def chi2_tail(statistic: pd.Series) -> pd.Series:
    """P(chi-squared of one degree > statistic); 1 for null."""
    kinds, where = np.unique(np.maximum(np.nan_to_num(statistic.to_numpy(float)), 0.0), return_inverse=True)  # few different ones
    return pd.Series(np.array([math.erfc(math.sqrt(x / 2)) for x in kinds])[where])


def harmonic(n: int) -> float:
    """1 + 1/2 + ... + 1/n; beyond a million terms by its expansion."""
    return sum(1 / i for i in range(1, n + 1)) if n < 1 << 20 else math.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n)


def adjusted(rows: DataFrame, p: str = "p_value", order: Sequence[str] = (), dependent: bool = False, block: int = 1 << 16) -> DataFrame:
    """rows with q_value, the step-up adjusted p-value over the whole table (Benjamini-Hochberg; dependent: Benjamini-Yekutieli).

    Tests are ranked by ranges of p, and the running least from the largest p down is taken in blocks of ranks: each block's own,
    and the least of all later blocks, of which there are few. Ties of p: by order; equal p have equal q. Null p take no part and have a null q.
    """
    placed = numbered(rows.where(F.col(p).isNotNull()), [F.col(p), *[F.col(o) for o in order]])
    n = placed.count()
    raw = F.col(p) * n / (F.col("n") + 1) * (harmonic(n) if dependent else 1.0)
    placed = placed.withColumn("_raw", F.least(F.lit(1.0), raw)).withColumn("_block", F.expr(f"n div {block}"))
    later = placed.groupBy("_block").agg(F.min("_raw").alias("_m"))
    later = later.select("_block", F.min("_m").over(Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))  # one row a block
    down = Window.partitionBy("_block").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    got = placed.join(F.broadcast(later), "_block").withColumn("q_value", F.least(F.min("_raw").over(down), "_later"))
    return got.select(*rows.columns, "q_value").unionByName(rows.where(F.col(p).isNull()).withColumn("q_value", F.lit(None).cast("double")))


def log2_ratio() -> Column:
    rate = lambda s, t: (F.col(s) + 0.5) / (F.col(t) + 1)
    return F.log2(rate("exp_support", "exp_total") / rate("ctrl_support", "ctrl_total"))


#: The columns of a table of calls, in order.
CALL = ("feature_a", "feature_b", "window", "exp_support", "exp_total", "exp_rate", "ctrl_support", "ctrl_total", "ctrl_rate", "ref_rate", "log2_ratio", "odds_ratio", "p_value", "q_value", "direction", "reference_abnormal", "passes")


def detect(experiment, control, reference=None, windows: Sequence[int] = WINDOWS, min_support: int = 3, min_log2: float = 1.0, alpha: float = 0.05, eps: float = 0.0) -> DataFrame:
    """All tested (pair, window) calls with p, q, rates, effect, direction and passes; passing ones first, then by q, pair and window."""
    cells = ["feature_a", "feature_b", "window"]
    got = stratified(experiment, control, windows).withColumn("p_value", chi2_tail("statistic"))
    got = adjusted(got, order=cells)
    rate = lambda s, t: F.coalesce(F.try_divide(F.col(s), F.col(t)), F.lit(0.0))
    got = got.withColumn("exp_rate", rate("exp_support", "exp_total")).withColumn("ctrl_rate", rate("ctrl_support", "ctrl_total")).withColumn("log2_ratio", log2_ratio())
    if reference is None:
        got = got.withColumn("ref_rate", F.lit(0.0))
    else:
        got = got.join(pooled_rate(*reference).withColumnRenamed("rate", "ref_rate"), cells, "left").na.fill(0.0, ["ref_rate"])
    above = F.greatest("exp_rate", "ctrl_rate") > F.col("ref_rate") + eps
    got = got.withColumn("direction", F.when(F.col("exp_rate") >= F.col("ctrl_rate"), "enriched").otherwise("depleted")).withColumn("reference_abnormal", above)
    got = got.withColumn("passes", (F.col("q_value") <= alpha) & (F.greatest("exp_support", "ctrl_support") >= min_support) & (F.abs("log2_ratio") >= min_log2) & above)
    return got.orderBy(F.desc("passes"), "q_value", *cells)


