"""Cluster profiles: exact quantiles with counted zeros, labels by a rule tree over medians, and representatives chosen in two passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .assembly import numbered


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], sizes: DataFrame | None = None) -> DataFrame:
    """keys, fraction, quantile (linear between ranks) of a value in each group.

    sizes (keys, n): how many members each group has; those without a row, or with 0, count as zeros that are never stored. All
    values are laid in one order in ranges and numbered, so a group of any size is many tasks' work; each quantile is two ranks
    looked up by number. Null values take no part. A group of sizes without rows has zeros only; groups that sizes lacks are left out.
    """
    keys = list(keys)
    kept = rows.where(F.col(value).isNotNull() if sizes is None else F.col(value) != 0).select(*keys, F.col(value).cast("double").alias("_v"))
    placed = numbered(kept, [*keys, "_v"])
    shape = placed.groupBy(*keys).agg(F.min("n").alias("_first"), F.count("*").alias("_c"), F.count_if(F.col("_v") < 0).alias("_neg"))
    if sizes is None:
        shape = shape.withColumn("_n", F.col("_c"))
    else:
        shape = sizes.select(*keys, F.col("n").alias("_n")).join(shape, keys, "left").na.fill(0, ["_first", "_c", "_neg"])
    shape = shape.withColumn("_zeros", F.greatest(F.lit(0), F.col("_n") - F.col("_c"))).where("_n > 0")
    asked = shape.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("_at", F.col("fraction") * (F.col("_n") - 1))
    low = F.floor("_at")
    asked = asked.withColumn("_r", F.explode(F.array(F.struct(low.alias("k"), (1 - (F.col("_at") - low)).alias("w")), F.struct((low + 1).alias("k"), (F.col("_at") - low).alias("w"))))).where("_r.w > 0")
    stored = F.when(F.col("_r.k") < F.col("_neg"), F.col("_first") + F.col("_r.k")).when(F.col("_r.k") >= F.col("_neg") + F.col("_zeros"), F.col("_first") + F.col("_r.k") - F.col("_zeros"))
    asked = asked.select(*keys, "fraction", F.col("_r.w").alias("_w"), stored.alias("_place"))
    found = asked.join(placed.select(F.col("n").alias("_place"), "_v"), "_place", "left")
    return found.groupBy(*keys, "fraction").agg(F.sum(F.col("_w") * F.coalesce("_v", F.lit(0.0))).alias("quantile"))


#: Metrics that a profile gives in per cent, and those of whole bases.
PER_CENT, BASES = ("dmax", "dmin", "dmedian", "dfirst", "dlast", "dterminal", "dterminal_min"), ("max_block_bp",)


def profile(values: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, name, value: the median over all of a cluster's members (cluster_id, seq_id) of every metric (seq_id, name, value; names as in
    measures.long_metrics, absent ones 0), densities in per cent with two places, blocks in whole bases, others with two places. Names that no member has are left out."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    own = values.join(members, "seq_id").where("value <> 0")
    grid = own.select("cluster_id", "name").distinct().join(sizes, "cluster_id")
    middle = quantiles(own, ["cluster_id", "name"], "value", [0.5], grid)
    metric = F.element_at(F.split("name", "__"), 2)
    value = F.when(metric.isin(*PER_CENT), F.bround(100 * F.col("quantile"), 2)).when(metric.isin(*BASES), F.bround("quantile", 0)).otherwise(F.bround("quantile", 2))
    return middle.select("cluster_id", "name", value.alias("value"))


def statistics(rows: DataFrame, keys: Sequence[str], value: str, p_value: str | None = None) -> DataFrame:
    """keys, n, mean, std, q1, median, q3, iqr of a value by group; p_value names a column of rows that is one to a group, which adds it with its stars."""
    keys = list(keys)
    quarter = quantiles(rows, keys, value, [0.25, 0.5, 0.75])
    cuts = quarter.groupBy(*keys).agg(*[F.max(F.when(F.col("fraction") == f, F.col("quantile"))).alias(n) for f, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    kept = rows.where(F.col(value).isNotNull())
    more = [] if p_value is None else [F.max(p_value).alias("p")]
    out = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("std"), *more).join(cuts, keys).withColumn("iqr", F.col("q3") - F.col("q1"))
    return out if p_value is None else out.withColumn("stars", stars(F.col("p")))


def stars(p: Column) -> Column:
    """The marks of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


#: Satellites in the order in which ties are settled, as shown: label (and the label of the older vocabulary, where it differs).
SATELLITES = {
    "active aSat": ("active_hor", "active"), "monomeric aSat": ("mon", "monomeric"), "aSat": ("aSat",), "alpha HOR": ("alpha_hor",), "HOR": ("hor",), "divergent HOR": ("dhor",), "mixed alpha": ("mixedAlpha",), "bSat": ("bSat",), "CenSat": ("cenSat",),
    "centromeric": ("centromeric",), "HSat": ("HSat",), "HSat1": ("HSat1",), "HSat1A": ("HSat1A",), "HSat1B": ("HSat1B",), "HSat2": ("HSat2",), "HSat3": ("HSat3",), "GSat": ("gSat",),
}
#: The thresholds of the labels, in per cent and bases.
LIMITS = {"both_canonical": 70, "both_noncanonical": 10, "end_canonical": 15, "end_noncanonical": 5, "present": 35, "variant": 25, "dominant": 80, "duplicated": 20, "block": 6000, "arm": 30}


class Profile:
    """The columns of a profile laid wide: of(metric, label) is 0 where the profile has no such name."""

    def __init__(self, rows: DataFrame, feature_set: str, acrocentric: str = "acrocentric"):
        self.names: dict[tuple[str, str, str], str] = {}
        self.feature_set, self.acrocentric = feature_set, acrocentric
        self.rows = rows

    def of(self, metric: str, label: str, feature_set: str | None = None) -> Column:
        key = (feature_set or self.feature_set, metric, label)
        return F.col(self.names.setdefault(key, f"_m{len(self.names)}"))

    def satellite(self, metric: str, shown: str) -> Column:
        first = F.lit(0.0)
        for label in reversed(SATELLITES[shown]):
            first = F.when(self.of(metric, label) != 0, self.of(metric, label)).otherwise(first)
        return first

    def highest(self, metric: str) -> Column:
        """(w, shown) of the satellite that is highest, the first of equal ones."""
        return F.greatest(*[F.struct(self.satellite(metric, shown).alias("w"), F.lit(-k).alias("k"), F.lit(shown).alias("shown")) for k, shown in enumerate(SATELLITES)])

    def wide(self) -> DataFrame:
        """A row a cluster with every column asked for so far: one aggregation."""
        name = {c: "__".join(key) for key, c in self.names.items()}
        return self.rows.groupBy("cluster_id").agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0)).alias(c) for c, n in name.items()])


def qualified(base: Column, marks: list[tuple[Column, Column]]) -> Column:
    """base with its marks (condition, name) in brackets, all but the last with a hyphen."""
    names = F.array_compact(F.array(*[F.when(met, name) for met, name in marks]))
    return F.concat(base, F.when(F.size(names) == 0, "").otherwise(F.concat(F.lit(" ("), F.array_join(names, "-, "), F.lit("-enriched)"))))


def tree_labels(rows: DataFrame, feature_set: str, limits: dict[str, float] = LIMITS) -> DataFrame:
    """cluster_id, label, rule: structural labels by a tree over a profile (cluster_id, name, value, in per cent; readpct and bppct too).

    Where telomere stands decides first: at both ends or at one without an arm beyond it, at one end, inside; then ITS and TAR1, then a
    satellite that most reads hold. What else is abundant stands in brackets. rule names the leaf; label is empty where none applies.
    """
    x, least = Profile(rows, feature_set), {k: F.lit(float(v)) for k, v in limits.items()}
    can, non = "canonical_telomere", "noncanonical_telomere"

    def telomeric(metric, kind):
        return (x.of(metric, can) >= least[f"{kind}_canonical"]) | (x.of(metric, non) >= least[f"{kind}_noncanonical"])

    def high(label, feature_set=None):
        return x.of("dmax", label, feature_set) >= least["present"]

    both, one = telomeric("dfirst", "both") & telomeric("dlast", "both"), telomeric("dterminal", "end")
    share = x.of("bppct", "ct") >= least["duplicated"]
    duplicated = share | high("ct")
    arm = (x.of("dmax", "p_arm") >= least["arm"]) | (x.of("dmax", "q_arm") >= least["arm"]) | duplicated
    tar1, its, rdna = high("TAR1"), high("ITS"), high("rDNA", x.acrocentric)
    top, held = F.col("_top"), F.col("_held")
    satellite = (top["w"] >= least["present"], top["shown"])
    junction = F.when(tar1 & its, "TAR1/ITS").when(tar1, "TAR1").otherwise("ITS")
    marks = [(x.of("dmax", non) > least["variant"], F.lit("variant")), satellite, (tar1 | its, junction), (rdna, F.lit("rDNA")), (duplicated, F.lit("SegDup"))]
    inner = F.when(tar1 & its, "Interstitial ITS/TAR1").when(x.of("dmax", "TAR1") >= x.of("dmax", "ITS"), "Interstitial TAR1").otherwise("Interstitial ITS")
    leaves = [
        ("both ends", both, qualified(F.lit("ECTR"), marks)),
        ("no arm", one & ~arm, qualified(F.lit("ECTR"), marks)),
        ("long block", one & (x.of("max_block_bp", can) >= least["block"]), qualified(F.lit("Type II ALT subtelomere"), marks)),
        ("one end", one, qualified(F.lit("Subtelomere"), marks)),
        ("inside", high(can) | high(non), qualified(F.lit("Interstitial telomere"), marks)),
        ("junction", tar1 | its, qualified(inner, [satellite, (rdna, F.lit("rDNA")), (share, F.lit("SegDup"))])),
        ("satellite", held["w"] >= least["dominant"], held["shown"]),
    ]
    label, rule = F.lit(""), F.lit("none")
    for name, met, shown in reversed(leaves):
        label, rule = F.when(met, shown).otherwise(label), F.when(met, name).otherwise(rule)
    top_, held_ = x.highest("dmax"), x.highest("readpct")
    return x.wide().withColumns({"_top": top_, "_held": held_}).select("cluster_id", label.alias("label"), rule.alias("rule"))


#: The weights of the terms of a read's score, for all clusters, for those of telomere at both ends, and for those named after a satellite.
WEIGHTS = {
    "": {"terminal": 0.30, "dmax": 0.20, "block": 0.15, "interspersion": 0.15, "bppct": 0.10, "enrichment": 0.10},
    "ectr": {"terminal": 0.35, "dmax": 0.15, "block": 0.15, "interspersion": 0.15, "bppct": 0.10, "enrichment": 0.10},
    "satellite": {"terminal": 0.10, "dmax": 0.15, "block": 0.10, "interspersion": 0.10, "bppct": 0.35, "enrichment": 0.20},
}
#: What marks a label as a satellite's, what a profile needs for a term to ask about a label (shares, bases), and the least denominator.
SATELLITE_NAMES, ASKS, LEAST = "aSat|bSat|CenSat|HSat|GSat", {"dmax": 0.05, "block": 100.0, "bppct": 0.01, "enrichment": 0.20}, 1e-6


def read_scores(values: DataFrame, members: DataFrame, profiles: DataFrame, labels: DataFrame, feature_set: str) -> DataFrame:
    """cluster_id, seq_id, score (four places): how near each member's metrics come to its cluster's profile.

    Six terms, each the mean nearness over what it asks about: telomere at the ends (both kinds, always), interspersion rates (always),
    and over labels of the profile their greatest density, longest block and share (only labels that the read shows) and the greatest density of
    satellites, ITS and TAR1. A term that asks about nothing is a half. Weights follow the cluster's label (labels: cluster_id, label).
    """
    part = F.split("name", "__")
    own = profiles.where(part[0] == feature_set).select("cluster_id", part[1].alias("metric"), part[2].alias("feature"), "value")
    shares = own.withColumn("value", F.when(F.col("metric").isin(*BASES), F.col("value")).otherwise(F.col("value") / 100))
    enriched = sorted({x for names in SATELLITES.values() for x in names} | {"ITS", "TAR1"})
    term = lambda name, metric, read, extra=None: shares.where((F.col("metric") == metric) & (F.col("value") > ASKS[name]) & (F.lit(True) if extra is None else extra)).select("cluster_id", F.lit(name).alias("term"), F.lit(read).alias("metric"), "feature", F.col("value").alias("c"), F.lit(extra is None).alias("shown"))
    ends = [(m, f) for f in ("canonical_telomere", "noncanonical_telomere") for m in ("dfirst", "dlast", "dterminal")]
    always = [("terminal", m, f) for m, f in ends] + [("interspersion", "interspersion", n) for n in ("total", "can_ncan", "tel_sat", "arm_tel")]
    fixed = members.select("cluster_id").distinct().withColumn("_a", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(m).alias("metric"), F.lit(f).alias("feature")) for t, m, f in always]))).select("cluster_id", "_a.*")
    rates = profiles.where(part[0] == "interspersion").select("cluster_id", F.lit("interspersion").alias("metric"), part[1].alias("feature"), F.col("value").alias("c"))
    known = shares.where(F.col("metric").isin("dfirst", "dlast", "dterminal")).select("cluster_id", "metric", "feature", F.col("value").alias("c")).union(rates)
    fixed = fixed.join(known, ["cluster_id", "metric", "feature"], "left").select("cluster_id", "term", "metric", "feature", F.coalesce("c", F.lit(0.0)).alias("c"), F.lit(False).alias("shown"))
    asked = fixed.union(term("dmax", "dmax", "dmax")).union(term("block", "max_block_bp", "max_block_bp")).union(term("bppct", "bppct", "dmedian")).union(term("enrichment", "dmax", "dmax", F.col("feature").isin(*enriched)))

    mine = values.where(part[0].isin(feature_set, "interspersion") & (F.col("value") != 0))
    inter = part[0] == "interspersion"
    mine = mine.select("seq_id", F.when(inter, "interspersion").otherwise(part[1]).alias("metric"), F.when(inter, part[1]).otherwise(part[2]).alias("feature"), F.col("value").alias("r"))
    has = mine.where(F.col("metric").isin(*PER_CENT, *BASES)).select("seq_id", "feature").distinct().withColumn("_has", F.lit(True))
    grid = members.select("cluster_id", "seq_id").join(asked, "cluster_id").join(has, ["seq_id", "feature"], "left").where(~F.col("shown") | F.coalesce("_has", F.lit(False)))
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.coalesce("r", F.lit(0.0)) - F.col("c")) / F.greatest(F.abs("c"), F.lit(LEAST)))
    terms = grid.join(mine, ["seq_id", "metric", "feature"], "left").groupBy("cluster_id", "seq_id").agg(*[F.coalesce(F.avg(F.when(F.col("term") == t, near)), F.lit(0.5)).alias(t) for t in WEIGHTS[""]])
    kind = F.when(F.col("label").startswith("ECTR"), "ectr").when(F.col("label").rlike(SATELLITE_NAMES), "satellite").otherwise("")
    total = {k: sum((F.col(t) * v for t, v in own_weights.items()), F.lit(0.0)) for k, own_weights in WEIGHTS.items()}
    scored = terms.join(labels.select("cluster_id", kind.alias("_kind")), "cluster_id", "left")
    return scored.select("cluster_id", "seq_id", F.bround(F.when(F.col("_kind") == "ectr", total["ectr"]).when(F.col("_kind") == "satellite", total["satellite"]).otherwise(total[""]), 4).alias("score"))


def _nearness(span: str, target: str, doublings: float = 3.0) -> Column:
    """1 at the target length, 0 at doublings away or without a length."""
    met = (F.col(span) > 0) & (F.col(target) > 0)
    return F.when(met, F.greatest(F.lit(0.0), 1 - F.abs(F.log2(F.col(span) / F.col(target))) / doublings)).otherwise(0.0)


def two_passes(rows: DataFrame, n: int) -> DataFrame:
    """cluster_id, read_id, rank, score, combined: n representatives a cluster, from rows (cluster_id, read_id, span, score).

    combined is the geometric mean of score and nearness in length to a target. The first pass has the median length of all reads as its
    target and keeps max(20, 5 n) candidates a cluster; the longest of its n best over all clusters is the second pass's target, by which
    candidates are ranked anew. Ties: nearer in bases to the target, then read_id. Reads of no length, or no score, come last with combined 0.
    Of a cluster of any size each range of reads sends its candidates only.
    """

    def ranked(table: DataFrame, target: DataFrame) -> DataFrame:
        met = table.crossJoin(F.broadcast(target))  # one row
        combined = F.when(F.col("score") > 0, F.sqrt(F.col("score") * _nearness("span", "_target"))).otherwise(0.0)
        return met.withColumn("combined", F.round(combined, 12)).withColumn("_off", F.abs(F.coalesce("span", F.lit(0)) - F.col("_target"))).drop("_target")

    order = [F.desc("combined"), F.asc("_off"), F.asc("read_id")]
    keep = max(20, 5 * n)
    middle = quantiles(rows.withColumn("_all", F.lit(0)), ["_all"], "span", [0.5]).select(F.col("quantile").alias("_target"))
    part = Window.partitionBy("cluster_id", F.pmod(F.xxhash64("read_id"), F.lit(64))).orderBy(*order)
    near = ranked(rows.select("cluster_id", "read_id", "span", "score"), middle).withColumn("_p", F.row_number().over(part)).where(F.col("_p") <= keep)
    every = Window.partitionBy("cluster_id").orderBy(*order)
    pool = near.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= keep)
    longest = pool.where((F.col("rank") <= n) & (F.col("span") > 0)).agg(F.max("span").alias("_l"))
    target = longest.crossJoin(F.broadcast(middle)).select(F.coalesce("_l", "_target").alias("_target"))
    again = ranked(pool.drop("combined", "_off", "rank", "_p"), target)
    return again.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= n).select("cluster_id", "read_id", "rank", "score", "combined")
