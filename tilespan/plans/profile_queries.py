"""Queries of cluster profiles: medians with counted zeros, statistics by quartiles, labels by the rule tree, representatives in two passes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import measures, profiles
from ..sources.binding import EV, OT, events, orders_tiling, table, track
from .catalogue import query

#: Orders as reads of a cluster, their customer's nation.
READS = "r AS (SELECT o_orderkey::VARCHAR AS seq_id, c_nationkey AS cluster_id FROM orders JOIN customer ON o_custkey = c_custkey)"


def reads(spark, sf):
    met = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return met.select(F.col("o_orderkey").cast("string").alias("seq_id"), F.col("c_nationkey").alias("cluster_id"))


@query(f"""WITH {OT}, {READS}, f AS (SELECT seq_id, feature, sum("end" - "start") AS bp FROM ot GROUP BY ALL), v AS (SELECT seq_id, feature, bp / sum(bp) OVER (PARTITION BY seq_id) AS v FROM f),
 p AS (SELECT DISTINCT cluster_id, feature FROM v JOIN r ON r.seq_id = v.seq_id)
 SELECT p.cluster_id, p.feature, round(quantile_cont(coalesce(v.v, 0), 0.5), 9) AS median, round(quantile_cont(coalesce(v.v, 0), 0.95), 9) AS high
 FROM p JOIN r ON r.cluster_id = p.cluster_id LEFT JOIN v ON v.seq_id = r.seq_id AND v.feature = p.feature GROUP BY ALL""")
def zero_padded_quantiles(spark, sf):
    """The median and the 95th percentile of each label's share over all reads of a cluster, those without the label too."""
    shares = measures.feature_fraction(orders_tiling(spark, sf), ["seq_id"])
    members = reads(spark, sf)
    own = shares.join(members, "seq_id").select("cluster_id", "feature", "frac")
    grid = own.select("cluster_id", "feature").distinct().join(members.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id")
    found = profiles.quantiles(own, ["cluster_id", "feature"], "frac", [0.5, 0.95], grid)
    at = lambda f: F.round(F.max(F.when(F.col("fraction") == f, F.col("quantile"))), 9)
    return found.groupBy("cluster_id", "feature").agg(at(0.5).alias("median"), at(0.95).alias("high"))



@query(f"""WITH {EV}, m AS (SELECT DISTINCT seq_id, right(seq_id, 1) AS cluster_id FROM ev), b AS (SELECT seq_id, type AS feature, sum("end" - "start")::DOUBLE AS v FROM ev WHERE band <> 'lo' OR type = 'view' GROUP BY ALL),
 v AS (SELECT seq_id, 'type__bp__' || feature AS name, v FROM b UNION ALL SELECT seq_id, 'type__dmax__' || feature, v / 1000 FROM b WHERE feature <> 'click' UNION ALL SELECT seq_id, 'type__max_block_bp__' || feature, v / 7 FROM b WHERE feature = 'click'),
 p AS (SELECT DISTINCT cluster_id, name FROM v JOIN m ON m.seq_id = v.seq_id), q AS (SELECT p.cluster_id, p.name, median(coalesce(v.v, 0)) AS q FROM p JOIN m ON m.cluster_id = p.cluster_id LEFT JOIN v ON v.seq_id = m.seq_id AND v.name = p.name GROUP BY ALL)
 SELECT cluster_id, name, CASE WHEN contains(name, 'dmax') THEN round_even(100 * q, 2) WHEN contains(name, 'block') THEN round_even(q, 0) ELSE round_even(q, 2) END AS value FROM q""")
def cluster_profile(spark, sf):
    """Profiles of users by their last digit: bases, densities in per cent and blocks."""
    ev = events(spark, sf)
    members = ev.select("seq_id", F.right("seq_id", F.lit(1)).alias("cluster_id")).distinct()
    b = measures.feature_bp(track(ev.where("band <> 'lo' or type = 'view'"), "type"), ["seq_id"]).withColumn("value", F.col("bp").cast("double"))
    named = lambda metric, value, rows: rows.select("seq_id", F.concat(F.lit(f"type__{metric}__"), "feature").alias("name"), value.alias("value"))
    values = named("bp", F.col("value"), b).union(named("dmax", F.col("value") / 1000, b.where("feature <> 'click'"))).union(named("max_block_bp", F.col("value") / 7, b.where("feature = 'click'")))
    return profiles.profile(values, members)


@query("""SELECT o_orderpriority, c_mktsegment, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev(o_totalprice), 6) AS std, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(median(o_totalprice), 6) AS median,
 round(quantile_cont(o_totalprice, 0.75), 6) AS q3, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr, CASE WHEN 100.0 / count(*) < 0.001 THEN '***' WHEN 100.0 / count(*) < 0.01 THEN '**' WHEN 100.0 / count(*) < 0.05 THEN '*' ELSE 'ns' END AS stars
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def statistics_table(spark, sf):
    met = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = met.withColumn("p", 100.0 / F.count("*").over(Window.partitionBy("o_orderpriority", "c_mktsegment")))
    got = profiles.statistics(rows, ["o_orderpriority", "c_mktsegment"], "o_totalprice", "p")
    return got.select("o_orderpriority", "c_mktsegment", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q1", "median", "q3", "iqr")], "stars")


#: What the supplier nations of a customer's lines stand for, by nation number: a metric and a label, and what a share of one means.
NAMES = (
    ("dfirst__canonical_telomere", 500), ("dlast__canonical_telomere", 500), ("dfirst__noncanonical_telomere", 200), ("dlast__noncanonical_telomere", 200), ("dterminal__canonical_telomere", 250), ("dterminal__noncanonical_telomere", 40),
    ("dmax__canonical_telomere", 500), ("dmax__noncanonical_telomere", 400), ("max_block_bp__canonical_telomere", 90000), ("dmax__ITS", 500), ("dmax__TAR1", 500), ("dmax__p_arm", 300), ("dmax__q_arm", 300), ("dmax__ct", 300),
    ("bppct__ct", 200), ("dmax__active", 400), ("dmax__mon", 400), ("dmax__HSat", 400), ("readpct__active_hor", 1500), ("readpct__active", 1500), ("readpct__HSat2", 1500), ("readpct__HSat3", 1500), ("dmax__gSat", 400), ("dmax__aSat", 400), ("dmax__rDNA", 400),
)


def _name(k: int) -> str:
    return ("acrocentric" if k == 24 else "tr") + "__" + NAMES[k][0]


_V = lambda metric, label, fs="tr": f"coalesce(max(v) FILTER (WHERE name = '{fs}__{metric}__{label}'), 0)"
SATELLITE_SQL = {"active aSat": ("active_hor", "active"), "monomeric aSat": ("mon",), "aSat": ("aSat",), "HSat": ("HSat",), "HSat2": ("HSat2",), "HSat3": ("HSat3",), "GSat": ("gSat",)}


def _top(metric: str) -> str:
    pairs = ", ".join(f"{{'w': coalesce({', '.join(f'nullif({_V(metric, x)}, 0)' for x in names)}, 0), 'k': {-k}, 's': '{shown}'}}" for k, (shown, names) in enumerate(SATELLITE_SQL.items()))
    return f"list_max([{pairs}])"


@query(f"""WITH n(k, name, f) AS (VALUES {", ".join(f"({k}, '{_name(k)}', {f})" for k, (_, f) in enumerate(NAMES))}),
 q AS (SELECT o_custkey AS cluster_id, s_nationkey AS k, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
 p AS (SELECT cluster_id, name, round(f * q / sum(q) OVER (PARTITION BY cluster_id), 2) AS v FROM q JOIN n ON n.k = q.k),
 w AS (SELECT cluster_id, {_V("dfirst", "canonical_telomere")} AS cf, {_V("dlast", "canonical_telomere")} AS cl, {_V("dfirst", "noncanonical_telomere")} AS nf, {_V("dlast", "noncanonical_telomere")} AS nl, {_V("dterminal", "canonical_telomere")} AS ct, {_V("dterminal", "noncanonical_telomere")} AS nt,
  {_V("dmax", "canonical_telomere")} AS cm, {_V("dmax", "noncanonical_telomere")} AS nm, {_V("max_block_bp", "canonical_telomere")} AS cb, {_V("dmax", "ITS")} AS its, {_V("dmax", "TAR1")} AS tar, greatest({_V("dmax", "p_arm")}, {_V("dmax", "q_arm")}) AS arm,
  {_V("dmax", "ct")} AS dc, {_V("bppct", "ct")} AS pc, {_V("dmax", "rDNA", "acrocentric")} AS rd, {_top("dmax")} AS s, {_top("readpct")} AS h FROM p GROUP BY cluster_id),
 b AS (SELECT *, (cf >= 70 OR nf >= 10) AND (cl >= 70 OR nl >= 10) AS both_ends, ct >= 15 OR nt >= 5 AS one, arm >= 30 OR pc >= 20 OR dc >= 35 AS has_arm,
  CASE WHEN nm > 25 THEN ['variant'] ELSE [] END AS m1, CASE WHEN s.w >= 35 THEN [s.s] ELSE [] END AS m2, CASE WHEN tar >= 35 AND its >= 35 THEN ['TAR1/ITS'] WHEN tar >= 35 THEN ['TAR1'] WHEN its >= 35 THEN ['ITS'] ELSE [] END AS m3,
  CASE WHEN rd >= 35 THEN ['rDNA'] ELSE [] END AS m4, CASE WHEN pc >= 20 OR dc >= 35 THEN ['SegDup'] ELSE [] END AS m5, CASE WHEN pc >= 20 THEN ['SegDup'] ELSE [] END AS m6 FROM w),
 l AS (SELECT cluster_id, CASE WHEN both_ends THEN 'both ends' WHEN one AND NOT has_arm THEN 'no arm' WHEN one AND cb >= 6000 THEN 'long block' WHEN one THEN 'one end' WHEN cm >= 35 OR nm >= 35 THEN 'inside' WHEN tar >= 35 OR its >= 35 THEN 'junction' WHEN h.w >= 80 THEN 'satellite' ELSE 'none' END AS rule,
  m1 || m2 || m3 || m4 || m5 AS marks, m2 || m4 || m6 AS few, h, tar, its FROM b),
 t AS (SELECT cluster_id, rule, CASE rule WHEN 'both ends' THEN 'ECTR' WHEN 'no arm' THEN 'ECTR' WHEN 'long block' THEN 'Type II ALT subtelomere' WHEN 'one end' THEN 'Subtelomere' WHEN 'inside' THEN 'Interstitial telomere'
  WHEN 'junction' THEN CASE WHEN tar >= 35 AND its >= 35 THEN 'Interstitial ITS/TAR1' WHEN tar >= its THEN 'Interstitial TAR1' ELSE 'Interstitial ITS' END WHEN 'satellite' THEN h.s ELSE '' END AS base,
  CASE WHEN rule IN ('satellite', 'none') THEN [] WHEN rule = 'junction' THEN few ELSE marks END AS marks FROM l)
 SELECT cluster_id, rule, base || CASE WHEN len(marks) = 0 THEN '' ELSE ' (' || array_to_string(marks, '-, ') || '-enriched)' END AS label FROM t""")
def tree_labels(spark, sf):
    """Labels of customers whose profile is what shares of their lines' supplier nations stand for."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    q = lines.groupBy(F.col("o_custkey").alias("cluster_id"), F.col("s_nationkey").alias("k")).agg(F.sum("l_quantity").alias("q"))
    name, factor = (F.element_at(F.array(*[F.lit(x) for x in values]), F.col("k") + 1) for values in ([_name(k) for k in range(len(NAMES))], [f for _, f in NAMES]))
    rows = q.select("cluster_id", name.alias("name"), F.round(factor * F.col("q") / F.sum("q").over(Window.partitionBy("cluster_id")), 2).alias("value"))
    return profiles.tree_labels(rows, "tr")


@query(f"""WITH {READS}, s AS (SELECT l_orderkey::VARCHAR AS read_id, sum(l_quantity)::BIGINT AS span, round(avg(l_discount) * 10, 6) AS score FROM lineitem GROUP BY ALL), x AS (SELECT cluster_id, read_id, span, score FROM s JOIN r ON r.seq_id = s.read_id),
 g AS (SELECT median(span) AS t FROM x), a AS (SELECT x.*, round(CASE WHEN score > 0 AND span > 0 THEN sqrt(score * greatest(0, 1 - abs(log2(span / t)) / 3)) ELSE 0 END, 12) AS c, abs(span - t) AS off FROM x, g),
 p AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, off, read_id) AS k FROM a), h AS (SELECT max(span) AS t FROM p WHERE k <= 3),
 b AS (SELECT cluster_id, read_id, score, round(CASE WHEN score > 0 AND span > 0 THEN sqrt(score * greatest(0, 1 - abs(log2(span / t)) / 3)) ELSE 0 END, 12) AS c, abs(span - t) AS off FROM p, h WHERE k <= 20),
 f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, off, read_id)::INTEGER AS rank FROM b) SELECT cluster_id, read_id, rank, score, round(c, 9) AS combined FROM f WHERE rank <= 3""")
def two_pass_representatives(spark, sf):
    """Three orders a nation: the score is the mean discount, the length the quantity."""
    own = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("read_id")).agg(F.sum("l_quantity").cast("bigint").alias("span"), F.round(F.avg("l_discount") * 10, 6).alias("score"))
    rows = own.join(reads(spark, sf).withColumnRenamed("seq_id", "read_id"), "read_id")
    return profiles.two_passes(rows, 3).withColumn("combined", F.round("combined", 9))
