"""Queries of the older operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choose, clusters, colocalization, legacy, measures, merges
from ..sources.binding import EV, OT, events, orders_tiling, runs_sql, table, track
from .catalogue import query

BIGRAMS = f"""WITH {EV}, b AS (SELECT seq_id, type AS f, "end" - "start" AS l, lead(type) OVER w AS g, lead("end" - "start") OVER w AS m FROM ev WINDOW w AS (PARTITION BY seq_id ORDER BY "start"))"""


@query(BIGRAMS + " SELECT seq_id, f || '->' || g AS edge, count(*) AS n, sum(l)::DOUBLE AS weight FROM b WHERE g <> f GROUP BY ALL")
def bigrams_directional(spark, sf):
    return legacy.bigrams(track(events(spark, sf), "type"))


@query(BIGRAMS + " SELECT seq_id, least(f, g) || '->' || greatest(f, g) AS edge, count(*) AS n, sum((l + m) / 2)::DOUBLE AS weight FROM b WHERE g <> f GROUP BY ALL")
def bigrams_symmetric(spark, sf):
    return legacy.bigrams(track(events(spark, sf), "type"), True)


MATRIX = BIGRAMS + """, c AS (SELECT seq_id, 'edge' AS block, f || '->' || g AS name, count(*)::DOUBLE AS n FROM b WHERE g <> f GROUP BY ALL UNION ALL SELECT seq_id, 'abundance', f, sum(l)::DOUBLE FROM b GROUP BY ALL),
 s AS (SELECT block, name, sum(ln(1 + n)) / (SELECT count(DISTINCT seq_id) FROM ev) AS mean, sum(ln(1 + n) ** 2) / (SELECT count(DISTINCT seq_id) FROM ev) AS sq FROM c GROUP BY ALL)"""


@query(MATRIX + " SELECT seq_id, c.block, c.name, round((ln(1 + n) - mean) / sqrt(sq - mean * mean), 6) AS value FROM c JOIN s ON s.block = c.block AND s.name = c.name")
def matrix_log1p_z(spark, sf):
    m = legacy.long_matrix(track(events(spark, sf), "type"))
    return m.select("seq_id", "block", "name", F.round("value", 6).alias("value"))


@query(MATRIX + " SELECT seq_id, block, name, n / (SELECT max(\"end\") FROM ev e WHERE e.seq_id = c.seq_id) AS value FROM c WHERE block = 'abundance'")
def matrix_length_weighted(spark, sf):
    m = legacy.long_matrix(track(events(spark, sf), "type"), "length_weighted", edges=False)
    return m.select("seq_id", "block", "name", "value")


FISHER = """WITH m AS (SELECT c_nationkey AS cluster_id, o_orderstatus AS g FROM orders JOIN customer ON o_custkey = c_custkey),
 e AS (SELECT cluster_id, g, count(*) AS n FROM m GROUP BY ALL), gt AS (SELECT g, sum(n) AS t FROM e GROUP BY g),
 o0 AS (SELECT cluster_id, coalesce(sum(n) FILTER (WHERE g = 'F'), 0) AS a, coalesce(arg_max(g, (n, -ascii(g))) FILTER (WHERE g <> 'F'), 'F') AS og FROM e GROUP BY cluster_id),
 x AS (SELECT o0.cluster_id, a::BIGINT AS a, coalesce(e.n, 0)::BIGINT AS b, ((SELECT t FROM gt WHERE g = 'F') - a)::BIGINT AS c, (gt.t - coalesce(e.n, 0))::BIGINT AS d, og, ((SELECT t FROM gt WHERE g = 'F'))::BIGINT AS col, ((SELECT t FROM gt WHERE g = 'F') + gt.t)::BIGINT AS tot, (a + coalesce(e.n, 0))::BIGINT AS rw
   FROM o0 JOIN gt ON gt.g = og LEFT JOIN e ON e.cluster_id = o0.cluster_id AND e.g = og),
 k AS (SELECT *, unnest(range(greatest(0, rw + col - tot)::BIGINT, least(rw, col)::BIGINT + 1)) AS k FROM x),
 l AS (SELECT *, lgamma(col + 1) - lgamma(k + 1) - lgamma(col - k + 1) + lgamma(tot - col + 1) - lgamma(rw - k + 1) - lgamma(tot - col - rw + k + 1) - (lgamma(tot + 1) - lgamma(rw + 1) - lgamma(tot - rw + 1)) AS lp FROM k),
 o AS (SELECT cluster_id, max(lp) FILTER (WHERE k = a) AS obs FROM l GROUP BY cluster_id)"""


@query(FISHER + """ SELECT l.cluster_id, max(a) AS control_in, max(b) AS treatment_in, max(og) AS treatment, round(max(a * d / (b * c)), 6) AS odds_ratio, round(least(1, sum(exp(lp)) FILTER (WHERE lp <= obs + 1e-7)), 6) AS p_value FROM l JOIN o ON l.cluster_id = o.cluster_id GROUP BY l.cluster_id""")
def fisher_two_group(spark, sf):
    m = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("cluster_id"), F.col("o_orderstatus").alias("group"))
    return legacy.fisher_two_group(m, "F").select("cluster_id", "control_in", "treatment_in", "treatment", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("p_value", 6).alias("p_value"))


PER_SAMPLE = """WITH m AS (SELECT c_nationkey AS cluster_id, o_orderpriority AS sample, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 g AS (SELECT c.cluster_id, s.sample, coalesce(m.n, 0) AS a, s.t FROM (SELECT DISTINCT cluster_id FROM m) c CROSS JOIN (SELECT sample, sum(n) AS t FROM m GROUP BY sample) s LEFT JOIN m ON m.cluster_id = c.cluster_id AND m.sample = s.sample),
 x AS (SELECT *, (sum(a) OVER (PARTITION BY cluster_id))::BIGINT AS rw, (sum(t) OVER (PARTITION BY cluster_id))::BIGINT AS tot FROM g),
 k AS (SELECT *, unnest(range(a, least(rw, t)::BIGINT + 1)) AS k FROM x),
 l AS (SELECT cluster_id, sample, a, exp(lgamma(t + 1) - lgamma(k + 1) - lgamma(t - k + 1) + lgamma(tot - t + 1) - lgamma(rw - k + 1) - lgamma(tot - t - rw + k + 1) - (lgamma(tot + 1) - lgamma(rw + 1) - lgamma(tot - rw + 1))) AS p FROM k)"""


@query(PER_SAMPLE + " SELECT cluster_id, sample, max(a)::BIGINT AS n, round(least(1, sum(p)), 6) AS p_value FROM l GROUP BY cluster_id, sample")
def fisher_per_sample(spark, sf):
    m = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("cluster_id"), F.col("o_orderpriority").alias("sample"))
    return legacy.fisher_per_sample(m).withColumn("p_value", F.round("p_value", 6))


@query(PER_SAMPLE + """, p AS (SELECT cluster_id, sample, least(1, sum(p)) AS p FROM l GROUP BY cluster_id, sample), r AS (SELECT *, row_number() OVER (ORDER BY p, cluster_id, sample) AS r, count(*) OVER () AS n FROM p),
 y AS (SELECT *, least(1, p * n / r * (SELECT sum(1 / i) FROM range(1, (SELECT count(*) FROM p) + 1) t(i))) AS raw FROM r)
 SELECT cluster_id, sample, round(min(raw) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 5) AS q_value FROM y""")
def fdr_by(spark, sf):
    m = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("cluster_id"), F.col("o_orderpriority").alias("sample"))
    return colocalization.adjusted(legacy.fisher_per_sample(m), order=["cluster_id", "sample"], dependent=True).select("cluster_id", "sample", F.round("q_value", 5).alias("q_value"))


RANKS = """WITH v AS (SELECT {g} AS g, {v}::DOUBLE AS v FROM {t} WHERE {w}), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM v),
 t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM v GROUP BY v))"""


@query(RANKS.format(g="l_returnflag", v="l_quantity", t="lineitem", w="true") + """ SELECT sum(m)::BIGINT AS n, count(*) AS k, round((12 / (sum(m) * (sum(m) + 1)) * sum(s * s / m) - 3 * (sum(m) + 1)) / (1 - max(t) / (sum(m) ** 3 - sum(m))), 6) AS h
 FROM (SELECT g, sum(r) AS s, count(*)::DOUBLE AS m FROM r GROUP BY g), t""")
def kruskal_h(spark, sf):
    return legacy.kruskal(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag").withColumn("h", F.round("h", 6))


@query(RANKS.format(g="o_orderstatus", v="round(o_totalprice / 1000)", t="orders", w="o_orderstatus IN ('F', 'O')") + """, s AS (SELECT sum(r) FILTER (WHERE g = 'F') - (count(*) FILTER (WHERE g = 'F')) * (count(*) FILTER (WHERE g = 'F') + 1) / 2 AS u, (count(*) FILTER (WHERE g = 'F'))::DOUBLE AS n1, (count(*) FILTER (WHERE g = 'O'))::DOUBLE AS n2 FROM r)
 SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, u, round(1 - 2 * u / (n1 * n2), 9) AS rank_biserial, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s, t""")
def mannwhitney_u(spark, sf):
    rows = table(spark, sf, "orders").withColumn("v", F.round(F.col("o_totalprice") / 1000))
    return legacy.mann_whitney(rows, "v", "o_orderstatus", "F", "O").withColumn("rank_biserial", F.round("rank_biserial", 9)).withColumn("z", F.round("z", 6))


@query("""SELECT column_name AS "column", round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(stddev_pop(v) / avg(v), 6) AS cv, round(100 * avg((v = 0)::INTEGER), 6) AS sparsity_pct, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr
 FROM (SELECT 'l_quantity' AS column_name, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY column_name""")
def column_statistics(spark, sf):
    got = legacy.column_statistics(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return got.select("column", *[F.round(c, 6).alias(c) for c in ("mean", "std", "cv", "sparsity_pct", "q25", "q75", "iqr")])


@query("SELECT a, b, round(r, 6) AS r FROM (SELECT 'l_quantity' AS a, 'l_tax' AS b, corr(l_quantity, l_tax) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM lineitem)")
def correlations(spark, sf):
    got = legacy.correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_tax", "l_extendedprice"])
    return got.where("a = 'l_quantity' and b <> 'l_quantity'").withColumn("r", F.round("r", 6))


STRUCT = f"""WITH {EV}, n AS (SELECT type, row_number() OVER (ORDER BY type) AS k FROM (SELECT DISTINCT type FROM ev)), s AS (SELECT seq_id, string_agg(chr((64 + k)::INTEGER), '' ORDER BY "start") AS structure FROM ev JOIN n ON n.type = ev.type GROUP BY seq_id),
 d AS (SELECT DISTINCT right(seq_id, 1) AS grp, structure FROM s)"""


@query(STRUCT + " SELECT x.grp, x.structure AS a, y.structure AS b, levenshtein(x.structure, y.structure)::INTEGER AS distance FROM d x JOIN d y ON x.grp = y.grp AND x.structure < y.structure")
def levenshtein_structures(spark, sf):
    found = legacy.structures(track(events(spark, sf), "type")).withColumn("grp", F.right("seq_id", F.lit(1)))
    return legacy.structure_distances(found, "grp")


@query(f"""WITH {OT} SELECT seq_id, max("end") AS read_length, sum(CASE WHEN feature = 'NATION_1' THEN "end" - "start" ELSE 0 END)::BIGINT AS "NATION_1_bp", sum(CASE WHEN feature = 'NATION_2' THEN "end" - "start" ELSE 0 END)::BIGINT AS "NATION_2_bp",
 round(100 * sum(CASE WHEN feature = 'NATION_1' THEN "end" - "start" ELSE 0 END) / max("end"), 2) AS "NATION_1_pct", round(100 * sum(CASE WHEN feature = 'NATION_2' THEN "end" - "start" ELSE 0 END) / max("end"), 2) AS "NATION_2_pct" FROM ot GROUP BY seq_id""")
def chromosome_coverage(spark, sf):
    return legacy.coverage_of(orders_tiling(spark, sf), ["NATION_1", "NATION_2"])


@query(f"""WITH {EV}, m AS (SELECT seq_id, coalesce(avg(("start" + "end") / 2) FILTER (WHERE type = 'error'), avg(("start" + "end") / 2) FILTER (WHERE type = 'view')) > max("end") / 2 AS flip, max("end") AS len FROM ev GROUP BY seq_id)
 SELECT ev.seq_id, CASE WHEN flip THEN len - "end" ELSE "start" END AS "start", CASE WHEN flip THEN len - "start" ELSE "end" END AS "end", type AS feature, coalesce(flip, false) AS reversed FROM ev JOIN m ON m.seq_id = ev.seq_id""")
def orient_reads(spark, sf):
    return legacy.orient(track(events(spark, sf), "type"), ["error"], ["view"])


@query(f"""WITH {EV} SELECT type || ':' || band AS feature, type AS layer_1, band AS layer_2, CASE WHEN type LIKE 'v%' OR type LIKE 'cl%' THEN type || ':' || band ELSE 'collapsed' END AS kept, type = 'signup' OR band LIKE 'h%' AS excluded, count(*) AS n FROM ev GROUP BY ALL""")
def label_filters(spark, sf):
    label = F.concat_ws(":", "type", "band")
    parts = legacy.layers(label, 2)
    rows = events(spark, sf).select(label.alias("feature"), parts[0].alias("layer_1"), parts[1].alias("layer_2"), legacy.keep_prefixes(label, ["v", "cl"], "collapsed").alias("kept"), legacy.matches_any(label, ["signup", "h*"]).alias("excluded"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


# merges and choices

MAPPED = """tr AS (SELECT seq_id, "start", "end", CASE type WHEN 'view' THEN 'canonical_telomere' WHEN 'click' THEN 'ITS' WHEN 'error' THEN 'TAR1' ELSE 'nonsubtelomeric' END AS s,
  CASE band WHEN 'lo' THEN 'arm' WHEN 'mid' THEN 'ct' ELSE 'rDNA' END AS r, CASE WHEN period IN ('d0', 'd1') THEN 'nonrepeat' WHEN period IN ('d2', 'd3') THEN 'rRNA' ELSE 'LINE' END AS p FROM ev)"""
TRACKS_SQL = f"WITH {EV}, {MAPPED}, t AS (SELECT * FROM tr)"


def mapped(spark, sf):
    ev = events(spark, sf)
    s = F.when(F.col("type") == "view", "canonical_telomere").when(F.col("type") == "click", "ITS").when(F.col("type") == "error", "TAR1").otherwise("nonsubtelomeric")
    r = F.when(F.col("band") == "lo", "arm").when(F.col("band") == "mid", "ct").otherwise("rDNA")
    p = F.when(F.col("period").isin("d0", "d1"), "nonrepeat").when(F.col("period").isin("d2", "d3"), "rRNA").otherwise("LINE")
    return [ev.select("seq_id", "start", "end", c.alias("feature")) for c in (s, r, p)]


@query(TRACKS_SQL + """ SELECT seq_id, "start", "end", CASE WHEN s <> 'nonsubtelomeric' THEN s WHEN r = 'arm' THEN p WHEN r = 'ct' AND p = 'nonrepeat' THEN 'ct' WHEN r = 'ct' THEN p WHEN r = 'rDNA' AND p = 'rRNA' THEN 'rRNA' ELSE r END AS feature FROM t""")
def merge_three_way(spark, sf):
    return merges.three_way(*mapped(spark, sf))


@query(TRACKS_SQL + """ SELECT seq_id, "start", "end", CASE WHEN s <> 'nonsubtelomeric' THEN s ELSE r END AS feature FROM t""")
def merge_telomere_satellite(spark, sf):
    s, r, _ = mapped(spark, sf)
    return merges.telomere_satellite(s, r)


@query(TRACKS_SQL + """ SELECT seq_id, "start", "end", CASE WHEN r = 'rDNA' THEN r ELSE s END AS feature FROM t""")
def merge_chromosome_acrocentric(spark, sf):
    s, r, _ = mapped(spark, sf)
    return merges.chromosome_acrocentric(s, r)


@query(TRACKS_SQL + """, f AS (SELECT seq_id, "start", "end", CASE WHEN s = 'canonical_telomere' THEN s WHEN s IN ('ITS', 'TAR1') AND r = 'rDNA' THEN 'rDNA_' || s WHEN s IN ('ITS', 'TAR1') THEN s ELSE r END AS feature FROM t), """ + runs_sql("f", "g") + ' SELECT seq_id, "start", "end", feature FROM g')
def merge_telomere_acrocentric(spark, sf):
    s, r, _ = mapped(spark, sf)
    return merges.telomere_acrocentric(s, r)


@query("""SELECT o_custkey AS read, count(*) AS n, sum(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey ELSE 0 END)::BIGINT AS aligned, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS primary_start FROM orders GROUP BY o_custkey""")
def alignment_stats(spark, sf):
    o = table(spark, sf, "orders")
    best = o.groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("b"))
    rows = o.join(best, "o_custkey").select(F.col("o_custkey").alias("read"), F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("length"), (F.col("o_orderstatus") == "P").alias("secondary"), F.coalesce(F.col("o_orderkey") == F.col("b"), F.lit(False)).alias("primary"))
    return legacy.alignment_stats(rows)


MEMBERS = """WITH m AS (SELECT o_orderstatus AS cluster_id, o_orderkey AS read_id, o_orderpriority AS sample, abs(o_totalprice - 1000) AS d, o_custkey AS len FROM orders)"""


def members(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("cluster_id"), F.col("o_orderkey").alias("read_id"), F.col("o_orderpriority").alias("sample"), F.abs(F.col("o_totalprice") - 1000).alias("centroid_distance"), F.col("o_custkey").alias("read_length"))


@query(MEMBERS + """, w AS (SELECT DISTINCT o_orderstatus AS cluster_id, l_returnflag AS feature FROM orders JOIN lineitem ON l_orderkey = o_orderkey), h AS (SELECT DISTINCT l_orderkey AS read_id, l_returnflag AS feature FROM lineitem)
 SELECT m.cluster_id, m.read_id, round(count(h.feature) / count(*), 9) AS share FROM m JOIN w ON w.cluster_id = m.cluster_id LEFT JOIN h ON h.read_id = m.read_id AND h.feature = w.feature GROUP BY m.cluster_id, m.read_id""")
def feature_presence(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_returnflag").alias("feature"))
    m = members(spark, sf)
    wanted = m.join(lines, "read_id").select("cluster_id", "feature").distinct()
    return choose.presence(m, wanted, lines).withColumn("share", F.round("share", 9))


@query(MEMBERS + """, t AS (SELECT *, CASE WHEN sample <= '2' AND len BETWEEN 500 AND 900 THEN 0 WHEN sample <= '2' THEN 1 WHEN sample <= '4' THEN 2 ELSE 3 END AS tier, CASE WHEN sample <= '2' THEN 1.0 WHEN sample <= '4' THEN 0.5 ELSE 0.0 END AS share FROM m)
 SELECT cluster_id, read_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY tier, share DESC, d, read_id)::INTEGER AS rank FROM t) WHERE rank <= 8""")
def tiered_representatives(spark, sf):
    share = F.when(F.col("sample") <= "2", 1.0).when(F.col("sample") <= "4", 0.5).otherwise(0.0)
    return choose.tiered(members(spark, sf).withColumn("share", share), 8, 500, 900).select("cluster_id", "read_id", "tier", "rank")


@query(MEMBERS + """ SELECT cluster_id, read_id, round(0.5 * (len % 7) / 7 + 0.4 * len / max(len) OVER (PARTITION BY cluster_id) + 0.1 * (1 - d / max(d) OVER (PARTITION BY cluster_id)), 9) AS score FROM m""")
def balanced_scores(spark, sf):
    rows = members(spark, sf).withColumn("feature_score", (F.col("read_length") % 7) / 7)
    return clusters.balanced_score(rows).select("cluster_id", "read_id", F.round("score", 9).alias("score"))


@query(MEMBERS + """, z AS (SELECT cluster_id, sample, count(*) AS size FROM m GROUP BY ALL), y AS (SELECT *, least(size, greatest(1, round_even(size / sum(size) OVER (PARTITION BY cluster_id) * 12, 0)))::BIGINT AS wanted FROM z),
 x AS (SELECT *, least(wanted, greatest(0, 12 - (sum(wanted) OVER (PARTITION BY cluster_id ORDER BY size DESC, sample) - wanted))) AS slots FROM y),
 r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, sample ORDER BY d, read_id) AS n FROM m)
 SELECT r.cluster_id, read_id::VARCHAR AS read_id, r.sample, d AS centroid_distance, row_number() OVER (PARTITION BY r.cluster_id ORDER BY d, read_id)::INTEGER AS rank FROM r JOIN x ON r.cluster_id = x.cluster_id AND r.sample = x.sample AND n <= slots""")
def representatives_by_sample(spark, sf):
    return choose.by_sample(members(spark, sf), 12).withColumn("read_id", F.col("read_id").cast("string"))


@query(MEMBERS + """, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY d, read_id) AS rank FROM m), t AS (SELECT median(len) AS target FROM r WHERE rank = 1),
 p AS (SELECT cluster_id, read_id, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN abs(log2(len / target)) <= 1 THEN 0 ELSE 1 END, rank, read_id)::INTEGER AS pick FROM r, t) SELECT * FROM p WHERE pick <= 4""")
def length_balanced(spark, sf):
    from pyspark.sql.window import Window

    ranked = members(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("centroid_distance", "read_id")))
    return choose.even_lengths(ranked, 4).select("cluster_id", "read_id", "pick")


@query(f"""WITH {EV}, b AS (SELECT seq_id, type AS feature, sum("end" - "start")::DOUBLE AS bp FROM ev GROUP BY ALL), s AS (SELECT seq_id, feature, bp / sum(bp) OVER (PARTITION BY seq_id) AS f, sum(bp) OVER (PARTITION BY seq_id) AS t, bp FROM b),
 m AS (SELECT *, right(seq_id, 1) AS cluster_id FROM s), n AS (SELECT cluster_id, count(DISTINCT seq_id) AS n, sum(bp) AS total FROM m GROUP BY cluster_id),
 th AS (SELECT feature, least(0.05, greatest(0.001, median(f) / 3)) AS threshold FROM s WHERE f > 0 GROUP BY feature)
 SELECT m.cluster_id, m.feature, round(count(*) FILTER (WHERE f > threshold) / max(n), 9) AS readpct, round(sum(bp) / max(total), 9) AS bppct FROM m JOIN n ON n.cluster_id = m.cluster_id JOIN th ON th.feature = m.feature GROUP BY m.cluster_id, m.feature""")
def cluster_scores(spark, sf):
    shares = measures.feature_fraction(track(events(spark, sf), "type"), ["seq_id"])
    who = shares.select("seq_id").distinct().withColumn("cluster_id", F.right("seq_id", F.lit(1)))
    got = clusters.above_threshold(shares, who, measures.adaptive_thresholds(shares, keys=[]))
    return got.select("cluster_id", "feature", F.round("readpct", 9).alias("readpct"), F.round("bppct", 9).alias("bppct"))
