"""Queries over many files that they write themselves: pruned scans, wide matrices, clusterings with sidecars, counted sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choose, clusters, figures, measures
from ..operators.storage import cut
from ..sources import files, scans
from ..sources.binding import EV, HT, LONG, events, hier_tables, table, track, tracks_long
from .catalogue import ALL_METRICS, query
from .file_queries import place, stored

FOUND = r"/(type|band|period)\.features/part-"


def scattered(spark, sf):
    """Three featuresets as folders of BED files, each file a range of sequences; what discovery finds, and an index beside them."""
    root, long = place(spark, "beds"), tracks_long(events(spark, sf))
    for name in ("type", "band", "period"):
        own = long.where(F.col("feature_set") == name).repartitionByRange(8, "seq_id").sortWithinPartitions("seq_id", "start")
        own.select(F.concat_ws("\t", "seq_id", "start", "end", "feature").alias("value")).write.text(f"{root}/{name}.features")
    found = cut(scans.discover(spark, root, FOUND, ["feature_set"]))
    scans.index_reads(spark, found, f"{root}.index")
    return found, f"{root}.index"


@query(f"""WITH {EV}, {LONG}, w AS (SELECT DISTINCT 'u' || user_id AS seq_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 2))
 SELECT feature_set, seq_id, feature, sum("end" - "start")::BIGINT AS bp FROM ann WHERE seq_id IN (SELECT seq_id FROM w) GROUP BY ALL""")
def reads_over_files(spark, sf):
    """Bases of each label on the reads of the two largest purchases, from files found by name; files without them are not read."""
    found, index = scattered(spark, sf)
    best = table(spark, sf, "events").where("event_type = 'purchase'").orderBy(F.desc("value"), "event_id").limit(2)
    rows = scans.rows_of(spark, found, index, best.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("seq_id")))
    return measures.feature_bp(rows)


@query(f"SELECT seq_id, string_split(name, '__')[1] AS feature_set, string_split(name, '__')[2] AS metric, string_split(name, '__')[3] AS feature, value FROM ({ALL_METRICS.replace('WITH ', 'WITH ', 1)}) WHERE name NOT LIKE '%total_bp' AND value <> 0")
def matrix_round_trip(spark, sf):
    """The wide matrix of every metric written as TSV, and read back by its headers."""
    wide = measures.wide_matrix(measures.long_metrics(tracks_long(events(spark, sf))).withColumn("value", F.round("value", 9)))
    return scans.read_matrix(spark, stored(spark, wide, "matrix"))


@query("""WITH a AS (SELECT o_orderkey::VARCHAR AS read, o_orderstatus AS cluster FROM orders), e AS (SELECT o_orderstatus AS cluster, arg_max(o_orderpriority, o_orderkey) AS enrichment FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
 SELECT read, a.cluster, coalesce(e.enrichment, 'unknown') AS enrichment, CASE WHEN a.cluster = 'O' THEN 'open' ELSE '(unlabeled)' END AS cluster_name FROM a LEFT JOIN e ON e.cluster = a.cluster""")
def clustering_with_sidecars(spark, sf):
    """Assignments, an analysis that lacks one cluster and annotations with a blank, joined by what is there."""
    orders, stem = table(spark, sf, "orders"), place(spark, "run")
    files.write_tsv(orders.select(F.col("o_orderkey").alias("sequence"), F.col("o_orderstatus").alias("cluster")), f"{stem}.sequence_assignments.tsv")
    marks = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderstatus").alias("cluster_id"), F.col("o_orderpriority").alias("enrichment"), "o_orderkey")
    files.write_tsv(marks.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey"), f"{stem}.cluster_analysis.tsv")
    names = orders.select(F.col("o_orderstatus").alias("cluster_id")).distinct().withColumn("cluster_name", F.when(F.col("cluster_id") == "O", "open").otherwise(" "))
    files.write_tsv(names, f"{stem}.cluster_annotations.tsv")
    return scans.read_clustering(spark, f"{stem}.sequence_assignments.tsv")


@query("""WITH s AS (SELECT c_nationkey::VARCHAR AS cluster_id, c_mktsegment AS enrichment, round(count(*) / 40.0, 6) AS q_value FROM customer GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY enrichment ORDER BY q_value, cluster_id)::INTEGER AS place FROM s WHERE q_value <= 0.4 AND enrichment IN ('BUILDING', 'MACHINERY', 'FURNITURE')) SELECT * FROM k WHERE place <= 5""")
def analysed_clusters(spark, sf):
    """An analysis table read from a file: small q, three enrichments, the first five of each."""
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("cluster_id"), F.col("c_mktsegment").alias("enrichment")).agg(F.round(F.count("*") / 40.0, 6).alias("q_value"))
    stats = files.read_table(spark, stored(spark, n, "analysis"), ["cluster_id", "q_value", "enrichment"])
    return scans.analysed(stats, 0.4, ["BUILDING", "MACHINERY", "FURNITURE"], 5)


@query(f"""WITH {EV}, {LONG}, f AS (SELECT feature_set, feature, bp / sum(bp) OVER (PARTITION BY feature_set, seq_id) AS f FROM (SELECT feature_set, seq_id, feature, sum("end" - "start") AS bp FROM ann GROUP BY ALL))
 SELECT feature_set, feature, round(least(0.05, greatest(0.001, median(f) / 3)), 9) AS threshold FROM f GROUP BY ALL""")
def thresholds_tsv(spark, sf):
    made = measures.adaptive_thresholds(measures.feature_fraction(tracks_long(events(spark, sf))))
    return scans.read_thresholds(spark, stored(spark, made.withColumnRenamed("feature_set", "featureset"), "thresholds")).withColumn("threshold", F.round("threshold", 9))


@query(f"""WITH {EV} SELECT k, n AS "rows", bases, sequences, n AS read_back FROM (SELECT count(*) AS n, sum("end" - "start")::BIGINT AS bases, count(DISTINCT seq_id) AS sequences FROM ev), (VALUES (1), (2)) v(k)""")
def counted_sink(spark, sf):
    """Annotation BED written twice to one place, counted on the way, the second writing taking the first one's place."""
    path, rows = place(spark, "counted"), track(events(spark, sf), "type")
    told = [scans.write_tiling(rows, path) for _ in range(2)]
    read = files.read_bed(spark, path).agg(F.count("*").alias("read_back"))
    return spark.createDataFrame([(k + 1, t["rows"], t["bases"], t["sequences"]) for k, t in enumerate(told)], "k int, rows long, bases long, sequences long").crossJoin(read)  # one row


@query("""WITH m AS (SELECT o_orderpriority AS c, c_mktsegment AS g FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 > 0 OR c_mktsegment <> 'BUILDING'), t AS (SELECT g, count(*) AS t FROM m GROUP BY g), k AS (SELECT c, count(*) AS k FROM m GROUP BY c),
 e AS (SELECT k.c, t.g, k, coalesce(n, 0) AS n, coalesce(n, 0) / t AS f FROM k CROSS JOIN t LEFT JOIN (SELECT c, g, count(*) AS n FROM m GROUP BY ALL) x ON x.c = k.c AND x.g = t.g),
 l AS (SELECT *, CASE WHEN n > 0 THEN ln(f / (k / (SELECT count(*) FROM m))) / ln(2) ELSE '-inf'::DOUBLE END AS e FROM e)
 SELECT c AS cluster_id, max(k) AS n_total, printf('%.4g', max(f) FILTER (WHERE g = 'BUILDING'))::DOUBLE AS "frac_BUILDING", printf('%.4g', max(f) FILTER (WHERE g = 'MACHINERY'))::DOUBLE AS "frac_MACHINERY" FROM l GROUP BY c""")
def enrichment_tsv(spark, sf):
    """Wide enrichment written with four digits, and read back."""
    m = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("o_orderkey % 5 > 0 or c_mktsegment <> 'BUILDING'").select(F.col("o_orderkey").alias("read_id"), F.col("o_orderpriority").alias("cluster_id"), F.col("c_mktsegment").alias("group"))
    wide, path = clusters.wide_enrichment(clusters.enrichment(m.select("read_id", "cluster_id"), m.select("read_id", "group"), 0.01)), place(spark, "enrichment")
    files.write_enrichment(wide, path)
    return files.read_enrichment(spark, path).select("cluster_id", "n_total", "frac_BUILDING", "frac_MACHINERY")


@query(f"""WITH {EV} SELECT coalesce(nullif(chromosome, ''), 'none') AS chromosome, count(*) AS n, sum(length)::BIGINT AS length, max(bad) AS malformed FROM (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'chr' || (event_id % 4) ELSE '' END AS chromosome, "end" - "start" AS length FROM ev WHERE event_id % 40 NOT IN (1, 2)), (SELECT count(*) AS bad FROM ev WHERE event_id % 40 IN (1, 2)) GROUP BY ALL""")
def loose_bed(spark, sf):
    """Rows by their fifth field, where some lines lack fields and some coordinates are none."""
    ev, k, path = events(spark, sf), F.col("event_id") % 40, place(spark, "loose")
    fifth = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("chr"), (F.col("event_id") % 4).cast("string")))
    lines = ev.select(F.when(k == 1, F.concat_ws("\t", "seq_id", "start")).when(k == 2, F.concat_ws("\t", "seq_id", F.lit("x"), "end", "type")).otherwise(F.concat_ws("\t", "seq_id", "start", "end", "type", fifth)).alias("value"))
    lines.write.text(path)
    rows, told = files.read_loose(spark, path)
    bad = told.agg(F.sum("malformed").alias("malformed"))
    return rows.groupBy(F.coalesce("chromosome", F.lit("none")).alias("chromosome")).agg(F.count("*").alias("n"), F.sum("length").alias("length")).crossJoin(bad)  # one row


@query(f"""WITH {HT}, h AS (SELECT *, row_number() OVER (ORDER BY feature_set DESC, child) AS o FROM ht), r AS (SELECT feature_set, row_number() OVER (ORDER BY min(o)) AS rank FROM h GROUP BY feature_set),
 u AS (SELECT DISTINCT 'x:' || n_name AS f FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT 'novel' FROM customer),
 k AS (SELECT f, rank, o FROM u LEFT JOIN h ON h.child = regexp_replace(f, '^[^:]*:', '') LEFT JOIN r ON r.feature_set = h.feature_set)
 SELECT f AS feature, row_number() OVER (ORDER BY rank NULLS LAST, f = 'novel', o NULLS LAST, f)::INTEGER AS place FROM k""")
def legend_by_featureset(spark, sf):
    """Nations of customers, brands of parts, segments that no tree holds, and novel."""
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    used = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("x:"), "n_name").alias("feature")).union(table(spark, sf, "part").select("p_brand")).union(customer.select("c_mktsegment")).union(customer.limit(1).select(F.lit("novel")))
    tree = hier_tables(spark, sf).withColumn("ord", F.struct(F.when(F.col("feature_set") == "part", 0).otherwise(1), "child"))
    return figures.legend_order(used, tree)


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS sample, CASE WHEN o_orderkey % 9 > 0 THEN c_mktsegment END AS g, CASE WHEN o_orderkey % 9 > 0 AND c_mktsegment <> 'BUILDING' THEN o_orderpriority END AS s FROM orders JOIN customer ON o_custkey = c_custkey),
 p AS (SELECT g, s, min(o_orderkey) AS k FROM o WHERE g IS NOT NULL GROUP BY ALL), q AS (SELECT *, min(k) OVER (PARTITION BY g) AS kg FROM p), b AS (SELECT *, coalesce(lead(g) OVER (ORDER BY kg, g, k) <> g, false) AS boundary FROM q)
 SELECT CASE WHEN o.g IS NULL THEN sample WHEN o.s IS NULL THEN o.g ELSE o.g || ' \u2014 ' || o.s END AS label, coalesce(boundary, false) AS boundary, count(*) AS n FROM o LEFT JOIN b ON b.g = o.g AND b.s IS NOT DISTINCT FROM o.s GROUP BY ALL""")
def relabelled_groups(spark, sf):
    """Reads by the label of their group and subgroup, the last of each group marked."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    group = F.when(F.col("o_orderkey") % 9 > 0, F.col("c_mktsegment"))
    reads = o.select(F.col("o_orderkey").alias("read_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("sample"), group.alias("group"), F.when(group != "BUILDING", F.col("o_orderpriority")).alias("subgroup"))
    got = figures.relabelled(reads, figures.grouping(reads.where("`group` is not null"), "group", "subgroup"))
    return got.groupBy("label", "boundary").agg(F.count("*").alias("n"))


STRATEGY = """r AS (SELECT c_nationkey AS cluster_id, o_orderkey AS read_id, o_orderstatus AS sample, o_custkey * 37 % 26000 AS read_length, o_orderkey * 13 % 1009 AS d, CASE WHEN c_nationkey = 3 THEN 0 ELSE o_orderkey % 4 / 3 END AS share FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {STRATEGY}, t AS (SELECT *, CASE WHEN read_length BETWEEN 16000 AND 20000 THEN 0 WHEN read_length BETWEEN 10000 AND 15999 THEN 1 WHEN read_length < 10000 THEN 2 END AS tier FROM r WHERE share > 0),
 a AS (SELECT cluster_id, read_id, row_number() OVER (PARTITION BY cluster_id ORDER BY tier, read_length DESC, read_id) AS rank FROM t WHERE tier IS NOT NULL),
 q AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY d, read_id) AS k, count(*) OVER (PARTITION BY cluster_id) AS n FROM r WHERE cluster_id NOT IN (SELECT cluster_id FROM a)),
 b AS (SELECT cluster_id, read_id, row_number() OVER (PARTITION BY cluster_id ORDER BY read_length DESC, read_id) AS rank FROM q WHERE k <= greatest(1, n // 4)),
 l AS (SELECT cluster_id, read_id, row_number() OVER (PARTITION BY cluster_id ORDER BY read_length DESC, read_id) AS rank FROM r)
 SELECT 'feature-match' AS strategy, cluster_id, read_id, rank::INTEGER AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rank <= 4 UNION ALL SELECT 'longest', cluster_id, read_id, rank::INTEGER FROM l WHERE rank <= 4""")
def strategies(spark, sf):
    """Orders as reads of their customer's nation, chosen by two strategies; one nation holds no wanted label and falls back."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("c_nationkey").alias("cluster_id"), F.col("o_orderkey").alias("read_id"), F.col("o_orderstatus").alias("sample"), (F.col("o_custkey") * 37 % 26000).alias("read_length"), (F.col("o_orderkey") * 13 % 1009).alias("centroid_distance"), F.when(F.col("c_nationkey") == 3, 0.0).otherwise(F.col("o_orderkey") % 4 / 3).alias("share"))
    return choose.by_strategy(rows, 4, "feature-match").withColumn("strategy", F.lit("feature-match")).union(choose.by_strategy(rows, 4, "longest").withColumn("strategy", F.lit("longest"))).select("strategy", "cluster_id", "read_id", "rank")
