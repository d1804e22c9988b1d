"""Every query of the interval engine, bound to the driver's tables, with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hierarchy as H
from ..functions import intervals as I
from ..functions import resolve as R
from ..operators import binning, clusters, colocalization, measures
from ..operators.overlay import overlay
from ..operators.storage import cut
from ..sources import files
from ..sources.binding import EDGES, EV, EVENT_EDGES, HT, LONG, OT, TRACKS, events, hier_events, hier_geo, hier_tables, orders_tiling, runs_sql, table, track, tracks_long

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, and its SQL where there is one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def type_edges(spark):
    return hier_events(spark).where("feature_set = 'type'").select("feature_set", "child", "parent")


SPEC = R.load(
    {
        "precedence": ["type", "band", "period"],
        "rules": [
            {"when": {"type": "@browse", "band": ["hi"]}, "emit": {"composite": ["type", "period"], "sep": "|"}},
            {"when": {"type": ["error"]}, "emit": {"literal": "fault"}},
            {"when": {"period": "@early"}, "emit": "band"},
        ],
    },
    H.classes_of(EVENT_EDGES),
)
RESOLVED = """CASE WHEN type IN ('browse', 'look', 'view', 'click') AND band = 'hi' THEN type || '|' || period
  WHEN type = 'error' THEN 'fault' WHEN period IN ('early', 'd0', 'd1', 'd2') THEN band ELSE type END"""


def three(spark, sf):
    ev = events(spark, sf)
    return {n: track(ev, n) for n in TRACKS}


# sources and checks


@query(f'WITH {EV} SELECT seq_id, "start", "end", type, band, period, event_id FROM ev')
def ann_events_tiling(spark, sf):
    return events(spark, sf)


@query(f'WITH {OT} SELECT seq_id, "start", "end", feature, returnflag FROM ot')
def ann_orders_tiling(spark, sf):
    return orders_tiling(spark, sf)


@query(f"""WITH {EV}, bad AS (SELECT seq_id, "start", CASE WHEN type = 'error' THEN "end" + 2 WHEN type = 'signup' THEN "end" - 1 WHEN type = 'view' AND band = 'hi' THEN "start" ELSE "end" END AS "end", event_id FROM ev)
  SELECT * FROM (SELECT seq_id, "start", "end", event_id, CASE WHEN "end" <= "start" THEN 'empty' WHEN "start" > b THEN 'gap' WHEN "start" < b THEN 'overlap' END AS kind
    FROM (SELECT *, lag("end") OVER (PARTITION BY seq_id ORDER BY "start", "end") AS b FROM bad)) WHERE kind IS NOT NULL""")
def c4_violations(spark, sf):
    end = F.when(F.col("type") == "error", F.col("end") + 2).when(F.col("type") == "signup", F.col("end") - 1).when((F.col("type") == "view") & (F.col("band") == "hi"), F.col("start")).otherwise(F.col("end"))
    return files.broken_tiles(events(spark, sf).select("seq_id", "start", end.alias("end"), "event_id"))


@query(f"""WITH {EV}, {EDGES}, bad AS (SELECT 'type' AS feature_set, CASE WHEN event_id % 50 = 0 THEN 'novel' WHEN event_id % 51 = 0 THEN 'odd' || (event_id % 3) ELSE type END AS feature FROM ev)
  SELECT DISTINCT feature_set, feature FROM bad WHERE feature <> 'novel' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.feature_set = bad.feature_set AND (e.child = bad.feature OR e.parent = bad.feature))""")
def c2_violations(spark, sf):
    label = F.when(F.col("event_id") % 50 == 0, "novel").when(F.col("event_id") % 51 == 0, F.concat(F.lit("odd"), (F.col("event_id") % 3).cast("string"))).otherwise(F.col("type"))
    return H.unknown_labels(events(spark, sf).select(F.lit("type").alias("feature_set"), label.alias("feature")), hier_events(spark))


@query(f"""WITH {EV}, t AS (SELECT 'type' AS track, seq_id, min("start") AS s, max("end") AS e FROM ev GROUP BY seq_id HAVING count(*) > 60
  UNION ALL SELECT 'band', seq_id, min("start"), max(CASE WHEN band = 'hi' THEN "end" + 5 ELSE "end" END) FROM ev GROUP BY seq_id)
  SELECT seq_id, CASE WHEN count(DISTINCT track) < 2 THEN 'missing' ELSE 'span' END AS problem FROM t GROUP BY seq_id HAVING count(DISTINCT track) < 2 OR min(s) <> max(s) OR min(e) <> max(e)""")
def x1_track_mismatches(spark, sf):
    ev = events(spark, sf)
    many = ev.groupBy("seq_id").agg(F.count("*").alias("n")).where("n > 60").select("seq_id")
    longer = ev.withColumn("end", F.when(F.col("band") == "hi", F.col("end") + 5).otherwise(F.col("end")))
    return I.track_mismatches({"type": track(ev.join(many, "seq_id"), "type"), "band": track(longer, "band")})


# hierarchy


@query(f"""WITH RECURSIVE {HT}, n AS (SELECT feature_set, child AS node FROM ht UNION SELECT feature_set, parent FROM ht),
  c AS (SELECT feature_set, node, node AS ancestor, 0 AS distance FROM n UNION ALL SELECT c.feature_set, node, parent, distance + 1 FROM c JOIN ht e ON e.feature_set = c.feature_set AND e.child = c.ancestor)
  SELECT * FROM c""")
def hierarchy_closure(spark, sf):
    return H.closure(cut(hier_tables(spark, sf)))


@query(f"WITH {HT} SELECT DISTINCT feature_set, child AS node FROM ht WHERE (feature_set, child) NOT IN (SELECT (feature_set, parent) FROM ht)")
def hierarchy_leaves(spark, sf):
    return H.leaves(hier_tables(spark, sf))


@query("""SELECT n_name AS node, r_name AS ancestor FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'categorized' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, 'categorized' FROM region""")
def hierarchy_descendants(spark, sf):
    return H.closure(hier_geo(spark, sf)).where("distance > 0").select("node", "ancestor")


@query(f"WITH {HT} SELECT DISTINCT feature_set, parent AS node FROM ht WHERE (feature_set, parent) NOT IN (SELECT (feature_set, child) FROM ht)")
def hierarchy_roots(spark, sf):
    return H.roots(hier_tables(spark, sf))


# interval algebra


@query(f"WITH {EV}, f AS (SELECT seq_id, \"start\", \"end\", type AS feature FROM ev), {runs_sql('f', 'r')} SELECT seq_id, \"start\", \"end\", feature FROM r")
def coalesce_type(spark, sf):
    return I.coalesce_runs(track(events(spark, sf), "type"))


MERGED = f"""WITH {EV}, s AS (SELECT seq_id, "start", "end" FROM ev WHERE type IN ('view', 'click') UNION ALL SELECT seq_id, "start" + 3, "end" + 40 FROM ev WHERE band = 'hi'),
 m AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY seq_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS cut FROM s),
 g AS (SELECT *, sum(cut) OVER (PARTITION BY seq_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS run FROM m),
 r AS (SELECT seq_id, min("start") AS "start", max("end") AS "end" FROM g GROUP BY seq_id, run)"""


def overlapping(spark, sf):
    ev = events(spark, sf)
    return ev.where("type in ('view', 'click')").select("seq_id", "start", "end").union(ev.where("band = 'hi'").select("seq_id", F.col("start") + 3, F.col("end") + 40))


@query(MERGED + ' SELECT seq_id, "start", "end" FROM r')
def merge_covered(spark, sf):
    return I.merge_overlapping(overlapping(spark, sf))


@query(MERGED + ' SELECT seq_id, sum("end" - "start")::BIGINT AS covered FROM r GROUP BY seq_id')
def total_covered(spark, sf):
    return I.total_covered(overlapping(spark, sf))


@query(f"""WITH {EV}, a AS (SELECT seq_id, "start", "end", type AS feature FROM ev), b AS (SELECT seq_id, "start", "end", band AS feature FROM ev), {runs_sql('a', 'ra')}, {runs_sql('b', 'rb')}
 SELECT ra.seq_id, greatest(ra."start", rb."start") AS "start", least(ra."end", rb."end") AS "end", ra.feature AS type, rb.feature AS band FROM ra JOIN rb ON ra.seq_id = rb.seq_id AND ra."start" < rb."end" AND rb."start" < ra."end\"""")
def refine_2(spark, sf):
    t = three(spark, sf)
    return I.refine({n: I.coalesce_runs(t[n]) for n in ("type", "band")})


def overlay_sql(expression: str) -> str:
    return f"WITH {EV}, o AS (SELECT seq_id, \"start\", \"end\", {expression} AS feature FROM ev), {runs_sql('o', 'r')} SELECT seq_id, \"start\", \"end\", feature FROM r"


@query(overlay_sql("type || ':' || band || ':' || period"))
def overlay_composite(spark, sf):
    return overlay(three(spark, sf), R.composite(TRACKS))


@query(overlay_sql(RESOLVED))
def overlay_rules(spark, sf):
    return overlay({n: I.coalesce_runs(t) for n, t in three(spark, sf).items()}, SPEC)


@query(overlay_sql("CASE WHEN band = 'hi' THEN band ELSE type END"))
def overlay_priority(spark, sf):
    return overlay(three(spark, sf), R.load({"precedence": ["type", "band"], "rules": [{"when": {"band": ["hi"]}, "emit": "band"}]}))


@query(f"""WITH {EV}, o AS (SELECT seq_id, "start", "end", type || ':' || band AS feature FROM ev), {runs_sql('o', 'r')}
 SELECT feature, sum("end" - "start")::BIGINT AS bp, count(*) AS n_segments FROM r GROUP BY feature ORDER BY bp DESC, feature LIMIT 20""")
def overlay_top_labels(spark, sf):
    t = three(spark, sf)
    over = overlay({n: t[n] for n in ("type", "band")}, R.composite(("type", "band")))
    return over.groupBy("feature").agg(F.sum(F.col("end") - F.col("start")).alias("bp"), F.count("*").alias("n_segments")).orderBy(F.desc("bp"), "feature").limit(20)


@query(f"""WITH {EV}, a AS (SELECT seq_id, "start" + 5 AS "start", "end" + 60 AS "end", type AS feature FROM ev WHERE type IN ('view', 'signup')), b AS (SELECT seq_id, "start", "end", band AS feature FROM ev)
 SELECT a.seq_id, greatest(a."start", b."start") AS "start", least(a."end", b."end") AS "end", a.feature || ':' || b.feature AS feature FROM a JOIN b ON a.seq_id = b.seq_id AND a."start" < b."end" AND b."start" < a."end\"""")
def interval_overlap_join(spark, sf):
    ev = events(spark, sf)
    a = ev.where("type in ('view', 'signup')").select("seq_id", (F.col("start") + 5).alias("start"), (F.col("end") + 60).alias("end"), F.col("type").alias("feature"))
    return I.overlap_join(a, track(ev, "band"))


SUBTRACT = f"""WITH {EV}, b AS (SELECT seq_id, "start" + 7 AS s, "end" - 3 AS e FROM ev WHERE band = 'hi' AND "end" - "start" > 10),
 c AS (SELECT ev.seq_id, ev."start", ev."end", type, unnest(list_concat([ev."start"], list_concat(coalesce(list(greatest(ev."start", s)) FILTER (WHERE s IS NOT NULL), []), coalesce(list(least(ev."end", e)) FILTER (WHERE e IS NOT NULL), [])))) AS p
   FROM ev LEFT JOIN b ON ev.seq_id = b.seq_id AND s < ev."end" AND e > ev."start" GROUP BY ev.seq_id, ev."start", ev."end", type),
 d AS (SELECT DISTINCT seq_id, "start", "end", type, p FROM c),
 g AS (SELECT seq_id, p AS "start", coalesce(lead(p) OVER (PARTITION BY seq_id, "start" ORDER BY p), "end") AS "end", type AS feature FROM d)
 SELECT seq_id, "start", "end", feature FROM g WHERE "start" < "end" AND NOT EXISTS (SELECT 1 FROM b WHERE b.seq_id = g.seq_id AND b.s <= g."start" AND b.e >= g."end")"""


@query(SUBTRACT)
def interval_subtract(spark, sf):
    ev = events(spark, sf)
    blockers = ev.where("band = 'hi' and end - start > 10").select("seq_id", (F.col("start") + 7).alias("start"), (F.col("end") - 3).alias("end"))
    return I.subtract(track(ev, "type"), blockers)


@query(f"""WITH {EV} SELECT seq_id, "start", "end", CASE WHEN band = 'hi' THEN band ELSE type END AS feature FROM ev""")
def priority_fill(spark, sf):
    ev = events(spark, sf)
    return I.priority_fill(track(ev, "band").where("feature = 'hi'"), track(ev, "type"))


# measures


@query(f'WITH {EV}, {LONG} SELECT feature_set, seq_id, feature, sum("end" - "start")::BIGINT AS bp FROM ann GROUP BY ALL')
def feature_bp(spark, sf):
    return measures.feature_bp(tracks_long(events(spark, sf)))


FRAC = """frac AS (SELECT feature_set, seq_id, feature, bp, (sum(bp) OVER (PARTITION BY feature_set, seq_id))::BIGINT AS total_bp, bp / sum(bp) OVER (PARTITION BY feature_set, seq_id) AS frac
  FROM (SELECT feature_set, seq_id, feature, sum("end" - "start")::BIGINT AS bp FROM ann GROUP BY ALL))"""


@query(f"WITH {EV}, {LONG}, {FRAC} SELECT feature_set, seq_id, feature, bp, total_bp, round(frac, 9) AS frac FROM frac")
def feature_fraction(spark, sf):
    return measures.feature_fraction(tracks_long(events(spark, sf))).withColumn("frac", F.round("frac", 9))


@query(f"""WITH {EV}, f AS (SELECT seq_id, type AS feature, "start", "end", CASE WHEN "start" - max("end") OVER (PARTITION BY seq_id, type ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 100 THEN 0 ELSE 1 END AS cut FROM ev),
 g AS (SELECT *, sum(cut) OVER (PARTITION BY seq_id, feature ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS run FROM f)
 SELECT seq_id, feature, max(len)::BIGINT AS max_block FROM (SELECT seq_id, feature, max("end") - min("start") AS len FROM g GROUP BY seq_id, feature, run) GROUP BY seq_id, feature""")
def max_block(spark, sf):
    return I.max_block(track(events(spark, sf), "type"), ["seq_id", "feature"], 100)


DENSE = f"""WITH {EV}, base AS (SELECT seq_id, unnest(range("start", "end")) AS p, type FROM ev),
 lab AS (SELECT DISTINCT seq_id, type AS feature FROM ev), span AS (SELECT seq_id, max("end") AS len FROM ev GROUP BY seq_id),
 w AS (SELECT l.seq_id, feature, p, len, sum(CASE WHEN type = feature THEN 1 ELSE 0 END) OVER (PARTITION BY l.seq_id, feature ORDER BY p ROWS BETWEEN CURRENT ROW AND 999 FOLLOWING) AS s
   FROM base JOIN lab l ON base.seq_id = l.seq_id JOIN span ON span.seq_id = l.seq_id),
 d AS (SELECT seq_id, feature, max(s) / 1000 AS dmax, min(s) / 1000 AS dmin, median(s) / 1000 AS dmedian, max(CASE WHEN p = 0 THEN s END) / 1000 AS dfirst, max(CASE WHEN p = len - 1000 THEN s END) / 1000 AS dlast
   FROM w WHERE len >= 1000 AND p <= len - 1000 GROUP BY seq_id, feature
   UNION ALL SELECT seq_id, feature, x, x, x, x, x FROM (SELECT seq_id, feature, sum(CASE WHEN type = feature THEN 1 ELSE 0 END) / max(len) AS x FROM (SELECT l.seq_id, feature, len, type FROM base JOIN lab l ON base.seq_id = l.seq_id JOIN span ON span.seq_id = l.seq_id WHERE len < 1000) GROUP BY seq_id, feature))"""


@query(DENSE + " SELECT seq_id, feature, round(dmax, 9) AS dmax, round(dmin, 9) AS dmin, round(dmedian, 9) AS dmedian FROM d")
def density_extremes(spark, sf):
    d = measures.window_densities(track(events(spark, sf), "type"))
    return d.select("seq_id", "feature", *[F.round(c, 9).alias(c) for c in ("dmax", "dmin", "dmedian")])


@query(DENSE + " SELECT seq_id, feature, round(dfirst, 9) AS dfirst, round(dlast, 9) AS dlast, round(greatest(dfirst, dlast), 9) AS dterminal, round(least(dfirst, dlast), 9) AS dterminal_min FROM d")
def density_terminal(spark, sf):
    d = measures.window_densities(I.coalesce_runs(track(events(spark, sf), "type")))
    return d.select("seq_id", "feature", *[F.round(c, 9).alias(c) for c in ("dfirst", "dlast", "dterminal", "dterminal_min")])


@query(f"""WITH {EV}, c AS (SELECT seq_id, "start", "end", CASE WHEN type IN ('view', 'click') THEN 'look' WHEN type IN ('purchase', 'signup') THEN 'act' ELSE 'other' END AS c FROM ev),
 t AS (SELECT seq_id, count(*) FILTER (WHERE c <> b) AS n FROM (SELECT *, lag(c) OVER (PARTITION BY seq_id ORDER BY "start") AS b FROM c) GROUP BY seq_id),
 u AS (SELECT seq_id, count(*) FILTER (WHERE c <> b) AS n FROM (SELECT *, lag(c) OVER (PARTITION BY seq_id ORDER BY "start") AS b FROM c WHERE c <> 'other') GROUP BY seq_id),
 k AS (SELECT seq_id, (max("end") - min("start")) / 1000 AS kb FROM ev GROUP BY seq_id)
 SELECT k.seq_id, round_even(t.n / kb, 2) AS total, round_even(coalesce(u.n, 0) / kb, 2) AS look_act FROM k JOIN t ON t.seq_id = k.seq_id LEFT JOIN u ON u.seq_id = k.seq_id""")
def interspersion(spark, sf):
    category = F.when(F.col("feature").isin("view", "click"), "look").when(F.col("feature").isin("purchase", "signup"), "act").otherwise("other")
    return measures.interspersion(track(events(spark, sf), "type"), category, {"look_act": ({"look"}, {"act"})})


@query(f"""WITH {EV}, {LONG}, {FRAC} SELECT feature_set, feature, round(median(frac), 9) AS median_nonzero, count(*) AS n_nonzero, round(least(0.05, greatest(0.001, median(frac) / 3)), 9) AS threshold
  FROM frac WHERE frac > 0 GROUP BY feature_set, feature""")
def adaptive_thresholds(spark, sf):
    t = measures.adaptive_thresholds(measures.feature_fraction(tracks_long(events(spark, sf))))
    return t.withColumn("median_nonzero", F.round("median_nonzero", 9)).withColumn("threshold", F.round("threshold", 9))


MATRIX = [f"{fs}__{m}__{f}" for fs, fss in (("band", ("hi", "lo", "mid")),) for f in fss for m in ("bp", "frac")]


@query(f"""WITH {EV}, {LONG}, {FRAC} SELECT seq_id, {', '.join(f"coalesce(round(max({'bp' if '__bp__' in n else 'frac'}) FILTER (WHERE feature = '{n.rsplit('__', 1)[1]}'), 9), 0)::DOUBLE AS {n}" for n in MATRIX)}
  FROM frac WHERE feature_set = 'band' GROUP BY seq_id""")
def feature_matrix_wide(spark, sf):
    return measures.wide_matrix(measures.long_metrics(tracks_long(events(spark, sf)).where("feature_set = 'band'"), metrics=measures.metrics_of(MATRIX)).withColumn("value", F.round("value", 9)), MATRIX)


ALL_METRICS = f"""WITH {EV}, {LONG}, {FRAC}, base AS (SELECT feature_set, seq_id, unnest(range("start", "end")) AS p, feature AS own FROM ann), lab AS (SELECT DISTINCT feature_set, seq_id, feature FROM ann),
 span AS (SELECT feature_set, seq_id, max("end") AS len FROM ann GROUP BY ALL),
 w AS (SELECT b.feature_set, b.seq_id, l.feature, p, len, sum(CASE WHEN own = l.feature THEN 1 ELSE 0 END) OVER (PARTITION BY b.feature_set, b.seq_id, l.feature ORDER BY p ROWS BETWEEN CURRENT ROW AND 999 FOLLOWING) AS s
   FROM base b JOIN lab l ON b.feature_set = l.feature_set AND b.seq_id = l.seq_id JOIN span ON span.seq_id = b.seq_id AND span.feature_set = b.feature_set),
 d AS (SELECT feature_set, seq_id, feature, max(s) / 1000 AS dmax, min(s) / 1000 AS dmin, median(s) / 1000 AS dmedian, max(CASE WHEN p = 0 THEN s END) / 1000 AS dfirst, max(CASE WHEN p = len - 1000 THEN s END) / 1000 AS dlast
   FROM w WHERE len >= 1000 AND p <= len - 1000 GROUP BY ALL UNION ALL SELECT feature_set, seq_id, feature, frac, frac, frac, frac, frac FROM frac WHERE total_bp < 1000),
 cuts AS (SELECT *, CASE WHEN "start" - max("end") OVER (PARTITION BY feature_set, seq_id, feature ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 100 THEN 0 ELSE 1 END AS cut FROM ann),
 runs AS (SELECT *, sum(cut) OVER (PARTITION BY feature_set, seq_id, feature ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS run FROM cuts),
 block AS (SELECT feature_set, seq_id, feature, max(n) AS n FROM (SELECT feature_set, seq_id, feature, max("end") - min("start") AS n FROM runs GROUP BY feature_set, seq_id, feature, run) GROUP BY ALL),
 m AS (SELECT feature_set, seq_id, feature, unnest(['bp', 'frac']) AS metric, unnest([bp::DOUBLE, frac]) AS value FROM frac UNION ALL SELECT feature_set, seq_id, feature, 'max_block_bp', n FROM block
   UNION ALL SELECT feature_set, seq_id, feature, unnest(['dmax', 'dmin', 'dmedian', 'dfirst', 'dlast', 'dterminal', 'dterminal_min']), unnest([dmax, dmin, dmedian, dfirst, dlast, greatest(dfirst, dlast), least(dfirst, dlast)]) FROM d)
 SELECT seq_id, feature_set || '__' || metric || '__' || feature AS name, round(value, 9) AS value FROM m UNION ALL SELECT DISTINCT seq_id, feature_set || '__total_bp', total_bp::DOUBLE FROM frac"""


@query(ALL_METRICS)
def feature_matrix_long(spark, sf):
    return measures.long_metrics(tracks_long(events(spark, sf))).withColumn("value", F.round("value", 9))


@query(f"""WITH {EV}, {LONG}, b AS (SELECT feature_set, feature, sum("end" - "start")::BIGINT AS genome_bp FROM ann GROUP BY ALL), f AS (SELECT *, genome_bp / sum(genome_bp) OVER (PARTITION BY feature_set) AS f FROM b)
 SELECT feature_set, feature, genome_bp, round(f, 9) AS genome_fraction, round(-ln(f), 9) AS info_content, round(-ln(f) / max(-ln(f)) OVER (), 9) AS weight FROM f""")
def genome_weights(spark, sf):
    w = measures.genome_weights(tracks_long(events(spark, sf)))
    return w.select("feature_set", "feature", "genome_bp", *[F.round(c, 9).alias(c) for c in ("genome_fraction", "info_content", "weight")])


@query(f"""WITH {OT} SELECT feature, round(greatest(0.1, 1 - count(DISTINCT seq_id) / (SELECT count(DISTINCT seq_id) FROM ot)), 9) AS weight FROM ot GROUP BY feature""")
def idf_weights(spark, sf):
    return measures.document_weights(orders_tiling(spark, sf)).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {EV} SELECT 's' || (event_id % 2) || '|' || seq_id AS read_id, 's' || (event_id % 2) AS sample FROM ev GROUP BY ALL""")
def pool_namespaced(spark, sf):
    ev = events(spark, sf).withColumn("sample", F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")))
    return files.pool(ev)[1]


# binning


def descent_sql(windows: str, majority: float, scope: str) -> str:
    """Majority descent of weights (seq_id, "start", "end", feature, w) by relational steps over the type tree."""
    base = "coalesce(p.sub, s.total)" if scope == "node" else "s.total"
    return f"""WITH RECURSIVE {EV}, {EDGES}, te AS (SELECT child, parent FROM edges WHERE feature_set = 'type'),
 up AS (SELECT child AS node, child AS anc FROM te UNION ALL SELECT node, parent FROM up JOIN te ON te.child = anc WHERE parent <> 'categorized'),
 dep AS (SELECT node, count(*) AS depth FROM up GROUP BY node),
 {windows},
 tot AS (SELECT seq_id, "start", "end", sum(w) AS total FROM wt GROUP BY ALL),
 s AS (SELECT wt.seq_id, wt."start", wt."end", anc AS node, sum(w) AS sub, max(total) AS total, max(d.depth) AS depth, max(te.parent) AS parent FROM wt JOIN tot ON wt.seq_id = tot.seq_id AND wt."start" = tot."start" JOIN up ON up.node = wt.feature JOIN dep d ON d.node = anc JOIN te ON te.child = anc GROUP BY wt.seq_id, wt."start", wt."end", anc),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, "start", parent ORDER BY sub DESC, depth DESC, node DESC) AS n FROM s) WHERE n = 1),
 pass AS (SELECT s.seq_id, s."start", s.node, s.depth FROM best s LEFT JOIN s p ON p.seq_id = s.seq_id AND p."start" = s."start" AND p.node = s.parent WHERE s.sub > {majority} * {base}),
 reach AS (SELECT p.seq_id, p."start", p.node, p.depth FROM pass p JOIN up ON up.node = p.node JOIN pass q ON q.seq_id = p.seq_id AND q."start" = p."start" AND q.node = up.anc GROUP BY ALL HAVING count(*) = p.depth),
 deep AS (SELECT seq_id, "start", arg_max(node, depth) AS node FROM reach GROUP BY ALL),
 flat AS (SELECT seq_id, "start", "end", feature AS node FROM (SELECT wt.*, row_number() OVER (PARTITION BY seq_id, "start" ORDER BY w DESC, depth DESC, feature DESC) AS n FROM wt JOIN dep ON dep.node = wt.feature) WHERE n = 1),
 called AS (SELECT flat.seq_id, flat."start", flat."end", coalesce(deep.node, flat.node) AS feature FROM flat LEFT JOIN deep ON deep.seq_id = flat.seq_id AND deep."start" = flat."start"),
 {runs_sql('called', 'r')}
 SELECT seq_id, "start", "end", feature FROM r"""


STRIDED = """sp AS (SELECT seq_id, max("end") AS len FROM ev GROUP BY seq_id), ti AS (SELECT seq_id, len, unnest(range(0, len, 50)) AS p FROM sp),
 tw AS (SELECT seq_id, p AS "start", least(p + 50, len) AS "end", greatest(0, least(len - 1, p + 25) - 100) AS lo, least(len, least(len - 1, p + 25) + 101) AS hi FROM ti),
 wt AS (SELECT t.seq_id, t."start", t."end", type AS feature, sum(least(ev."end", hi) - greatest(ev."start", lo)) AS w FROM tw t JOIN ev ON ev.seq_id = t.seq_id AND ev."start" < hi AND ev."end" > lo GROUP BY t.seq_id, t."start", t."end", type)"""


@query(descent_sql(STRIDED, 0.5, "node"))
def bin_strided_node(spark, sf):
    return binning.bin_strided(track(events(spark, sf), "type"), type_edges(spark), 201, 50, 0.5, "node")


@query(descent_sql(STRIDED, 0.3, "window"))
def bin_strided_window(spark, sf):
    return binning.bin_strided(track(events(spark, sf), "type"), type_edges(spark), 201, 50, 0.3, "window")


@query(descent_sql("""wt AS (SELECT seq_id, p AS "start", p + 1 AS "end", feature, count(*) AS w FROM (SELECT a.seq_id, a.p, b.type AS feature FROM (SELECT seq_id, unnest(range("start", "end")) AS p FROM ev) a
   JOIN (SELECT seq_id, unnest(range("start", "end")) AS q, type FROM ev) b ON a.seq_id = b.seq_id AND q BETWEEN p - 10 AND p + 10) GROUP BY seq_id, p, feature)""", 0.5, "node"))
def bin_exact(spark, sf):
    return binning.bin_annotations(track(events(spark, sf), "type"), type_edges(spark), 21, 1)


@query(f"""WITH {EV}, w AS (SELECT seq_id, sum("end" - "start") AS total, sum(CASE WHEN type = 'error' THEN "end" - "start" ELSE 0 END) AS nv FROM ev GROUP BY seq_id)
  SELECT seq_id, nv > 0 AND nv >= 0.25 * total AS is_novel FROM w""")
def novel_gate(spark, sf):
    rows = track(events(spark, sf), "type").withColumn("feature", F.when(F.col("feature") == "error", "novel").otherwise(F.col("feature")))
    w = rows.groupBy("seq_id", "feature").agg(F.sum(F.col("end") - F.col("start")).alias("w"))
    return binning.descend(w, type_edges(spark), ["seq_id"], novel_min=0.25).select("seq_id", (F.col("feature") == "novel").alias("is_novel"))


# colocalization


GAPS = f"""WITH {EV}, g AS (SELECT a.seq_id, least(a.type, b.type) AS feature_a, greatest(a.type, b.type) AS feature_b, min(greatest(0, b."start" - a."end"))::BIGINT AS gap
  FROM ev a JOIN ev b ON a.seq_id = b.seq_id AND b."start" > a."start" AND a.type <> b.type AND a."end" - a."start" >= 20 AND b."end" - b."start" >= 20 GROUP BY ALL),
  sp AS (SELECT seq_id, seq_id LIKE '%_[02468]' OR right(seq_id, 1) IN ('0', '2', '4', '6', '8') AS ex, (CASE WHEN max("end") - min("start") >= 3000 THEN 1 ELSE 0 END) + (CASE WHEN max("end") - min("start") >= 4000 THEN 1 ELSE 0 END) AS bucket FROM ev GROUP BY seq_id)"""


def gaps_of(spark, sf):
    rows = track(events(spark, sf), "type")
    return colocalization.min_gaps(rows, 20), colocalization.read_spans(rows)


@query(GAPS + " SELECT * FROM g")
def min_gaps(spark, sf):
    return gaps_of(spark, sf)[0]


SUPPORT = GAPS + ", su AS (SELECT bucket, feature_a, feature_b, wi AS \"window\", count(*) FILTER (WHERE gap <= wi) AS support FROM g JOIN sp ON g.seq_id = sp.seq_id, (VALUES (0), (200), (1000)) v(wi) GROUP BY ALL)"
W3 = (0, 200, 1000)


@query(SUPPORT + " SELECT * FROM su")
def pair_support(spark, sf):
    return colocalization.support(*gaps_of(spark, sf), W3, (3000, 4000))[0]


@query(SUPPORT + ' SELECT feature_a, feature_b, "window", round(sum(support) / (SELECT count(*) FROM sp), 9) AS rate FROM su GROUP BY feature_a, feature_b, "window"')
def pooled_rate(spark, sf):
    return colocalization.pooled_rate(*colocalization.support(*gaps_of(spark, sf), W3, (3000, 4000))).withColumn("rate", F.round("rate", 9))


def two_samples(spark, sf):
    gaps, spans = gaps_of(spark, sf)
    even = F.right("seq_id", F.lit(1)).isin("0", "2", "4", "6", "8")
    return [colocalization.support(gaps.where(c), spans.where(c), W3, (3000, 4000)) for c in (even, ~even)]


CMH = GAPS + """, t AS (SELECT bucket, count(*) FILTER (WHERE ex) AS et, count(*) FILTER (WHERE NOT ex) AS ct FROM sp GROUP BY bucket),
 s AS (SELECT bucket, feature_a, feature_b, wi, count(*) FILTER (WHERE gap <= wi AND ex) AS es, count(*) FILTER (WHERE gap <= wi AND NOT ex) AS cs FROM g JOIN sp ON g.seq_id = sp.seq_id, (VALUES (0), (200), (1000)) v(wi) GROUP BY ALL),
 p AS (SELECT DISTINCT feature_a, feature_b, wi FROM g JOIN sp ON g.seq_id = sp.seq_id AND ex, (VALUES (0), (200), (1000)) v(wi)),
 f AS (SELECT p.feature_a, p.feature_b, p.wi, coalesce(es, 0)::DOUBLE AS a, (et - coalesce(es, 0))::DOUBLE AS b, coalesce(cs, 0)::DOUBLE AS c, (ct - coalesce(cs, 0))::DOUBLE AS d, (et + ct)::DOUBLE AS n
   FROM p CROSS JOIN t LEFT JOIN s ON s.bucket = t.bucket AND s.feature_a = p.feature_a AND s.feature_b = p.feature_b AND s.wi = p.wi),
 h AS (SELECT feature_a, feature_b, wi, sum(a)::BIGINT AS exp_support, sum(a + b)::BIGINT AS exp_total, sum(c)::BIGINT AS ctrl_support, sum(c + d)::BIGINT AS ctrl_total,
   sum(a) FILTER (WHERE n >= 2) AS sa, sum((a + b) * (a + c) / n) FILTER (WHERE n >= 2) AS se, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) FILTER (WHERE n >= 2) AS sv,
   sum(a * d / n) FILTER (WHERE n >= 2) AS u, sum(b * c / n) FILTER (WHERE n >= 2) AS o FROM f GROUP BY ALL),
 st AS (SELECT *, CASE WHEN sv > 0 THEN (abs(sa - se) - 0.5) ** 2 / sv END AS statistic FROM h)"""


@query(CMH + """ SELECT feature_a, feature_b, wi AS "window", exp_support, exp_total, ctrl_support, ctrl_total, round(statistic, 6) AS statistic, CASE WHEN o > 0 THEN round(u / o, 6) END AS odds_ratio FROM st""")
def cmh_statistic(spark, sf):
    got = colocalization.stratified(*two_samples(spark, sf), W3)
    finite = F.when(F.col("odds_ratio") < float("inf"), F.round("odds_ratio", 6))
    return got.withColumn("statistic", F.round("statistic", 6)).withColumn("odds_ratio", F.when(F.isnan("odds_ratio"), None).otherwise(finite))


@query(CMH + """ SELECT feature_a, feature_b, wi AS "window", row_number() OVER (ORDER BY statistic DESC NULLS LAST, feature_a, feature_b, wi) AS bh_rank, round(ln(((exp_support + 0.5) / (exp_total + 1)) / ((ctrl_support + 0.5) / (ctrl_total + 1))) / ln(2), 6) AS log2_ratio FROM st""")
def bh_order(spark, sf):
    from pyspark.sql.window import Window

    got = colocalization.stratified(*two_samples(spark, sf), W3)
    rank = F.row_number().over(Window.orderBy(F.col("statistic").desc_nulls_last(), "feature_a", "feature_b", "window"))
    return got.select("feature_a", "feature_b", "window", rank.cast("bigint").alias("bh_rank"), F.round(colocalization.log2_ratio(), 6).alias("log2_ratio"))


#: The tail 2 / sqrt(pi) times the integral of exp(-t * t) from z to z + 8, by Simpson's rule.
CALLS = CMH + """, zz AS (SELECT *, sqrt(greatest(statistic, 0) / 2) AS z FROM st),
 pv AS (SELECT *, CASE WHEN statistic IS NULL THEN 1.0 ELSE least(1.0, 2 / sqrt(pi()) * 0.004 / 3 * list_sum([exp(-pow(z + 0.004 * i, 2)) * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END for i in range(0, 2001)])) END AS p_value FROM zz),
 raws AS (SELECT *, least(1.0, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, feature_a, feature_b, wi)) AS raw FROM pv),
 qv AS (SELECT *, min(raw) OVER (ORDER BY p_value DESC, feature_a DESC, feature_b DESC, wi DESC ROWS UNBOUNDED PRECEDING) AS q_value, exp_support / exp_total AS exp_rate, ctrl_support / ctrl_total AS ctrl_rate,
   ln(((exp_support + 0.5) / (exp_total + 1)) / ((ctrl_support + 0.5) / (ctrl_total + 1))) / ln(2) AS log2_ratio FROM raws)
 SELECT feature_a, feature_b, wi AS "window", exp_support, exp_total, round(exp_rate, 6) AS exp_rate, ctrl_support, ctrl_total, round(ctrl_rate, 6) AS ctrl_rate, round(log2_ratio, 6) AS log2_ratio, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value,
   CASE WHEN exp_rate >= ctrl_rate THEN 'enriched' ELSE 'depleted' END AS direction, greatest(exp_rate, ctrl_rate) > 0 AS reference_abnormal,
   q_value <= 0.2 AND greatest(exp_support, ctrl_support) >= 3 AND abs(log2_ratio) >= 0.2 AND greatest(exp_rate, ctrl_rate) > 0 AS passes FROM qv"""


@query(CALLS)
def differential_calls(spark, sf):
    got = colocalization.detect(*two_samples(spark, sf), windows=W3, min_log2=0.2, alpha=0.2)
    rounded = {"exp_rate", "ctrl_rate", "log2_ratio", "p_value", "q_value"}
    return got.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in colocalization.CALL if c not in ("ref_rate", "odds_ratio")])


# clusters


def order_clusters(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select(F.col("o_orderkey").alias("read_id"), F.col("o_orderpriority").alias("cluster_id")), orders.select(F.col("o_orderkey").alias("read_id"), F.col("o_orderstatus").alias("cluster_id"))


def customer_groups(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("read_id"), F.col("c_mktsegment").alias("group"), F.col("o_custkey").alias("cluster_id"))


ENRICH = """WITH m AS (SELECT o_custkey AS cluster_id, c_mktsegment || o_orderstatus AS "group" FROM orders JOIN customer ON o_custkey = c_custkey),
 c AS (SELECT cluster_id, "group", count(*) AS n FROM m GROUP BY ALL), t AS (SELECT "group", sum(n) AS gt FROM c GROUP BY ALL), z AS (SELECT cluster_id, sum(n) AS n_total, count(*) AS present FROM c GROUP BY ALL),
 f AS (SELECT z.cluster_id, t."group", coalesce(c.n, 0) AS n, n_total::BIGINT AS n_total, present, coalesce(c.n, 0) / gt AS frac, n_total / (SELECT sum(n) FROM c) AS pool FROM z CROSS JOIN t LEFT JOIN c ON c.cluster_id = z.cluster_id AND c."group" = t."group"),
 l AS (SELECT *, CASE WHEN n > 0 THEN log2(frac / pool) ELSE '-inf'::DOUBLE END AS log2fc FROM f),
 e AS (SELECT *, first_value("group") OVER (PARTITION BY cluster_id ORDER BY log2fc DESC, "group") AS top_group, max(log2fc) OVER (PARTITION BY cluster_id) AS top FROM l),
 r AS (SELECT cluster_id, "group", n, n_total, round(frac, 9) AS frac, CASE WHEN n > 0 THEN round(log2fc, 6) END AS log2fc, top_group, present = 1 AS private, n_total >= 2 AND top >= 1 AS enriched FROM e)"""


def enriched(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return clusters.enrichment(rows.select(F.col("o_orderkey").alias("read_id"), F.col("o_custkey").alias("cluster_id")), rows.select(F.col("o_orderkey").alias("read_id"), F.concat("c_mktsegment", "o_orderstatus").alias("group")))


@query(ENRICH + " SELECT * FROM r")
def cluster_enrichment(spark, sf):
    return enriched(spark, sf).withColumn("frac", F.round("frac", 9)).withColumn("log2fc", F.when(F.col("n") > 0, F.round("log2fc", 6)))


@query(ENRICH + ' SELECT top_group, count(*) AS clusters, count(*) FILTER (WHERE enriched) AS enriched, count(*) FILTER (WHERE private) AS private FROM r WHERE "group" = top_group GROUP BY top_group')
def enriched_private(spark, sf):
    return clusters.enrichment_summary(enriched(spark, sf))


@query(ENRICH + " SELECT cluster_id, max(log2fc) AS top FROM r WHERE enriched GROUP BY cluster_id ORDER BY top DESC, cluster_id LIMIT 10")
def heatmap_rows(spark, sf):
    return clusters.select_rows(enriched(spark, sf).withColumn("log2fc", F.when(F.col("n") > 0, F.round("log2fc", 6))), True, 10)


@query("SELECT o_orderpriority AS cluster_a, o_orderstatus AS cluster_b, count(*) AS n_shared FROM orders GROUP BY ALL")
def cluster_overlap(spark, sf):
    return clusters.overlap_pairs(*order_clusters(spark, sf))


AGREE = """WITH p AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY ALL), a AS (SELECT a, sum(n) AS n FROM p GROUP BY a), b AS (SELECT b, sum(n) AS n FROM p GROUP BY b), t AS (SELECT sum(n)::DOUBLE AS n FROM p),
 v AS (SELECT t.n, (SELECT sum(n * (n - 1) / 2) FROM p) AS sab, (SELECT sum(n * (n - 1) / 2) FROM a) AS sa, (SELECT sum(n * (n - 1) / 2) FROM b) AS sb,
  ln(t.n) - (SELECT sum(n * ln(n)) FROM a) / t.n AS ha, ln(t.n) - (SELECT sum(n * ln(n)) FROM b) / t.n AS hb, ln(t.n) - (SELECT sum(n * ln(n)) FROM p) / t.n AS hab FROM t),
 x AS (SELECT *, sa * sb / (n * (n - 1) / 2) AS e FROM v)"""


def agreed(spark, sf):
    docs = table(spark, sf, "documents")
    a, b = docs.select(F.col("doc_id").alias("read_id"), F.col("lang").alias("cluster_id")), docs.select(F.col("doc_id").alias("read_id"), F.col("source").alias("cluster_id"))
    return clusters.agreement(clusters.overlap_pairs(a, b))


@query(AGREE + " SELECT n::BIGINT AS n, round((sab - e) / ((sa + sb) / 2 - e), 6) AS ari FROM x")
def ari(spark, sf):
    return agreed(spark, sf).select("n", F.round("ari", 6).alias("ari"))


@query(AGREE + " SELECT n::BIGINT AS n, round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi, 'LOW' AS level FROM x")
def nmi(spark, sf):
    return agreed(spark, sf).select("n", F.round("nmi", 6).alias("nmi"), "level")


def consensus_of(spark, sf):
    return track(events(spark, sf), "type").withColumnRenamed("seq_id", "cluster_id"), events(spark, sf).groupBy(F.col("seq_id").alias("cluster_id")).agg((F.count("*") - 60).alias("size"), F.max("end").alias("width"))


SIGN = f"""WITH {EV}, s AS (SELECT seq_id AS cluster_id, "start", type, lag(type) OVER (PARTITION BY seq_id ORDER BY "start") AS b FROM ev),
 g AS (SELECT cluster_id, count(*) AS n_segments, string_agg(type, ' > ' ORDER BY "start") FILTER (WHERE b IS NULL OR b <> type) AS consensus_signature FROM s GROUP BY cluster_id)"""


@query(SIGN + " SELECT * FROM g")
def signature(spark, sf):
    return clusters.signatures(consensus_of(spark, sf)[0])


@query(SIGN + """ SELECT g.cluster_id, size, n_segments, width, consensus_signature FROM g JOIN (SELECT seq_id, count(*) - 60 AS size, max("end") AS width FROM ev GROUP BY seq_id) ON seq_id = cluster_id WHERE size >= 2""")
def representative_catalog(spark, sf):
    segments, sizes = consensus_of(spark, sf)
    return clusters.catalogue(sizes, segments)


class _Sets(dict):
    def members(self, name, column):
        return column.isin(*self[name]) if self[name] else F.lit(False)


LABEL_ROLES = _Sets(telomere=["view", "click"], canonical=["view"], its_tar1=["error"], satellite=["purchase", "signup"], noncanonical=["click"], ct=[], arm=[])


@query(f"""WITH {EV}, k AS (SELECT seq_id, 'chr' || (1 + (row_number() OVER (PARTITION BY seq_id ORDER BY "start")) // 6) || ':' || type AS feature, "start", "end" FROM ev),
 c AS (SELECT *, split_part(feature, ':', 2) AS f, min("start") OVER (PARTITION BY seq_id) AS s0, max("end") OVER (PARTITION BY seq_id) AS e0 FROM k),
 d AS (SELECT *, sum(CASE WHEN f = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS run FROM c),
 l AS (SELECT *, sum(CASE WHEN f = 'view' THEN "end" - "start" ELSE 0 END) OVER (PARTITION BY seq_id, run) AS block FROM d),
 x AS (SELECT seq_id, bool_or(f IN ('view', 'click') AND "start" < s0 + 0.15 * (e0 - s0)) AS a, bool_or(f IN ('view', 'click') AND NOT ("start" < s0 + 0.15 * (e0 - s0)) AND "end" > e0 - 0.15 * (e0 - s0)) AS b,
   bool_or(f IN ('view', 'click') AND NOT ("start" < s0 + 0.15 * (e0 - s0)) AND NOT ("end" > e0 - 0.15 * (e0 - s0))) AS c, bool_or(f = 'error') AS i, sum(CASE WHEN f IN ('purchase', 'signup') THEN "end" - "start" ELSE 0 END) / max(e0 - s0) AS sat, max(block) AS block, count(*) AS size, max("end") AS width FROM l GROUP BY seq_id),
 ch AS (SELECT seq_id, string_agg('chr' || n, '+' ORDER BY n) AS chromosomes FROM (SELECT DISTINCT seq_id, substr(split_part(feature, ':', 1), 4)::INTEGER AS n FROM c) GROUP BY seq_id)
 SELECT x.seq_id AS cluster_id, size, width, CASE WHEN a AND b THEN 'ECTR' WHEN (a OR b) AND block >= 200 THEN 'Type II ALT subtelomere' WHEN a OR b THEN 'subtelomere' WHEN c THEN 'interstitial telomere' WHEN i THEN 'interstitial ITS/TAR1' WHEN sat >= 0.8 THEN 'satellite-dominant' ELSE '' END AS label, chromosomes
 FROM x JOIN ch ON ch.seq_id = x.seq_id WHERE size >= 2""")
def cluster_labels(spark, sf):
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("cluster_id").orderBy("start"))
    segments = consensus_of(spark, sf)[0].withColumn("feature", F.concat(F.lit("chr"), (1 + F.floor(n / 6)).cast("string"), F.lit(":"), "feature"))
    sizes = segments.groupBy("cluster_id").agg(F.count("*").alias("size"), F.max("end").alias("width"))
    return clusters.labels(sizes, segments, LABEL_ROLES, alt_bp=200).drop("consensus_signature")


@query("""SELECT coalesce(l, 'All') AS lang, coalesce(s, 'All') AS source, n FROM (SELECT lang AS l, source AS s, count(*) AS n FROM documents GROUP BY CUBE (lang, source))""")
def crosstab_margins(spark, sf):
    return clusters.crosstab_margins(table(spark, sf, "documents").select("lang", "source"), "lang", "source")


RETAIN = """WITH m AS (SELECT o_orderpriority AS a, CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' WHEN o_orderkey % 7 = 0 THEN '2-HIGH' ELSE o_orderpriority END AS b FROM orders),
 c AS (SELECT {x} AS x, {y} AS y, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS r FROM c)
 SELECT x AS {x}, sum(n)::BIGINT AS n_reads, round(coalesce(sum(n) FILTER (WHERE x = y), 0) / sum(n), 9) AS retained, string_agg(y || '(' || n || ')', ', ' ORDER BY r) FILTER (WHERE r <= 3) AS top FROM r GROUP BY x"""


def relabelled(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "1-URGENT").when(F.col("o_orderkey") % 7 == 0, "2-HIGH").otherwise(F.col("o_orderpriority")).alias("b"))


@query(RETAIN.format(x="a", y="b"))
def label_retention(spark, sf):
    return clusters.retention(relabelled(spark, sf), "a", "b").withColumn("retained", F.round("retained", 9))


@query(RETAIN.format(x="b", y="a"))
def label_purity(spark, sf):
    return clusters.purity(relabelled(spark, sf), "a", "b").withColumn("retained", F.round("retained", 9))


@query("""SELECT o_orderpriority AS cluster_id, count(*) AS size, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev(o_totalprice), 4) AS std,
 count(*) FILTER (WHERE o_orderstatus = 'F') AS "n_F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "n_O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "n_P" FROM orders GROUP BY ALL""")
def cluster_summary(spark, sf):
    s = clusters.summary(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "cluster_id"), "o_totalprice", "o_orderstatus", ["F", "O", "P"])
    return s.select("cluster_id", "size", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")], "n_F", "n_O", "n_P")


@query(f"""WITH {EV}, b AS (SELECT seq_id, type AS feature, sum("end" - "start")::BIGINT AS bp FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY bp DESC, feature) AS r, 100 * bp / sum(bp) OVER (PARTITION BY seq_id) AS pct FROM b)
 SELECT seq_id, string_agg(feature || '(' || printf('%.1f', pct) || '%)', ', ' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY seq_id""")
def top_labels(spark, sf):
    return clusters.top_labels(measures.feature_bp(track(events(spark, sf), "type"), ["seq_id"]), ["seq_id"])


@query(f"""WITH {OT}, b AS (SELECT feature FROM ot GROUP BY feature ORDER BY count(*) DESC, feature LIMIT 5)
 SELECT CASE WHEN feature IN (SELECT feature FROM b) THEN feature ELSE 'other' END AS feature, count(*) AS n FROM ot GROUP BY ALL""")
def topn_other(spark, sf):
    return clusters.top_or_other(orders_tiling(spark, sf), 5).groupBy("feature").agg(F.count("*").alias("n"))


@query("""SELECT cluster_id, read_id, rank FROM (SELECT o_orderstatus AS cluster_id, o_orderkey AS read_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY abs(o_totalprice - 1000), o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 5""")
def centroid_rank(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("cluster_id"), F.col("o_orderkey").alias("read_id"), F.abs(F.col("o_totalprice") - 1000).alias("centroid_distance"))
    return clusters.representatives(rows, 5).drop("centroid_distance")


@query("""WITH n AS (SELECT o_orderstatus AS cluster_id, o_orderkey AS read_id, o_custkey AS len, row_number() OVER (PARTITION BY o_orderstatus ORDER BY abs(o_totalprice - 1000), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
 SELECT cluster_id, read_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY len DESC, read_id)::INTEGER AS rank FROM n WHERE r <= greatest(1, n // 4)) WHERE rank <= 3""")
def nearest_quarter_longest(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("cluster_id"), F.col("o_orderkey").alias("read_id"), F.abs(F.col("o_totalprice") - 1000).alias("centroid_distance"), F.col("o_custkey").alias("read_length"))
    return clusters.nearest_then_longest(rows, 3).select("cluster_id", "read_id", "rank")


@query(f"""WITH {EV}, m AS (SELECT seq_id, unnest(range("start" // 250, ("end" - 1) // 250 + 1)) AS bin FROM ev WHERE type = 'error')
 SELECT seq_id, bin, count(*) AS n, CASE WHEN count(*) = 1 THEN 'low' WHEN count(*) <= 3 THEN 'medium' ELSE 'high' END AS level FROM m GROUP BY ALL""")
def density_bins(spark, sf):
    return measures.density_bins(track(events(spark, sf), "type").where("feature = 'error'"), 250)


from . import assembly_queries, decompose_queries, figure_queries, file_queries, legacy_queries, profile_queries, scan_queries, streaming_queries  # noqa: E402, F401  they register theirs here
