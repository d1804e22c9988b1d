"""Queries of figure data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import figures
from ..sources.binding import EV, events, table, track
from .catalogue import query


def typed(spark, sf):
    return track(events(spark, sf), "type")


@query(f"""WITH {EV} SELECT DISTINCT type AS feature FROM ev WHERE type NOT IN ('view', 'click', 'signup')""")
def missing_colors(spark, sf):
    return figures.missing_colors(typed(spark, sf), spark.createDataFrame([("view", "#1", 1), ("click", "#2", 2), ("signup", "#3", 3)], "feature string, color string, ord int"))


@query("""SELECT value, row_number() OVER (ORDER BY ord, value)::INTEGER AS place, ['#a', '#b', '#c'][((row_number() OVER (ORDER BY ord, value) - 1) % 3 + 1)::BIGINT] AS color FROM (SELECT o_orderpriority AS value, min(o_orderkey) AS ord FROM orders GROUP BY 1)""")
def value_colors(spark, sf):
    return figures.value_colors(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "ord"), "o_orderpriority", ["#a", "#b", "#c"])


GROUPED = """p AS (SELECT o_orderstatus AS "group", o_orderpriority AS subgroup, min(o_orderkey) AS s FROM orders GROUP BY ALL), g AS (SELECT *, min(s) OVER (PARTITION BY "group") AS g FROM p)"""


@query(f"""WITH {GROUPED} SELECT "group", subgroup, row_number() OVER (ORDER BY g, "group", s, subgroup)::INTEGER AS place FROM g""")
def grouping(spark, sf):
    return figures.grouping(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "ord"), "o_orderstatus", "o_orderpriority")


@query(f"""WITH {GROUPED}, o AS (SELECT "group", row_number() OVER (ORDER BY g, "group", s, subgroup) AS place FROM g) SELECT "group", (min(place) * 10)::INTEGER AS "start", (max(place) * 10 + 10)::INTEGER AS "end" FROM o GROUP BY "group\"""")
def group_spans(spark, sf):
    parts = grouping(spark, sf).select("group", "place", (F.col("place") * 10).alias("start"), (F.col("place") * 10 + 10).alias("end"))
    return figures.group_spans(parts)


@query(f"""WITH {EV}, b AS (SELECT seq_id AS cluster_id, type || ':' || band AS f, type AS c, sum("end" - "start") AS bp FROM ev GROUP BY ALL), s AS (SELECT cluster_id, c, sum(bp) AS bp FROM b GROUP BY ALL), t AS (SELECT *, bp / sum(bp) OVER (PARTITION BY cluster_id) AS share FROM s)
 SELECT cluster_id, string_agg(c, '+' ORDER BY bp DESC, c) AS chromosomes FROM t WHERE share >= 0.2 GROUP BY cluster_id""")
def major_chromosomes(spark, sf):
    rows = events(spark, sf).select(F.col("seq_id").alias("cluster_id"), "start", "end", F.concat_ws(":", "type", "band").alias("feature"))
    return figures.major_chromosomes(rows, least=0.2)


@query(f"""WITH {EV}, m AS (SELECT seq_id, max("end") AS w, coalesce(avg(("start" + "end") / 2) FILTER (WHERE type IN ('view', 'click')) > max("end") / 2, false) AS flip FROM ev GROUP BY seq_id),
 x AS (SELECT ev.seq_id AS cluster_id, CASE WHEN flip THEN w - "end" ELSE "start" END AS "start", CASE WHEN flip THEN w - "start" ELSE "end" END AS "end", type AS feature FROM ev JOIN m ON m.seq_id = ev.seq_id),
 y AS (SELECT *, sum(CASE WHEN feature IN ('view', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY cluster_id ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS b FROM x)
 SELECT cluster_id, "start", "end", feature, coalesce(max(CASE WHEN b = 0 THEN "end" END) OVER (PARTITION BY cluster_id), 0) AS breakpoint FROM y""")
def breakpoints(spark, sf):
    return figures.to_breakpoint(typed(spark, sf).withColumnRenamed("seq_id", "cluster_id"), ["view", "click"])


@query("""WITH c AS (SELECT o_orderpriority AS cluster_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY ALL)
 SELECT cluster_id, round(f / (f + o + p), 9) AS "F", round(o / (f + o + p), 9) AS "O", round(p / (f + o + p), 9) AS "P" FROM c""")
def sample_matrix(spark, sf):
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "cluster_id")
    shares = figures.row_shares(figures.count_matrix(rows, "o_orderstatus", ["F", "O", "P"]), ["F", "O", "P"])
    return shares.select("cluster_id", *[F.round(c, 9).alias(c) for c in ("F", "O", "P")])


@query(f"""WITH {EV}, m AS (SELECT seq_id, unnest(range("start" // 100, ("end" - 1) // 100 + 1)) AS bin FROM ev WHERE type = 'view') SELECT seq_id, bin, least(100, 100.0 * count(*) / 3)::DOUBLE AS percent FROM m GROUP BY ALL""")
def density_line(spark, sf):
    return figures.density_line(typed(spark, sf).where("feature = 'view'"), 100, 3)
