"""Queries of decompositions and dendrograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decompose, legacy
from ..operators.storage import cut
from ..sources.binding import EV, events, track
from .catalogue import query


def labelled(spark, sf):
    ev = events(spark, sf)
    return ev.select("seq_id", "start", "end", F.concat_ws(":", "band", "type").alias("feature"))


@query()
def matrix_loadings(spark, sf):
    """The importance of every column of the standardised bigram and abundance matrix, by its five leading components."""
    rows = labelled(spark, sf)
    cells = cut(legacy.long_matrix(rows, "count_log1p_zscore"))
    return decompose.importance(decompose.components(cells, 5, rows.select("seq_id").distinct()), spark).withColumn("importance", F.round("importance", 6))


@query()
def layer_importance(spark, sf):
    rows = labelled(spark, sf)
    cells = cut(legacy.long_matrix(rows, "count_log1p_zscore"))
    found = decompose.by_layer(decompose.importance(decompose.components(cells, 5, rows.select("seq_id").distinct()), spark))
    return found.withColumn("importance", F.round("importance", 6))


PROFILES = f"""WITH {EV}, g AS (SELECT seq_id, type AS f, lead(type) OVER (PARTITION BY seq_id ORDER BY "start") AS g FROM ev), e AS (SELECT seq_id, least(f, g) || '->' || greatest(f, g) AS name, count(*) AS n FROM g WHERE g <> f GROUP BY ALL),
 m AS (SELECT DISTINCT seq_id, right(seq_id, 2) AS cluster_id FROM ev), k AS (SELECT cluster_id, count(*) AS k FROM m GROUP BY ALL), p AS (SELECT m.cluster_id, name, sum(n) / max(k) AS value FROM e JOIN m ON m.seq_id = e.seq_id JOIN k ON k.cluster_id = m.cluster_id GROUP BY ALL)"""


def profiles(spark, sf):
    rows = track(events(spark, sf), "type")
    members = rows.select("seq_id", F.right("seq_id", F.lit(2)).alias("cluster_id")).distinct()
    return decompose.mean_profiles(legacy.bigrams(rows, True).select("seq_id", F.col("edge").alias("name"), "n"), members)


@query(PROFILES + " SELECT cluster_id, name, round(value, 9) AS value FROM p")
def mean_profiles(spark, sf):
    return profiles(spark, sf).withColumn("value", F.round("value", 9))


@query()
def cluster_dendrogram(spark, sf):
    """Merges of users by their last two digits, by mean bigram profiles."""
    return decompose.dendrogram(profiles(spark, sf))[0].withColumn("height", F.round("height", 6))


@query(PROFILES + """, c AS (SELECT DISTINCT cluster_id FROM p), x AS (SELECT a.cluster_id AS a, b.cluster_id AS b, row_number() OVER (ORDER BY d, a.cluster_id, b.cluster_id) AS r, d FROM c a JOIN c b ON a.cluster_id < b.cluster_id,
 LATERAL (SELECT sqrt(sum((coalesce(u.value, 0) - coalesce(v.value, 0)) ** 2)) AS d FROM (SELECT DISTINCT name FROM p) n LEFT JOIN p u ON u.cluster_id = a.cluster_id AND u.name = n.name LEFT JOIN p v ON v.cluster_id = b.cluster_id AND v.name = n.name))
 SELECT 0 AS step, round(d, 6) AS height FROM x WHERE r = 1""")
def nearest_clusters(spark, sf):
    """The first merge of the unscaled dendrogram: the two clusters whose mean profiles lie nearest."""
    merges, _ = decompose.dendrogram(profiles(spark, sf), "single", scale=False)
    return merges.where("step = 0").select("step", F.round("height", 6).alias("height"))
